"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexer turns a sentence into symbols: insult, threat, target, negation, speech verb, quotation mark, comma, contrast, other.
Transducers run over the symbols, forwards or backwards, and are composed: each adds one bit to every symbol.

* negation: a negation opens a window of `REACH` words, closed early by a contrast ("but");
* reported speech: after a speech verb, inside quotation marks, or before a trailing "..., she said";
* target: a target within `REACH` words before or behind.

An insult emits its weight, a threat 1; the emission is multiplied by the factor of every bit that is set there (a threat without
a target by `IDLE_THREAT`), so "he said you are not vile" is insult x target x negation x reported speech. Insults are
learned from labelled texts: words, stems of `MIN_STEM` letters or more that begin `MIN_FORMS` different words or more, and recurrent
stems, whose forms count only with another form of such a stem within `NEARBY` characters (compounding languages build an insult in many forms,
while one form alone, or two far apart in a long text, occur by chance). The weight is the smoothed log odds of occurring in a toxic text, less one standard error; a recurrent stem
counts by its forms beyond the first in a text, and must recur in two toxic texts. A word matches with a closed list of
inflections, a stem with any ending, both after an apostrophe too. Threats, targets, negations, speech verbs and contrasts are
closed lists. The sum of emissions, the greatest one, the threats and the distinct terms are combined by a logistic model. Factors and
logistic weights start from stated priors and move as far as the labelled sample bears out; the sample holds about
`sample_rows` labelled rows at most, chosen by a hash of the key (the documented bound), which bounds the lexicon too.
Scoring reads every whole text, of any length, in one pass.

Null or empty texts have no clause and get the model's score of no evidence. Labels with null key or value are ignored;
repeated label rows of a key count once, as toxic if one is. Without labels of both kinds the score is 0.05. Rows
are scored one by one, so repeated rows repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm.common import stash, text_of

REACH = 4
MIN_STEM, MAX_STEM, MIN_FORMS = 4, 10, 3
#: Characters within which a form of a recurrent stem needs another one.
NEARBY = 1000
#: The part of a stem's evidence that a longer one must have to stand for it.
MOST = 0.8
#: What is left of a threat that has no target.
IDLE_THREAT = 0.1
#: Factors of the bits before any label is seen: negated, reported, targeted.
PRIOR_FACTORS = (0.25, 0.4, 1.5)
#: Logistic weights before any label is seen: constant, emissions, greatest, threats, distinct terms.
PRIOR_WEIGHTS = (-4.0, 0.5, 0.5, 6.0, 0.5)
#: fixed values: closed lists of the grammar (English, French, German, Spanish)
NEGATIONS = frozenset("not no never without ne n pas jamais sans nicht kein keine keinen keiner nie ohne nunca jamás sin tampoco".split())
CONTRASTS = frozenset("but mais aber sondern pero sino".split())
TARGETS = frozenset("you your yours he she they them him her his their tu toi te vous il elle ils du dich dir ihr er sie usted ustedes él ella".split())
SPEECH = frozenset("said says say saying wrote writes called calls quoted claimed claims dit dis écrit disait sagte sagt schrieb schreibt dijo dice decía escribió llamó".split())
THREATS = frozenset("kill hurt beat destroy burn shoot stab tue tuer frapper détruire töten schlagen vernichten matar golpear destruir".split())
#: fixed values: endings of an inflected insult, and of a threat's stem (the infinitive without its ending)
INSULT_ENDINGS = frozenset(["", "s", "es", "e", "n", "en", "er", "x"])
THREAT_ENDINGS = frozenset("s ed ing er es en e et te ten est ai as a ons ez ent erai eras era é ée és o an ar aré arás ará aron aste arte ir iré irá re ra".split()) | {""}
_INFINITIVE = re.compile(r"(?:er|re|en|ar|ir)$")
_BREAK = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W_]+|[\"“”«»„]|,")
_QUOTES = re.compile(r"[\"“”«»„]")
_CONTRACTED = re.compile(r"n['’]t(?![^\W_])")

INSULT, THREAT, TARGET, NEGATION, SPEECH_VERB, QUOTE, COMMA, CONTRAST, OTHER = "IKTNSQ,CO"
NEGATED, REPORTED, TARGETED = 1, 2, 4


class Transducer:
    """A finite-state transducer: `step(state, symbol)` gives the next state; a symbol gets `bit` if `emits` the state in
    which it is read. Backwards ones read the sentence from its end."""

    def __init__(self, bit, start, step, emits, backwards=False):
        self.bit, self.start, self.step, self.emits, self.backwards = bit, start, step, emits, backwards

    def run(self, symbols, start=None) -> list[int]:
        state, out = self.start if start is None else start, []
        for s in reversed(symbols) if self.backwards else symbols:
            out.append(self.bit if self.emits(state) else 0)
            state = self.step(state, s)
        return out[::-1] if self.backwards else out


def _window(opens, closes=()):
    """States are the words that the window still reaches; marks that are no words do not count."""
    return lambda n, s: REACH if s in opens else 0 if s in closes else n if s in (QUOTE, COMMA) else max(n - 1, 0)


def _reporting(state, s):
    """States (inside quotation marks, after a speech verb)."""
    quoted, after = state
    return (not quoted, after) if s == QUOTE else (quoted, after or s == SPEECH_VERB)


def _trailing(state, s):
    """Backwards: a speech verb among the last three words, with a comma or quotation mark before it, reports all before.
    States: words read before the verb (0 to 2), "v0" to "v2" words since it, "R" reported, "-" none."""
    if state in ("R", "-"):
        return state
    if isinstance(state, int):
        return "v0" if s == SPEECH_VERB else state if s == QUOTE and not state else state + 1 if s in (TARGET, OTHER) and state < 2 else "-"
    return "R" if s in (COMMA, QUOTE) else f"v{int(state[1]) + 1}" if s in (TARGET, OTHER) and state != "v2" else "-"


#: The grammar: bits of these are or-ed, so the transducers are composed.
GRAMMAR = (
    Transducer(NEGATED, 0, _window({NEGATION}, {CONTRAST}), bool),
    Transducer(REPORTED, (False, False), _reporting, any),
    Transducer(REPORTED, 0, _trailing, lambda s: s == "R", backwards=True),
    Transducer(TARGETED, 0, _window({TARGET}), bool),
    Transducer(TARGETED, 0, _window({TARGET}), bool, backwards=True),
)


def bits_of(symbols: list[str], quoted: bool = False) -> list[int]:
    """The bits of every symbol of a sentence; `quoted`: it begins inside quotation marks."""
    out = [0] * len(symbols)
    for t in GRAMMAR:
        start = (quoted, False) if t.step is _reporting else None
        out = [a | b for a, b in zip(out, t.run(symbols, start), strict=True)]
    return out


_CLOSED = {
    **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(SPEECH, SPEECH_VERB),
    **dict.fromkeys(CONTRASTS, CONTRAST), **dict.fromkeys("\"“”«»„", QUOTE), ",": COMMA,
}


@dataclass
class Model:
    """Weights of terms (a trailing * in `terms` marks a stem, ** a recurrent one), factors of the bits, weights of the logistic layer."""

    terms: dict[str, float] = field(default_factory=dict)
    factors: tuple[float, float, float] = PRIOR_FACTORS
    weights: list[float] | None = None

    def matcher(self):
        """Automaton of all terms and threats: (term, whether any ending will do, endings, weight or None for a threat)."""
        import ahocorasick

        a = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for t, w in self.terms.items():
            entries.setdefault(t.rstrip("*"), []).append((t, t.endswith("*"), INSULT_ENDINGS, w))
        for t in THREATS:
            for form in {t, _INFINITIVE.sub("", t)} if len(t) > 4 else {t}:
                entries.setdefault(form, []).append((t, False, THREAT_ENDINGS, None))
        for form, found in entries.items():
            a.add_word(form, (len(form), found))
        a.make_automaton()
        return a


def term_features(text: str) -> dict[str, int]:
    """Evidence of each term: 1 for whole words and for stems (with a trailing *); for recurrent stems (with **) the forms beyond the first."""
    words = set(re.findall(r"[^\W_]+", text.lower()))
    stems = Counter(w[:n] for w in words for n in range(MIN_STEM, min(MAX_STEM, len(w)) + 1))
    return dict.fromkeys(words, 1) | {s + "*": 1 for s in stems} | {s + "**": n - 1 for s, n in stems.items() if n > 1}


def _spots(low: str, automaton) -> dict[int, tuple[str, float | None]]:
    """The strongest term or threat at each word that has one. A recurrent stem's form stands for it, so that forms are told
    apart; one without another nearby has no spot."""
    spots: dict[int, tuple[str, float | None]] = {}
    forms: dict[int, str] = {}
    for last, (n, found) in automaton.iter(low):
        start = last - n + 1
        if start and low[start - 1].isalnum():
            continue
        end = last + 1
        while end < len(low) and end - last <= MAX_STEM and low[end].isalnum():
            end += 1
        rest = low[last + 1 : end]
        for term, any_end, endings, weight in found:
            if not any_end and rest not in endings:
                continue
            held = spots.get(start)
            if held is None or (weight is not None and (held[1] is None or weight > held[1])):
                spots[start] = (term, weight)
                forms.pop(start, None)
                if term.endswith("**"):
                    forms[start] = low[start:end]
    company: set[int] = set()
    for order in (sorted(forms), sorted(forms, reverse=True)):
        before = other = None  # the last place, and the last one of another form
        for at in order:
            if before is not None and forms[before] != forms[at]:
                other = before
            if other is not None and abs(at - other) <= NEARBY:
                company.add(at)
            before = at
    for at, form in forms.items():
        if at in company:
            spots[at] = (form, spots[at][1])
        else:
            del spots[at]
    return spots


def clause_features(text: str, automaton) -> list[float]:
    """By the eight sets of bits: summed weights of insults, greatest weight, distinct terms, threats (32 numbers)."""
    low = _CONTRACTED.sub(" not", text.lower())
    sums, most, threats = [0.0] * 8, [0.0] * 8, [0.0] * 8
    terms: list[set] = [set() for _ in range(8)]
    spots = _spots(low, automaton)
    done, seen, quoted = -1, 0, False
    for at in sorted(spots):
        if at < done:
            continue
        begin = max(low.rfind(c, max(done, 0), at) for c in ".!?;\n") + 1 or max(done, 0)
        stop = _BREAK.search(low, at)
        done = stop.start() if stop else len(low)
        # quotation marks pair up within a paragraph
        line = low.rfind("\n", seen, begin)
        quoted = (quoted and line < 0) ^ (len(_QUOTES.findall(low, line + 1 if line >= 0 else seen, begin)) % 2 == 1)
        seen = begin
        tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(low, begin, done)]
        symbols = [_CLOSED.get(w) or ((THREAT if spots[s][1] is None else INSULT) if s in spots else OTHER) for w, s in tokens]
        for (_, s), symbol, b in zip(tokens, symbols, bits_of(symbols, quoted), strict=True):
            if symbol == THREAT:
                threats[b] += 1.0
            elif symbol == INSULT:
                term, weight = spots[s]
                sums[b] += weight
                most[b] = max(most[b], weight)
                terms[b].add(term)
    return [*sums, *most, *map(float, map(len, terms)), *threats]


def composed(factors) -> np.ndarray:
    """The factor of each of the eight sets of bits."""
    return np.array([np.prod([f for i, f in enumerate(factors) if b >> i & 1]) for b in range(8)])


def design(rows, factors) -> np.ndarray:
    """Columns of the logistic layer."""
    x = np.asarray(rows, float).reshape(-1, 4, 8)
    f = composed(factors)
    threat = f * np.where(np.arange(8) & TARGETED, 1 / factors[2], IDLE_THREAT)
    insult, most, terms, threats = x[:, 0] @ f, (x[:, 1] * f).max(1), x[:, 2] @ np.minimum(f, 1), x[:, 3] @ threat
    return np.column_stack([np.ones(len(x)), np.log1p(insult), most, np.log1p(threats), np.log1p(terms)])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights with a ridge towards the priors, and the penalised log likelihood."""
    prior = np.array(PRIOR_WEIGHTS)
    w, ridge = prior.copy(), np.diag([1e-2, *[1.0] * (x.shape[1] - 1)])
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ (w - prior))
        w = w + np.clip(step, -2, 2)
    z = np.clip(x @ w, -30, 30)
    return w, float((y * z - np.log1p(np.exp(z))).sum() - (w - prior) @ ridge @ (w - prior) / 2)


def fit(rows: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float, float], list[float]]:
    """(factors, logistic weights): each factor is tried at half to double its place; leaving the prior costs 2 a doubling."""
    factors, best = list(PRIOR_FACTORS), _fit(design(rows, PRIOR_FACTORS), y)
    for i in range(3):
        for power in (-2, -1, 1, 2):
            tried = [*factors]
            tried[i] = PRIOR_FACTORS[i] * 2.0**power
            w, value = _fit(design(rows, tried), y)
            if value - 2 * abs(power) > best[1]:
                factors, best = tried, (w, value - 2 * abs(power))
    return tuple(factors), best[0].tolist()


def train_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of about `sample_rows` labelled texts at most, distinct; a written table."""
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("toxic"))
    n = marks.count()
    share = min(1.0, sample_rows / max(n, 1))
    grain = 1 << 30
    marks = marks.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(grain)) < int(share * grain))
    rows = docs.select(key, text_of(text).alias("text")).join(F.broadcast(marks) if n * share <= 2 * sample_rows else marks, key)
    return stash(rows.select("text", "toxic").dropDuplicates(), "toxic-sample")


def learn(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, least_weight: float = 3.0,
    key: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Learn the terms, the factors and the logistic layer. `labels` (key, label) must hold only rows that may be learned from."""
    sample = train_rows(docs, labels, sample_rows, key, text, label)

    def count(side: int, among: frozenset | None):
        """A function of Arrow batches (text, toxic) to (term, n, texts): evidence of the term in texts of one side, and how many have it."""

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part, terms, texts = b.slice(i, 256), Counter(), Counter()
                    for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        if y == side:
                            own = term_features(t)
                            own = own if among is None else {k: own[k] for k in own.keys() & among}
                            terms.update(own)
                            texts.update(own.keys())
                    yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()), *(pa.array(map(c.get, terms), pa.int64()) for c in (terms, texts))], names=["term", "n", "texts"])

        return run

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return Model()
    odds = float(np.log(sizes[0] / sizes[1]))
    # without any clean text a term needs so many toxic ones to reach the least weight; the others need not be counted
    enough = next((n for n in range(1, 1000) if _weight(n, 0, odds) >= least_weight), 1000)
    counted = lambda side, among: sample.mapInArrow(count(side, among), "term string, n bigint, texts bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    toxic = stash(counted(1, None), "toxic-terms")
    words = toxic.filter(~F.col("term").endswith("*"))
    stems = words.select(F.explode(F.transform(F.sequence(F.lit(MIN_STEM), F.lit(MAX_STEM)), lambda n: F.when(F.char_length("term") >= n, F.concat(F.substring(F.col("term"), F.lit(1), n), F.lit("*"))))).alias("term"))
    forms = stems.filter("term is not null").groupBy("term").agg(F.count("*").alias("forms"))
    some = toxic.filter(F.col("n") >= enough).join(forms, "term", "left")
    some = some.filter(F.when(F.col("term").endswith("**"), F.col("texts") > 1).when(F.col("term").endswith("*"), F.col("forms") >= MIN_FORMS).otherwise(True))
    pos = {r["term"]: r["n"] for r in some.select("term", "n").collect()}  # bounded by the sample
    neg = {r["term"]: r["n"] for r in counted(0, frozenset(pos)).select("term", "n").collect()}
    model = Model(lexicon(pos, neg, odds, least_weight))
    feats = sample.mapInArrow(_features_of(model, ["toxic"]), "toxic int, f array<double>").toPandas()  # sample_rows rows
    model.factors, model.weights = fit(np.stack(feats["f"].to_numpy()), feats["toxic"].to_numpy(float))
    return model


def lexicon(pos: dict[str, int], neg: dict[str, int], odds: float, least_weight: float) -> dict[str, float]:
    """Weights of the terms that reach `least_weight`. `pos`, `neg`: evidence of each term on either side."""
    weights = {t: w for t, n in pos.items() if (w := _weight(n, neg.get(t, 0), odds)) >= least_weight}
    # a stem says no more than a longer one that has most of its evidence and no less weight
    spare = set()
    for t in weights:
        stem = t.rstrip("*")
        mark = t[len(stem) :]
        for n in range(MIN_STEM, len(stem)) if mark else ():
            shorter = stem[:n] + mark
            if shorter in weights and weights[t] >= weights[shorter] and pos[t] >= MOST * pos[shorter]:
                spare.add(shorter)
    terms: dict[str, float] = {}
    for t in sorted(weights.keys() - spare, key=lambda t: (-weights[t], t)):
        name = t.rstrip("*")
        if not any(name[:n] + mark in terms for n in range(MIN_STEM, len(name) + 1) for mark in ("*", "**")):  # else a heavier stem holds it
            terms[t] = weights[t]
    return terms


def _weight(pos: int, neg: int, odds: float) -> float:
    """Smoothed log odds less one standard error; odds: log of clean texts a toxic one."""
    p, n = pos + 0.5, neg + 0.5
    return float(np.log(p / n) + odds - np.sqrt(1 / p + 1 / n))


def scores(model: Model, features) -> np.ndarray:
    """The score of each row of features."""
    if model.weights is None:
        return np.full(len(features), 0.05)
    return 1 / (1 + np.exp(-np.clip(design(features, model.factors) @ np.array(model.weights), -30, 30)))


def _features_of(model: Model, keep: list[str], score: bool = False):
    """A function of Arrow batches (text, *keep) to (*keep, features or score)."""

    def run(batches):
        automaton = model.matcher()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                f = [clause_features(t, automaton) for t in part.column("text").to_pylist()]
                last = pa.array(scores(model, f)) if score else pa.array(f, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], last], names=[*keep, "score" if score else "f"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double) of every whole text."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(text_of(text).alias("text"), F.col(key).alias("k"))
    return rows.mapInArrow(_features_of(model, ["k"], True), f"k {kind}, score double").withColumnRenamed("k", key)


def reject(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `threshold`."""
    columns = docs.columns

    def run(batches):
        automaton = model.matcher()
        for b in batches:
            texts = b.column(columns.index(text))
            for i in range(0, b.num_rows, 512):
                f = [clause_features(t or "", automaton) for t in texts.slice(i, 512).to_pylist()]
                yield b.slice(i, 512).filter(pa.array(scores(model, f) < threshold))

    return docs.mapInArrow(run, docs.schema)
