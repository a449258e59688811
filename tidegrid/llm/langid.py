"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is read as lower-case letters and marks, anything else as one space; it begins with spaces as context. A language's model of
order 5 is trained on a bounded sample of its labelled rows: Spark counts the n-grams, takes lower orders by continuation counts
(distinct left neighbours), and derives a discount for each order and language from the n-grams seen once and twice. The model is
two sorted arrays of 64-bit hashes, with the discounted shares of n-grams and the interpolation weights of contexts, and is broadcast:
`sample_chars` bounds it, whatever the corpus. A character's probability sums the shares of its n-grams of all orders, each times the
weights of the longer contexts, down to a uniform one over the alphabet. A text gets the language of the lowest cross-entropy in bits a
character; of equal ones the first by name.

A fifth of the sample is kept from training and calibrates the rest: confidence is a softmax of -slope * length**power * entropy over
languages, fitted by likelihood, and a language rejects texts whose cross-entropy lies over the quantile 1 - `reject` of its own ones, or, with fewer than 1 / `reject`
of them, four standard deviations over their mean; with fewer than ten it rejects none.

Null text, and text without a letter, has no language. Without any row to learn from nothing has one. Whole texts are scored, long ones
in slices; memory follows the longest text. Ties and repeated rows give equal results; empty tables give empty ones; other columns
of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm.common import stash

ORDER = 5
#: Characters that are scored at once.
SLICE = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and whether it is a letter or mark."""
    if not _tables:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _tables.extend((np.array([k == "L" for k in kinds]), np.array([k in "LM" for k in kinds])))
    return _tables[0], _tables[1]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, each begun by `ORDER` - 1 spaces; where each begins, and the end; whether it has a letter)."""
    lower = [f" {(t or '').lower()} " for t in texts]
    at = np.concatenate(([0], np.cumsum([len(t) for t in lower], dtype=np.int64)))
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, mark = _letters()
    has = np.add.reduceat(letter[codes], at[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    codes = np.where(mark[codes], codes, np.uint32(32))
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1]] = True
    begins = np.concatenate(([0], np.cumsum(keep)))[at]
    codes = codes[keep]
    more = ORDER - 2
    codes = np.insert(codes, np.repeat(begins[:-1], more), 32)
    return codes, begins + more * np.arange(len(begins)), has


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols that begin at each place, for as many places as have k."""
    n = max(0, len(codes) - k + 1)
    h = np.full(n, k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _PRIME + codes[i : i + n].astype(np.uint64)
        return _mixed(h)


def hashes_of(grams: list[str], k: int) -> np.ndarray:
    """The same of strings of length k."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return window_hashes(codes, k)[::k] if k else np.full(len(grams), 1, np.uint64)


@dataclass
class Table:
    """Values by hash and language: sorted distinct hashes, and for each its languages and their values."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    lang: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, keys: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Table:
        order = np.lexsort((lang, keys))
        keys, first = np.unique(keys[order], return_index=True)
        return cls(keys, np.append(first, len(order)).astype(np.int64), lang[order].astype(np.int32), value[order])

    def rows(self, keys: np.ndarray, langs: int, absent: float) -> np.ndarray:
        """(keys, languages) values by binary search, `absent` where there is none."""
        out = np.full((len(keys), langs), absent)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            at = at[hit]
            n = self.start[at + 1] - self.start[at]
            row = np.repeat(np.arange(len(hit)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.start[at][row]
            out[hit[row], self.lang[place]] = self.value[place]
        return out


@dataclass
class Model:
    """The models of all languages, and their calibration."""

    langs: list[str] = field(default_factory=list)
    shares: Table = field(default_factory=Table)
    weights: Table = field(default_factory=Table)
    uniform: float = 1.0
    slope: float = 1.0
    power: float = 0.5
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """(n-grams, languages) -log2 of the last symbol's probability after the others. `grams`: (n, ORDER) code points."""
        n, langs = len(grams), len(self.langs)
        # the empty context's weight leads from one symbol to the uniform distribution
        p = np.full((n, langs), self.uniform) * self.weights.rows(np.full(n, 1, np.uint64), langs, 1.0)
        for k in range(1, ORDER + 1):
            if k > 1:
                p *= self.weights.rows(_rows_hash(grams[:, ORDER - k : ORDER - 1]), langs, 1.0)
            p += self.shares.rows(_rows_hash(grams[:, ORDER - k :]), langs, 0.0)
        return -np.log2(p)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """((texts, languages) bits a character, characters, whether it has a letter)."""
        codes, at, has = symbols(texts)
        total = np.zeros((len(texts), len(self.langs)))
        n = np.diff(at) - (ORDER - 1)
        ends = at[1:]
        for i in range(0, max(0, len(codes) - ORDER + 1), SLICE):
            part = codes[i : i + SLICE + ORDER - 1]
            _, first, again = np.unique(window_hashes(part, ORDER), return_index=True, return_inverse=True)
            last = np.arange(len(again)) + i + ORDER - 1
            text = np.searchsorted(ends, last, side="right")
            inside = last >= at[text] + ORDER - 1  # the spaces before a text are context only
            rows = self.bits(part[first[:, None] + np.arange(ORDER)])
            low, high = text[0], text[-1] + 1
            for k in range(len(self.langs)):
                total[low:high, k] += np.bincount(text[inside] - low, rows[again[inside], k], high - low)
        return total / np.maximum(n, 1)[:, None], n, has

    def confidence(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(texts, languages) that sum to 1."""
        return confidence(bits, n, self.slope, self.power)


def _rows_hash(rows: np.ndarray) -> np.ndarray:
    """`window_hashes` of the rows of a matrix."""
    h = np.full(len(rows), rows.shape[1] + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows.shape[1]):
            h = h * _PRIME + rows[:, i].astype(np.uint64)
        return _mixed(h)


def confidence(bits: np.ndarray, n: np.ndarray, slope: float, power: float) -> np.ndarray:
    z = -slope * (np.maximum(n, 1.0) ** power)[:, None] * (bits - bits.min(1, keepdims=True))
    e = np.exp(np.maximum(z, -700))
    return e / e.sum(1, keepdims=True)


def training_sample(docs: DataFrame, sample_chars: int, text: str, lang: str) -> DataFrame:
    """(text, lang, tune) of the labelled rows to learn from, about `sample_chars` characters, as many of each language as it has; `tune`: the
    fifth that calibrates. Rows are picked by a hash of their text, so copies go together; a written table."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n")).collect()}  # a row for each language
    grain = 1 << 30
    left, limits = sample_chars, {}
    for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        part = left / (len(sizes) - i)
        limits[name] = min(grain, int(grain * part / max(n, 1)))
        left -= min(n, part)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")] if limits else F.lit(0)
    deal = lambda salt: F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(grain))
    return stash(rows.filter(deal("sample") < limit).withColumn("tune", deal("tune") < grain // 5), "langid-sample")


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) of all n-grams of the full order."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = np.array(b.column("text").to_pylist(), object)
            for lang in sorted(set(langs)):
                codes, at, _ = symbols(list(texts[langs == lang]))
                h = window_hashes(codes, ORDER)
                last = np.arange(len(h)) + ORDER - 1
                own = np.flatnonzero(last >= at[np.searchsorted(at[1:], last, side="right")] + ORDER - 1)
                _, first, n = np.unique(h[own], return_index=True, return_counts=True)
                grams = codes[own[first][:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams = [grams[i : i + ORDER] for i in range(0, len(grams), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return sample.select("text", "lang").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, k, gram, share) and (lang, context, weight) of interpolated Kneser-Ney models from counts of the full order. Lower orders count
    the distinct symbols before a gram."""
    deeper = F.transform(F.sequence(F.lit(1), F.lit(ORDER - 1)), lambda k: F.struct(k.alias("k"), F.substring("gram", -k, k).alias("gram"), F.substring("gram", -(k + 1), k + 1).alias("wider")))
    lower = full.select("lang", F.inline(deeper)).distinct().groupBy("lang", "k", "gram").agg(F.count("*").alias("n"))
    counts = stash(lower.unionByName(full.withColumn("k", F.lit(ORDER))), "langid-counts")
    ones, twos = (F.sum((F.col("n") == i).cast("int")) for i in (1, 2))
    discount = F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.0))
    cut = counts.groupBy("lang", "k").agg(F.when((discount > 0) & (discount < 1), discount).otherwise(F.lit(0.5)).alias("d"))
    counts = counts.withColumn("context", F.expr("substring(gram, 1, k - 1)"))
    around = counts.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(cut, ["lang", "k"])
    shares = counts.join(around, ["lang", "k", "context"]).select("lang", "k", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
    return shares, around.select("lang", "context", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"))


def _table(frame: DataFrame, name: str, value: str, langs: list[str]) -> Table:
    """Collects a model's rows, of which the sample bounds the number."""
    got = frame.select("lang", name, value).toArrow()
    number = {x: i for i, x in enumerate(langs)}
    grams = np.array(got.column(name).to_pylist(), object)
    lang = np.array([number[x] for x in got.column("lang").to_pylist()], np.int32)
    size = np.array([len(g) for g in grams], np.int64)
    keys = np.zeros(len(grams), np.uint64)
    for k in np.unique(size):
        keys[size == k] = hashes_of(list(grams[size == k]), int(k))
    return Table.of(keys, lang, got.column(value).to_numpy())


def learn(docs: DataFrame, sample_chars: int = 4_000_000, tune_rows: int = 4_000, reject: float = 0.01, text: str = "text", lang: str = "lang") -> Model:
    """Train and calibrate. `docs` must hold only rows that may be learned from. Bounds: `sample_chars` characters of labelled text for training
    and calibration, `tune_rows` calibrating rows."""
    sample = training_sample(docs, sample_chars, text, lang)
    full = count_grams(sample.filter("NOT tune"))
    shares, weights = kneser_ney(stash(full, "langid-grams"))
    shares = stash(shares, "langid-shares")
    langs = sorted(r["lang"] for r in shares.select("lang").distinct().collect())
    if not langs:
        return Model()
    alphabet = shares.filter("k = 1").select("gram").distinct().count()
    model = Model(langs, _table(shares, "gram", "share", langs), _table(weights, "context", "weight", langs), 1 / (alphabet + 1))
    model.limits = np.full(len(langs), np.inf)
    tune = sample.filter(F.col("tune") & F.col("lang").isin(langs))
    n = tune.count()
    if n:
        tune = tune.filter(F.pmod(F.xxhash64("text", F.lit("rows")), F.lit(1 << 30)) < int(min(1.0, tune_rows / n) * (1 << 30)))
        calibrate(model, score_rows(tune.select("lang", "text"), model, "lang").toPandas(), reject)
    return model


def calibrate(model: Model, rows, reject: float) -> None:
    """Fit slope and power by likelihood, and each language's limit, on scored rows (k: the right language, bits, n, letters)."""
    rows = rows[rows["letters"]]
    if not len(rows):
        return
    bits, n = np.stack(rows["bits"].to_numpy()), rows["n"].to_numpy(float)
    right = np.array([model.langs.index(x) for x in rows["k"]])
    tried = []
    for power in (0.0, 0.25, 0.5, 0.75, 1.0):
        for slope in 2.0 ** np.arange(-6, 8, 0.5):
            p = confidence(bits, n, slope, power)[np.arange(len(right)), right]
            tried.append((-np.log(0.999 * p + 0.001 / len(model.langs)).sum(), slope, power))
    _, model.slope, model.power = min(tried)
    for k in range(len(model.langs)):
        own = bits[right == k, k]
        if len(own) >= 1 / reject:
            model.limits[k] = np.quantile(own, 1 - reject)
        elif len(own) >= 10:  # too few to tell the quantile
            model.limits[k] = own.mean() + 4 * own.std()


def score_rows(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """(k, bits array<double> by language, n characters, letters boolean) of rows (key, text)."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        m = held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < SLICE):
                    size += len(texts[j] or "")
                    j += 1
                bits, n, has = m.entropies(texts[i:j])
                flat = pa.array(bits.ravel(), pa.float64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(m.langs), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, pa.array(n, pa.int64()), pa.array(has)], names=["k", "bits", "n", "letters"])
                i = j

    return rows.select(F.col(key), F.col("text")).mapInArrow(run, f"k {kind}, bits array<double>, n bigint, letters boolean")


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", none: str = "und") -> DataFrame:
    """(key, lang_pred, score, cross_entropy, rejected) of every whole text: the language, its confidence from 0 to 1, the bits a character,
    and whether the language rejects the text. Without a language: `none`, 0, null, true."""
    rows = score_rows(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")), model, "k")
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            if not b.num_rows:
                continue
            n, has = b.column("n").to_numpy(), np.array(b.column("letters").to_pylist(), bool)
            if not m.langs:
                has[:] = False
            bits = b.column("bits").flatten().to_numpy().reshape(len(n), len(m.langs))
            names, score, least, refused = [none] * len(n), np.zeros(len(n)), [None] * len(n), np.ones(len(n), bool)
            if m.langs:
                best = bits.argmin(1)
                p = m.confidence(bits, n)[np.arange(len(n)), best]
                for i in np.flatnonzero(has):
                    low = float(bits[i, best[i]])
                    names[i], score[i], least[i], refused[i] = m.langs[best[i]], min(1.0, p[i]), low, low > m.limits[best[i]]
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array(names, pa.string()), pa.array(score), pa.array(least, pa.float64()), pa.array(refused)],
                names=["k", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    out = rows.mapInArrow(run, f"k {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("k", key)
