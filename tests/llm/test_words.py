"""Language identification, spelling variants and source divergence against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import divergence, langid, queries, variants

DOC = "doc_id long, text string, lang string, source string, k string, n long, word string, value string"
ODD = [
    (1, "Alpha beta gamma delta", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, " \n\t ", "", ""), (5, "12 -- 7!", "en", "s2"), (None, "Alpha beta", None, "s1"),
    (7, "one two two", "en", "s1"), (7, "one two two", "en", "s1"), (8, "É İstanbul ΣΑΣ 漢字 👍 naïve", "fr", None), (9, "wörter Wörter " * 40_000, "de", "s3"), (10, "z" * 300_000, "de", "s3"),
    (11, "z" * 299_999, "de", "s2"), (12, "z" * 300_000 + " " + "z" * 299_999, "de", "s2"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "k", 1, "w", "v") for i, t, g, s in rows], DOC)


# spelling variants
def plain_words(rows, least=7, every=31):
    words = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least and n >= 2}


def plain_near(words):
    """Near pairs by the words with one place cut out."""
    cut = defaultdict(set)
    for w in words:
        cut[w, None].add(w)
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :], i].add(w)
    near = defaultdict(set)
    for (rest, at), own in cut.items():
        for a in own:
            near[a] |= (own - {a}) if at is not None else set()
            if at is not None and rest in words:
                near[a].add(rest)
                near[rest].add(a)
    return near


def plain_variants(words, ratio=10):
    near, form, out = plain_near(words), {}, {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def variant_rows(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_of_odd_texts(spark):
    rows = [*ODD, (20, "naïvely naively naïvely naively NAÏVELY abcdefg", "fr", "s")]
    got = variant_rows(variants.spelling_variants(docs(spark, rows)))
    words = plain_words(rows)
    assert {len(w) for w in got} >= {300_000, 299_999}
    long = {w for w in words if len(w) > 1000}
    assert got.keys() == words.keys()
    assert {w: v for w, v in got.items() if w not in long} == plain_variants({w: n for w, n in words.items() if w not in long})
    assert all(got[w][3] == 1 for w in long)
    assert variants.spelling_variants(docs(spark, []), every=None).count() == 0


@pytest.mark.parametrize(("alphabet", "most"), [("ab", 4), ("ab", 512), ("abcdé", 16), ("abcdefgh", 2)])
def test_near_words_equal_brute_force(spark, alphabet, most):
    rng = random.Random(len(alphabet) + most)
    words = {}
    while len(words) < 700:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 11)))
        words[w] = rng.choice([2, 3, 5, 40, 600, 9000])
        for _ in range(rng.randint(0, 2)):  # an edit of it
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            v = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            if len(v) >= 7:
                words.setdefault(v, rng.choice([2, 30]))
    near = plain_near(words)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in variants.near_words(df, most).collect()}
    want = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            want[w] = (len(near[w]), words[best], best)
    assert got == want


def test_hot_shard_is_split(spark):
    """All words share their first half, and a third of them all but one place."""
    words = {"abcdef" + f"{i:05b}".translate({48: "xy"[i % 2], 49: "z"}) + "ghi"[i % 3] for i in range(600)} | {"abcdefghijk" + chr(c) for c in range(0xC0, 0x100)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = variants.shards(df, 20)
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max(F.col("b") - F.col("a")).alias("w")).collect()
    assert all(r["n"] <= 20 or r["w"] == 1 for r in sizes) and any(r["w"] == 1 for r in sizes)
    near = plain_near(words)
    assert {r["word"]: r["n_near"] for r in variants.near_words(df, 20).collect()} == {w: len(near[w]) for w in words if near[w]}


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(18)] + [("a", "w05"), ("b", "w18")]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w18" for w, _ in chain}


def test_variants_of_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    assert variant_rows(queries.op12_variants(spark, sf)) == plain_variants(plain_words(rows))


# divergence
def plain_divergence(rows, least=3, top=200):
    groups, whole, df, out = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, t, g, s in rows:
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
        groups[g or "", s or ""].update(found)
        whole[g or ""].update(found)
        df[g or ""].update(set(found))
    for (g, s), n in groups.items():
        kept = [t for t in df[g] if df[g][t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        far = lambda p, q: (p - q) ** 2 // q
        p, q = share(n), share(whole[g])
        pairs = []
        for h, other in groups:
            if h == g and other != s:
                o = share(groups[g, other])
                pairs.append((-sum(far(p[t], o[t]) for t in kept), other.encode()))
        found = [(-far(p[t], q[t]), t.encode()) for t in kept if n[t] > 0 and p[t] > q[t]]
        out |= {(g, s, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(pairs), 1)}
        out |= {(g, s, "term", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(found)[:top], 1)}
    return out


def divergence_rows(frame):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [1024, 3])
def test_divergence_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "KEPT_TERMS", 50 if block == 3 else 200_000)
    rng = random.Random(block)
    rows = ODD * 3
    for i in range(300):
        words = [rng.choice(["the", "The", "of", "é漢", "a1b", "Z", f"w{rng.randint(0, 40)}", f"w{chr(97 + rng.randint(0, 25))}"]) for _ in range(rng.randint(0, 30))]
        source = "hot" if i % 3 == 0 else f"s{rng.randint(0, 12)}"
        rows.append((100 + i, " ".join(words), rng.choice(["en", "en", "de", None]), source))
    rows += [(900, "alone", "it", "a"), (901, None, "it", "b"), (902, "", "xx", None)]
    run = divergence.divergence if block == 1024 else (lambda d, **o: divergence.divergence(d.repartition(5), **o))
    assert divergence_rows(run(docs(spark, rows))) == plain_divergence(rows)
    assert divergence_rows(run(docs(spark, rows), least=1, top=3)) == plain_divergence(rows, 1, 3)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0


def test_shares_of_great_counts_are_exact(spark):
    n, of = 9_000_000_000_000_000, 9_100_000_000_000_000
    row = spark.createDataFrame([(n, of)], "n long, of long").select(divergence._p("n", "of").alias("p"), divergence._p("n", "0").alias("none")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // of and row["none"] == 1


# language identification
def plain_symbols(text):
    import unicodedata

    keep = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return "    " + re.sub(" +", " ", " " + keep + " ")[1:]


class PlainKneserNey:
    """Interpolated Kneser-Ney with dictionaries."""

    def __init__(self, texts, alphabet):
        full = Counter()
        for t in texts:
            s = plain_symbols(t)
            full.update(s[i - 4 : i + 1] for i in range(4, len(s)))
        self.counts = {5: full}
        for k in (4, 3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in {g[-(k + 1) :] for g in full})
        self.discount, self.context, self.alphabet = {}, defaultdict(lambda: [0, 0]), alphabet
        for k, counts in self.counts.items():
            n = Counter(counts.values())
            d = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
            self.discount[k] = d if 0 < d < 1 else 0.5
            for g, c in counts.items():
                self.context[g[:-1]][0] += c
                self.context[g[:-1]][1] += 1

    def probability(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.alphabet
        total, kinds = self.context.get(gram[:-1], (0, 0))
        below = self.probability(gram[1:])
        return (max(self.counts[k][gram] - self.discount[k], 0) + self.discount[k] * kinds * below) / total if total else below

    def entropy(self, text):
        s = plain_symbols(text)
        return -sum(math.log2(self.probability(s[i - 4 : i + 1])) for i in range(4, len(s))) / (len(s) - 4)


LEARN = {"en": ["the cat sat on the mat", "a dog and the other cat", "this is the house"], "fr": ["le chat est là", "une maison et le chien", "c'est l'été où"], "de": ["der Hund und die Katze", "das ist ein Haus", "über den Fluß"]}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, g, "s") for g, texts in LEARN.items() for i, t in enumerate(texts)]
    sample = docs(spark, rows).select("text", "lang")
    shares, weights = langid.kneser_ney(langid.count_grams(sample))
    langs = sorted(LEARN)
    alphabet = shares.filter("k = 1").select("gram").distinct().count()
    return langid.Model(langs, langid._table(shares, "gram", "share", langs), langid._table(weights, "context", "weight", langs), 1 / (alphabet + 1), limits=np.full(3, np.inf))


def test_entropies_equal_plain_kneser_ney(model, monkeypatch):
    alphabet = len({c for texts in LEARN.values() for t in texts for c in plain_symbols(t)}) + 1
    texts = ["the cat", "Le CHIEN, où?", "x", "12 the 34 katze!!", "İstanbul 漢字", *LEARN["de"], "a" * 500]
    for size in (1 << 20, 7):
        monkeypatch.setattr(langid, "SLICE", size)
        bits, n, has = model.entropies([*texts, "", "--", None])
        for k, g in enumerate(model.langs):
            plain = PlainKneserNey(LEARN[g], alphabet)
            assert bits[: len(texts), k] == pytest.approx([plain.entropy(t) for t in texts])
        assert list(n[: len(texts)]) == [len(plain_symbols(t)) - 4 for t in texts]
        assert list(has) == [True] * len(texts) + [False] * 3


def test_probabilities_sum_to_one(model):
    symbols = [*np.unique(np.concatenate([langid.symbols(t)[0] for t in LEARN.values()])), 0x2603]  # the last one stands for all unknown ones
    for context in ("    ", " the", "zzzz", "e ca"):
        grams = np.array([[*map(ord, context), s] for s in symbols])
        assert (2.0 ** -model.bits(grams)).sum(0) == pytest.approx(1)


def test_identify_odd_texts(spark, model):
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, ODD), model).collect()}
    for i in (2, 3, 4, 5):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["cross_entropy"], got[i]["rejected"]) == ("und", 0.0, None, True)
    assert all(0 < r["score"] <= 1 for i, r in got.items() if i not in (2, 3, 4, 5)) and None in got
    assert langid.identify(docs(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = langid.learn(docs(spark, [(1, "some text", None, "s")]))
    assert model.langs == [] and [r["lang_pred"] for r in langid.identify(docs(spark, ODD[:1]), model).collect()] == ["und"]


def test_held_out_accuracy_calibration_and_rejection(spark):
    sf = "/root/testdata/sf0.01"
    right = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op11_langid(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(right) and len(held) > 250
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_calibration(spark, model):
    rng = np.random.default_rng(3)
    import pandas as pd

    right = rng.integers(0, 3, 900)
    bits = rng.normal(3, 0.2, (900, 3))
    bits[np.arange(900), right] -= rng.normal(0.2, 0.2, 900)
    rows = pd.DataFrame({"k": [model.langs[i] for i in right], "bits": list(bits), "n": 50, "letters": True})
    own = langid.Model(model.langs, limits=np.full(3, np.inf))
    langid.calibrate(own, rows, 0.1)
    p = own.confidence(bits, np.full(900, 50.0))
    best, sure = p.argmax(1), p.max(1)
    assert abs((best == right).mean() - sure.mean()) < 0.04  # confidence says how often it is right
    for k in range(3):
        assert (bits[right == k, k] > own.limits[k]).mean() == pytest.approx(0.1, abs=0.02)


def test_other_languages_are_rejected(spark):
    """Texts of invented words of another kind than those that were learned from, at the sample's size of a small table."""
    rng = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi", "tu", "ser"], "bb": ["gro", "plin", "dex", "vum", "ja"]}
    word = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    text = lambda parts: " ".join(word(parts) for _ in range(60))
    rows = [(i, text(syllables[g]), g, "s") for i, g in enumerate(["aa", "bb"] * 120)]
    model = langid.learn(docs(spark, rows))
    asked = [(1000 + i, text(syllables[g]), None, "s") for i, g in enumerate(["aa", "bb"] * 20)] + [(2000 + i, text(["xyq", "wzz", "hhj", "qe"]), None, "s") for i in range(20)]
    got = langid.identify(docs(spark, asked), model).collect()
    assert all(r["lang_pred"] == ("aa", "bb")[r["doc_id"] % 2] for r in got if r["doc_id"] < 2000)
    assert sum(r["rejected"] for r in got if r["doc_id"] < 2000) <= 2 and all(r["rejected"] for r in got if r["doc_id"] >= 2000)


def test_sample_is_bounded(spark):
    rows = [(i, f"text number {i} of many", "en" if i % 10 else "fr", "s") for i in range(3000)]
    size = {r["lang"]: r["n"] for r in langid.training_sample(docs(spark, rows), 20_000, "text", "lang").groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert 12_000 < size["en"] < 17_000 and size["fr"] == sum(len(t) for _, t, g, _ in rows if g == "fr")
