"""Source divergence audit: how far the terms of each source lie from those of the other sources of its language, by sorted runs.

1. Tasks count the terms of their documents and pass on a row for each language, term and source: documents and occurrences. So a term that
   all documents have comes as a few rows a task. Language and term are one string, parted by a zero byte that no term has, so that a sort compares
   their first bytes at once.
2. The rows are dealt by (language, term, source) and sorted; a scan sums each run.
3. The sums are dealt by (language, term) and sorted by source. A scan of each term's run gives its document frequency, and keeps it or not.
4. With the totals of each group joined, the kept rows are dealt and scanned once more: a term's run gives a partial value for each pair of
   sources that both have it, and a row for each source that has more of it than its language has.

Terms that one source of a pair lacks depend on the other's count alone, so they are summed from a histogram of counts by source, and those
that both lack all have one value. So no term is listed for sources without it. Arithmetic is in whole numbers throughout.

A document is a row, so repeated rows are documents of their own. Null text, language or source is the empty one; a group without terms keeps
its pairs. Ties in value go by the item's UTF-8. Texts may have any length; no task holds more than the runs of one term, cut in blocks of sources. An empty table gives
an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.llm.common import stash

SCALE = 1_000_000_000
#: Distinct terms of a task that are counted before they are passed on, and sources of a block of pairs.
KEPT_TERMS, BLOCK = 400_000, 1024
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of A-Z, a-z and all code points from U+0080, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_TERMS).split()


def _count(batches):
    """(lang, source, text) to (key, source, docs, n) of as many documents as a task can hold terms of."""

    def emit(held: dict):
        for (lang, source), (docs, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{lang}\0{t.decode()}" for t in n], pa.string()), pa.array([source] * len(n), pa.string()), pa.array([docs[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())],
                names=["key", "source", "docs", "n"],
            )

    held, size = {}, 0
    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            docs, n = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = terms(text), len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
            if size > KEPT_TERMS:
                yield from emit(held)
                held, size = {}, 0
    yield from emit(held)


def _runs(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where the rows of a sorted table begin a new value of the named columns."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        codes = table.column(c).combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _by_run(names: list[str], work):
    """A function of sorted Arrow batches that gives `work` tables of whole runs of the named columns."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held)
            starts = _runs(table, names)
            if len(starts) > 1:  # the last run may go on in the next batch
                yield from work(table.slice(0, starts[-1]), starts[:-1])
                held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield from work(table, _runs(table, names))

    return run


def _sum_runs(table: pa.Table, starts: np.ndarray):
    """Documents and occurrences of each (key, source)."""
    sums = [pa.array(np.add.reduceat(table.column(c).to_numpy(), starts)) for c in ("docs", "n")]
    first = table.select(["key", "source"]).take(pa.array(starts))
    yield from pa.table([*first.columns, *sums], names=["key", "source", "docs", "n"]).to_batches()


def _keep_runs(least: int):
    """(key, source, n, whole) of the terms of at least `least` documents of their language; whole: occurrences in it."""

    def work(table: pa.Table, starts: np.ndarray):
        size = np.diff(np.append(starts, table.num_rows))
        df, whole = (np.add.reduceat(table.column(c).to_numpy(), starts) for c in ("docs", "n"))
        keep = pa.array(np.repeat(df >= least, size))
        out = table.append_column("whole", pa.array(np.repeat(whole, size))).select(["key", "source", "n", "whole"])
        yield from out.filter(keep).to_batches()

    return work


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Pairs:
    """Partial values of pairs of sources of one language, in a square over the sources met so far."""

    def __init__(self):
        self.lang, self.at, self.sums = None, {}, np.zeros((0, 0), np.int64)

    def flush(self):
        names = list(self.at)
        if names:
            i, j = np.nonzero(self.sums[: len(names), : len(names)])
            yield self.lang, [names[k] for k in i], [names[k] for k in j], self.sums[i, j]
        self.at, self.sums = {}, np.zeros((0, 0), np.int64)

    def add(self, lang: str, sources: list[str], value: np.ndarray):
        """`value`: (sources, sources). Gives out what it held where it must begin anew."""
        if lang != self.lang or len(self.at) + len(sources) > 2 * BLOCK:
            yield from self.flush()
            self.lang = lang
        place = np.array([self.at.setdefault(s, len(self.at)) for s in sources])
        if len(self.at) > len(self.sums):
            wider = np.zeros((2 * len(self.at),) * 2, np.int64)
            wider[: len(self.sums), : len(self.sums)] = self.sums
            self.sums = wider
        self.sums[np.ix_(place, place)] += value


def _emit_runs():
    """Each term's run to partial pairs (item: the other source) and terms (item: the term)."""
    pairs = _Pairs()

    def batch(part: str, lang, source, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.string()), pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())],
            names=["part", "lang", "source", "item", "value"],
        )

    def work(table: pa.Table, starts: np.ndarray):
        p, zero, q = (table.column(c).to_numpy() for c in ("p", "zero", "q"))
        more = np.flatnonzero(p > q)
        lang, source, term = (table.column(c).to_pylist() for c in ("lang", "source", "term"))
        yield batch("term", [lang[i] for i in more], [source[i] for i in more], [term[i] for i in more], _far(p[more], q[more]))
        for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
            if b - a < 2:
                continue
            for i in range(a, b, BLOCK):
                for j in range(i, b, BLOCK):
                    rows = np.arange(i, min(i + BLOCK, b))
                    both = rows if i == j else np.concatenate((rows, np.arange(j, min(j + BLOCK, b))))
                    x, y = p[both], zero[both]
                    value = _far(x[:, None], x) - _far(x[:, None], y) - _far(y[:, None], x) + _far(y[:, None], y)
                    if i != j:  # each block's own pairs were met with itself
                        value[: len(rows), : len(rows)] = 0
                        value[len(rows) :, len(rows) :] = 0
                    for k, one, two, v in pairs.add(lang[a], [source[r] for r in both], value):
                        yield batch("pair", [k] * len(one), one, two, v)

    scan = _by_run(["lang", "term"], work)

    def run(batches):
        yield from scan(batches)
        for k, one, two, v in pairs.flush():
            yield batch("pair", [k] * len(one), one, two, v)

    return run


def divergence(docs: DataFrame, least: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for every group its other sources by divergence, and its `top` terms over its language's share."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    schema = "key string, source string, docs bigint, n bigint"
    counted = rows.mapInArrow(_count, schema).repartition("key", "source").sortWithinPartitions("key", "source")
    summed = counted.mapInArrow(_by_run(["key", "source"], _sum_runs), schema).repartition("key").sortWithinPartitions("key", "source")
    kept = summed.mapInArrow(_by_run(["key"], _keep_runs(least)), "key string, source string, n bigint, whole bigint")
    lang_of = [F.expr(e) for e in ("substring_index(key, '\\0', -1) AS term", "substring(key, 1, char_length(key) - char_length(substring_index(key, '\\0', -1)) - 1) AS lang")]
    kept = stash(kept.select(*lang_of, "source", "n", "whole"), "divergence-kept")
    # totals, a row for each group; groups without terms count too
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    words = kept.select("lang", "term", "whole").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("n_lang"))
    groups = rows.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(words, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_source", "v", "n_lang")])
    groups = stash(groups.withColumn("zero", _p("0", "n_source + v")), "divergence-groups")
    placed = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", _p("n", "n_source + v").alias("p"), "zero", _p("whole", "n_lang + v").alias("q"))
    placed = placed.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = stash(placed.mapInArrow(_emit_runs(), "part string, lang string, source string, item string, value bigint"), "divergence-runs")
    # terms that one or both sources of a pair lack
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(groups.select("lang", "source", "n_source", "v", "zero"), ["lang", "source"])
    counts = counts.select("lang", "source", _p("n", "n_source + v").alias("p"), "k", "zero")
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    far = lambda p, q: f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"
    met = counts.join(others, "lang").filter("source <> item")
    mine = met.select("lang", "source", "item", F.expr(f"k * ({far('p', 'other')} - {far('zero', 'other')})").alias("value"))
    theirs = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"k * ({far('other', 'p')} - {far('other', 'zero')})").alias("value"))
    none = groups.select("lang", "source", "v", "zero").join(others, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"v * ({far('zero', 'other')})").alias("value"))
    pairs = found.filter("part = 'pair' AND source <> item").select("lang", "source", "item", "value")
    pairs = none.unionByName(mine).unionByName(theirs).unionByName(pairs).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(best.select(*columns))


def _p(n: str, of: str):
    """1 + floor(SCALE * (n + 1) / of), exact also where the product has more than 63 bits; 1 where `of` is 0."""
    product = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))"
    return F.expr(f"CASE WHEN {of} > 0 THEN 1 + ({product}) div CAST({of} AS DECIMAL(19, 0)) ELSE 1L END")
