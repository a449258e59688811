"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word is a run of Latin letters, A-Z lower-cased; single occurrences may be damaged first (see `damaged`). Two words are near if one
inserted, deleted or replaced code point parts them.

The index is dealt out in shards. Let m be the length of the longer word of a pair, and the edit lie in its places from a to b; what
lies outside is equal in both words. A shard is (m, a, b, the part outside); a word goes to the two halves of places for m its own length,
and for m one more, where it can be the shorter one. So a row goes to four shards, and every near pair meets in exactly one: that whose places hold
the first difference. A shard of many words is halved again, and again, until it is small; of one place alone it can hold no more words than
the alphabet has letters. So no task holds a hot group, and no word is left out.

Inside its shards a task builds the inverted index: postings of trigrams by shard and position, padded at both ends. An edit breaks at
most three trigrams of the longer word, so of w places at least w - 1 trigrams are shared, at the same position or, in
the longer word, one further. As many of each word's rarest trigrams as make sure that one is shared are looked up; their postings, of the lengths
and positions allowed, are merged by one sort of all runs at once, which does the heap's work for all words of a batch; the shared trigrams of what
it meets are counted, pairs under the bound go, and the rest is verified.

Words may have any length. Null texts have no words; a null key counts as the empty text in `damaged`. Repeated rows count again. Words of equal
count are told apart by code points. Empty tables give an empty table, and extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm.common import stash

Q = 3
#: Distinct words of a task that are counted before they are passed on.
KEPT_WORDS = 200_000
#: Symbols of a batch of shards, and pairs that are looked at at once.
CELLS, PAIRS = 1 << 20, 1 << 21
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, as Latin-1 bytes: one a code point."""
    return (text or "").encode("latin-1", "replace").translate(_RUNS).split()


def damaged(run: bytes, crc: int, every: int) -> bytes:
    """A run, or, where `every` divides the checksum, the run without its code point number checksum % length. `crc`: that of `<key>:`."""
    h = zlib.crc32(run.decode("latin-1").encode(), crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int | None = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of at least `min_length` code points and `min_count` occurrences. `every`: None leaves all occurrences as they are."""

    def emit(words: Counter):
        kept = [w for w in words if len(w) >= min_length]
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array([words[w] for w in kept], pa.int64())], names=["word", "n"])

    def run(batches):
        words: Counter = Counter()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [w for w in runs(t) if len(w) >= min_length]
                if every is None:
                    words.update(found)
                else:
                    crc = zlib.crc32(f"{k}:".encode())
                    for w, n in Counter(found).items():
                        words[damaged(w, crc, every)] += n
                if len(words) > KEPT_WORDS:
                    yield emit(words)
                    words.clear()
        yield emit(words)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _routed(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, m, a, b) with `shard`, a hash of what lies outside the places a to b of the longer word."""
    short = F.col("m") - F.char_length("word")
    left, right = F.substring("word", F.lit(1), F.col("a")), F.expr("substring(word, b - (m - char_length(word)) + 1)")
    return rows.withColumn("short", short.cast("int")).withColumn("shard", F.xxhash64("m", "a", "b", left, F.lit("\0"), right)).select("word", "n", "m", "a", "b", "short", "shard")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row for both halves of its places."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    both = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    return _routed(rows.withColumn("h", F.explode(both)).select("word", "n", "m", F.col("h.a").alias("a"), F.col("h.b").alias("b")))


def shards(words: DataFrame, most: int = 512, cells: int = 1 << 18) -> DataFrame:
    """(word, n, m, a, b, short, shard): every word in its shards. A shard of more than `most` words, or of more than `cells` places in them, is
    halved until it is not, or has one place only."""
    size = F.char_length("word").cast("int")
    rows = words.withColumn("m", F.explode(F.array(size, size + 1))).withColumn("a", F.lit(0)).withColumn("b", F.col("m"))
    rows, done, salts = stash(_halves(rows), "variants-rows"), None, 16
    while True:
        many = (F.count("*") > most) | ((F.count("*") > 1) & (F.count("*") * F.max(F.col("b") - F.col("a")) > cells))
        sizes = rows.groupBy("shard").agg((many & (F.max(F.col("b") - F.col("a")) > 1)).alias("hot"))
        hot = stash(sizes.filter("hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "variants-hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int")).join(hot, ["shard", "salt"], "left")
        marked = stash(marked.drop("salt"), "variants-marked")
        small = marked.filter("hot IS NULL").drop("hot")
        done = small if done is None else done.unionByName(small)
        rows = stash(_halves(marked.filter("hot").drop("hot", "shard", "short")), "variants-rows")


def _padded(codes: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """(rows, positions) keys of the trigrams of rows of symbols, by shard; equal keys at one position are equal trigrams, but for
    collisions, which the verification finds."""
    n, w = codes.shape
    wide = np.zeros((n, w + 2 * (Q - 1)), np.uint64)
    wide[:, Q - 1 : Q - 1 + w] = codes
    with np.errstate(over="ignore"):
        key = np.repeat((shard.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))[:, None], w + Q - 1, 1)
        for i in range(Q):
            key = (key ^ wide[:, i : i + w + Q - 1]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key


def _rarest(keys: np.ndarray, among: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the `most` rarest trigrams of each row; rarity, not position, is the order in both words of a pair."""
    n, p = keys.shape
    if p <= most:
        return np.repeat(np.arange(n), p), np.tile(np.arange(p), n)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    seen = np.where(among[at] == keys, count[at], 0)
    # by frequency, then by trigram, then by position
    order = np.lexsort((np.broadcast_to(np.arange(p), keys.shape), keys, seen), axis=1)[:, :most]
    return np.repeat(np.arange(n), most), order.ravel()


def _meetings(probe: np.ndarray, probe_row: np.ndarray, post: np.ndarray, post_row: np.ndarray, n: int):
    """Distinct (probe row, posting row) whose keys meet, in parts of about `PAIRS` meetings. The runs of postings of all probes are merged by one
    sort, in which equal pairs are neighbours."""
    order = np.argsort(post, kind="stable")
    post, post_row = post[order], post_row[order]
    low, high = np.searchsorted(post, probe, "left"), np.searchsorted(post, probe, "right")
    by_row = np.argsort(probe_row, kind="stable")
    low, size, rows = low[by_row], (high - low)[by_row], probe_row[by_row]
    ends = np.cumsum(size)
    i = 0
    while i < len(rows):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        while j < len(rows) and rows[j] == rows[j - 1]:  # all runs of a row at once
            j += 1
        part = size[i:j]
        which = np.repeat(np.arange(i, j), part)
        place = np.arange(len(which)) - np.repeat(np.cumsum(part) - part, part) + low[which]
        pair = np.unique(rows[which].astype(np.int64) * n + post_row[place])
        yield pair // n, pair % n
        i = j


def near_pairs(words: list[str], m: int, a: int, b: int, short: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (i, j) of words whose first difference lies in the places a to b, each pair once; of unlike lengths i is the shorter.
    All words are of the shards (m, a, b); `shard`: number of each word's shard."""
    w, found = b - a, []
    matrix = lambda rows, width: np.array([[ord(c) for c in words[r][a : a + width]] for r in rows], np.uint64).reshape(len(rows), width)
    own, less = np.flatnonzero(short == 0), np.flatnonzero(short == 1)
    o, s = matrix(own, w), matrix(less, w - 1)
    ok, sk = _padded(o, shard[own]), _padded(s, shard[less])
    # position goes into the key of a posting, so that only allowed ones meet
    placed = lambda k, shift: (k ^ (np.arange(k.shape[1], dtype=np.uint64) + np.uint64(shift)) * np.uint64(0xC2B2AE3D27D4EB4F))
    among, count = np.unique(ok, return_counts=True) if w > 1 else (ok[:0, 0], None)
    bound = w - 1
    if w > 1:
        # a word of p trigrams is sure to share one of its p - bound + 1 rarest
        row, at = _rarest(ok, among, count, w + Q - 1 - bound + 1)
        postings, post_row = placed(ok, 0)[row, at], row
    else:  # the one place is the edit: all that meet here are near
        postings, post_row = shard[own].astype(np.uint64), np.arange(len(own))
    for i, j in _meetings(postings, post_row, postings, post_row, len(own)):
        keep = (i < j) & (shard[own[i]] == shard[own[j]])
        i, j = i[keep], j[keep]
        if w > 1:
            keep = (ok[i] == ok[j]).sum(1) >= bound
            i, j = i[keep], j[keep]
        keep = (o[i] != o[j]).sum(1) == 1
        found.append((own[i[keep]], own[j[keep]]))
    if len(less) and len(own):
        if w > 1:
            row, at = _rarest(sk, among, count, w + Q - 2 - bound + 1)
            probes = np.concatenate((placed(sk, 0)[row, at], placed(sk, 1)[row, at]))
            rows = np.concatenate((row, row))
        else:
            probes, rows = shard[less].astype(np.uint64), np.arange(len(less))
        after = np.array([ord(words[r][b]) if b < m else 0 for r in own], np.uint64)
        for i, j in _meetings(probes, rows, postings, post_row, len(own)):
            keep = shard[less[i]] == shard[own[j]]
            i, j = i[keep], j[keep]
            if w > 1:
                keep = ((sk[i] == ok[j][:, :-1]) | (sk[i] == ok[j][:, 1:])).sum(1) >= bound
                i, j = i[keep], j[keep]
            head = np.cumprod(s[i] == o[j][:, :-1], 1).sum(1)
            tail = np.cumprod((s[i] == o[j][:, 1:])[:, ::-1], 1).sum(1)
            # where the shorter word's part is all the head, the first difference lies here unless the next symbols agree
            keep = (head + tail >= w - 1) & ((head < w - 1) | (o[j][:, w - 1] != after[j]))
            found.append((less[i[keep]], own[j[keep]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _summed(words: list[str], n: list[int], i: np.ndarray, j: np.ndarray):
    """(word, n_near, best_n, best) of a batch's pairs, in both directions."""
    order = sorted(range(len(words)), key=lambda r: (-n[r], words[r]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    of, other = np.concatenate((i, j)), np.concatenate((j, i))
    near, least = np.bincount(of, minlength=len(words)), np.full(len(words), len(words))
    np.minimum.at(least, of, rank[other])
    rows = np.flatnonzero(near)
    best = [order[r] for r in least[rows]]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[r] for r in rows], pa.string()), pa.array(near[rows], pa.int64()), pa.array([n[r] for r in best], pa.int64()), pa.array([words[r] for r in best], pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def _merge(batches):
    """Near words of whole shards, which come sorted by (m, a, b, shard) and never in two tasks."""

    def work(table: pa.Table):
        d = table.to_pydict()
        words, m, a, b = d["word"], d["m"][0], d["a"][0], d["b"][0]
        # shards by what lies outside, not by its hash
        number: dict = {}
        shard = np.array([number.setdefault(w[:a] + "\0" + w[b - s :], len(number)) for w, s in zip(words, d["short"], strict=True)], np.int64)
        i, j = near_pairs(words, m, a, b, np.array(d["short"]), shard)
        if len(i):
            yield _summed(words, d["n"], i, j)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        if not table.num_rows:
            held = []
            continue
        keys = np.stack([table.column(c).to_numpy() for c in ("m", "a", "b", "shard")])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        kind = (keys[:3, 1:] != keys[:3, :-1]).any(0)
        start, places = 0, np.append(new, table.num_rows)
        for k in range(len(new)):  # the last shard may go on in the next batch
            at, then = places[k], places[k + 1]
            width = max(1, int(keys[2, start] - keys[1, start]))
            if kind[at - 1] or (then - start) * width > CELLS:
                yield from work(table.slice(start, at - start))
                start = at
        held = table.slice(start).combine_chunks().to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def near_words(words: DataFrame, most: int = 512) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones; best: that of the largest n, the first by code points of equal ones."""
    rows = shards(words, most)
    # words that are alone in their shard have no one to meet; equal shards share a task
    dealt = rows.repartition("shard").sortWithinPartitions("m", "a", "b", "shard")
    found = dealt.mapInArrow(_merge, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("best")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f"))
    return found.select("word", "n_near", (-F.col("f.down")).alias("best_n"), F.col("f.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms are followed to the last by pointer doubling. There must be no circle."""
    current = stash(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stash(current.join(on, "root", "left"), "variants-roots")
        more = moved.filter("further IS NOT NULL").isEmpty()
        current = moved.select("word", F.coalesce("further", "root").alias("root"))
        if more:
            return current


def spelling_variants(
    docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, every: int | None = 31, most: int = 512, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word. Its form is its near word of largest n, if that is `ratio` times its own n or more, else
    null; its root is where forms lead from it."""
    words = stash(word_counts(docs, min_length, min_count, every, key, text), "variants-words")
    near = words.join(near_words(words, most), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    near = stash(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "variants-near")
    led = roots(near.filter("form IS NOT NULL"))
    return near.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
