"""N-gram Jaccard join by prefix filters under several global token orders.

Tokens are hashes of `k`-word shingles; a document is its set of them. Sets of size n that reach the similarity share a
token among the first n - ceil(t * n) + 1 of each under any one global order. Candidates must do so under three orders;
the filters are intersected before sets are compared.

1. Frequencies: documents are dealt to groups by a hash of their key; each group sends its distinct tokens with their
   counts, once, as sorted arrays by token range; each range sums the counts over all groups and sends every group its
   tokens' frequency classes back. So the frequencies cover all documents, and a token in every document costs
   no more than one entry a group. A group has no more ranges than documents, so messages grow with the documents; beyond group_docs^2
   documents, groups and ranges both grow with the square root of their number. `UNIT` bytes of text count as a document: groups
   are as bounded in bytes as in documents, but for a single longer text.
2. Prefixes, with the position of each token: rare tokens first, ties by token, by two other hashes for the other two orders. Tokens of one document
   link nothing and are left out; a document with no other token in its prefix has no partner and takes no further part.
   Sets equal in size, sum of hashes and parity map (over 300 bits) are one class with the least key as its representative.
3. Rounds of stars: in every token's list, members of another component than the list's head meet the head only; links
   found join components at once, and the next round takes other heads. Then the rest of each list is joined with itself, so no
   link between components is lost; pairs inside a component need no comparison. The smaller set of a pair is joined only from
   the first n - ceil(2 * t * n / (1 + t)) + 1 of its tokens, behind which no first common token can be, and with sets of its own
   size band and the next; so a token that is frequent in unlike texts, which comes late in each, opens no list. A pair is met at
   its first common token only, and passes only if sizes, positions and parity maps of the two sets allow the similarity.

Null or empty texts, or texts without words, have no token and are alone. Keys are integers. Texts of any length are sets of
all their shingles. Rows that share a key are one node, whose links
are those of any of its texts; null keys are left out of links and get a null component. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm.common import UNIT, components, stash, text_of, volume
from tidegrid.llm.wordhash import mix, shingle_sets

#: Words of 64 bits in a set's parity map.
_WORDS = 4
_BITS = [f"b{i}" for i in range(_WORDS)]
_SEEDS = (0, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)


def _ranges(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2^bits token ranges begins in a sorted array."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(tokens, edges), [len(tokens)]))


def _short(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after a token's range."""
    return (tokens << np.uint64(bits) >> np.uint64(32)).astype(np.uint32) if bits else (tokens >> np.uint64(32)).astype(np.uint32)


def _sets(table: pa.Table, k: int) -> list[np.ndarray]:
    column = table.column("text").combine_chunks()
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [s for c in chunks for s in shingle_sets(c, k)]


def _classes(count: np.ndarray) -> np.ndarray:
    """Frequency class of each count: 0 for one document, then half powers of two."""
    return np.minimum(np.round(2 * np.log2(np.maximum(count, 1))), 255).astype(np.uint8)


def _parity(h: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * _WORDS residues of the hashes: whether an odd number of them has it. Two maps differ in no more
    bits than their sets have tokens that only one of them has."""
    odd = np.bincount((h & np.uint64(64 * _WORDS - 1)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def frequency_classes(grouped: DataFrame, k: int, bits: int) -> DataFrame:
    """(grp, rng, codes binary): classes of the sorted distinct tokens of a group in a range. `grouped`: (grp, k, text)."""

    def local(table: pa.Table) -> pa.Table:
        sets = _sets(table, k)
        tokens, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        cuts = _ranges(tokens, bits)
        short, counts = _short(tokens, bits), np.minimum(counts, 65_535).astype(np.uint16)
        some = [r for r in range(1 << bits) if cuts[r] < cuts[r + 1]]
        return pa.table(
            {
                "grp": pa.array([table.column("grp")[0].as_py()] * len(some), pa.int64()),
                "rng": pa.array(some, pa.int32()),
                "tokens": pa.array([short[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()),
                "counts": pa.array([counts[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()),
            }
        )

    def total(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint32) for x in table.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()])
        names, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        codes = _classes(np.bincount(inverse, weights=counts))[inverse]
        cuts = np.cumsum([0, *map(len, tokens)])
        return pa.table(
            {
                "grp": table.column("grp"),
                "rng": table.column("rng"),
                "codes": pa.array([codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    sent = grouped.groupBy("grp").applyInArrow(local, "grp bigint, rng int, tokens binary, counts binary")
    return sent.groupBy("rng").applyInArrow(total, "grp bigint, rng int, codes binary")


def prefixes(grouped: DataFrame, codes: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """(k, n, sig, lone, b0.., p1, p2, p3 array<bigint>, tokens binary) of every document; the arrays and tokens are empty where
    no partner is possible. lone: tokens before p1, which no other document has; p1 is in order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, ids = _sets(left, k), left.column("k")
        every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        order = np.argsort(right.column("rng").to_numpy())
        blobs = right.column("codes").to_pylist()
        klass = np.frombuffer(b"".join(blobs[i] for i in order), np.uint8)
        n, sig, lones, maps, firsts, raw = [], [], [], [], ([], [], []), []
        with np.errstate(over="ignore"):
            for s in sets:
                n.append(len(s))
                m = mix(s ^ np.uint64(0x6A09E667F3BCC909))
                maps.append(_parity(m))
                sig.append(int((m.sum(dtype=np.uint64) ^ mix(np.array([len(s)], np.uint64))[0]).astype(np.int64)))
                c = klass[np.searchsorted(every, s)]
                size = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                lone = int(np.count_nonzero(c == 0))
                lones.append(lone)
                if lone >= size:
                    for f in firsts:
                        f.append([])
                    raw.append(b"")
                    continue
                shared, rank = s[c > 0], c[c > 0].astype(np.uint64)
                for f, seed in zip(firsts, _SEEDS, strict=True):
                    tie = shared if not seed else mix(shared + np.uint64(seed))
                    take = np.lexsort((tie, rank))[: size - lone]
                    f.append(shared[take].astype(np.int64))
                raw.append(s.tobytes())
        array = pa.list_(pa.int64())
        return pa.table(
            {
                "k": ids,
                "n": pa.array(n, pa.int64()),
                "sig": pa.array(sig, pa.int64()),
                "lone": pa.array(lones, pa.int64()),
                **{b: pa.array([int(x[i]) for x in maps], pa.int64()) for i, b in enumerate(_BITS)},
                **{f"p{i + 1}": pa.array(f, array) for i, f in enumerate(firsts)},
                "tokens": pa.array(raw, pa.binary()),
            }
        )

    maps_schema = ", ".join(f"{b} bigint" for b in _BITS)
    schema = f"k bigint, n bigint, sig bigint, lone bigint, {maps_schema}, p1 array<bigint>, p2 array<bigint>, p3 array<bigint>, tokens binary"
    return grouped.groupBy("grp").cogroup(codes.groupBy("grp")).applyInArrow(run, schema)


def _enough(percent: int):
    """What the rows of a list say of two members (the other's columns end in _): the sizes allow the similarity; so do the
    tokens from the common one on, since if that is the first common token, which every similar pair has in its prefixes,
    no more tokens than these can be common; and their parity maps differ in few enough bits."""
    n, m = F.col("n"), F.col("n_")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    rest = F.least(n - F.col("pos"), m - F.col("pos_"))
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_"))) for b in _BITS[1:]), F.bit_count(F.col("b0").bitwiseXOR(F.col("b0_"))))
    return sizes & ((100 + percent) * rest >= percent * (n + m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def rest_of_lists(lists: DataFrame, own: list[str], percent: int) -> DataFrame:
    """Pairs of the lists' members (k, k_) in different components that may reach the similarity, the smaller set first."""
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")
    opens = (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")
    small = stash(lists.filter(opens).withColumn("band", band), "jaccard-small")
    # a list that no smaller set opens has no pair
    tokens = stash(small.groupBy("tok").agg(F.min("band").alias("lo"), F.max("band").alias("hi")), "jaccard-open-tokens")
    large = lists.join(tokens, "tok").withColumn("band", F.explode(F.array(band, band - 1))).filter("band between lo and hi")
    large = large.select("tok", "band", *[F.col(x).alias(f"{x}_") for x in [*own, "before"]])
    # where the token before is the same too, this is not the first common one, at which the pair is met
    first = F.coalesce(F.col("before") != F.col("before_"), F.lit(True))
    order = (F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("k") < F.col("k_")))
    return small.join(stash(large, "jaccard-large"), ["tok", "band"]).filter((F.col("c") != F.col("c_")) & order & first & _enough(percent))


def dealing(size: int, group_docs: int) -> tuple[int, int]:
    """(groups, bits of a token range) for `size` documents: at most as many messages as documents, and one group's."""
    group_docs = max(group_docs, math.isqrt(size))
    groups = max(1, -(-size // group_docs))
    return groups, max(0, min((groups // 4).bit_length() + 1, group_docs.bit_length() - 1))


def verify(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes also meet under the second and third order, and whose sets reach the similarity."""
    side = lambda x: reps.select(F.col("k").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("p2", "p3", "tokens")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, percent: int = 75, k: int = 5, key: str = "doc_id", text: str = "text", group_docs: int = 1024, star_rounds: int = 2
) -> DataFrame:
    """One row per input row: (key, n_shingles, component_id), the least key reachable by links."""
    rows = docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("text"))
    n, stored = volume(rows)
    size = max(1, n, stored // UNIT)
    groups, bits = dealing(size, group_docs)
    grouped = rows.select(F.pmod(F.xxhash64("k", F.xxhash64("text")), F.lit(groups)).alias("grp"), "k", "text")
    codes = stash(frequency_classes(grouped, k, bits), "jaccard-classes")
    every = stash(prefixes(grouped, codes, k, percent, bits), "jaccard-prefixes")
    # equal sets: one class
    alike = ["sig", "n", *_BITS]
    some = every.filter("n > 0 and k is not null").select("k", *alike)
    least = some.groupBy(*alike).agg(F.min("k").alias("rep"), F.count("*").alias("copies"))
    # written tables: a join with an aggregate in its own stage could not split a hot key
    least = stash(least, "jaccard-least")
    same = some.join(least.filter("copies > 1").select(*alike, "rep"), alike).select(F.col("k").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    reps = every.filter(F.size("p1") > 0).join(least.select(F.col("rep").alias("k"), *alike), ["k", *alike])
    reps = stash(reps.dropDuplicates(["k", *alike]), "jaccard-reps")
    each = F.transform("p1", lambda x, i: F.struct((i + F.col("lone")).alias("pos"), x.alias("tok"), F.get("p1", i - 1).alias("before")))
    lists = reps.select("k", "n", *_BITS, F.inline(each))
    several = lists.groupBy("tok").agg(F.count("*").alias("m")).filter("m > 1").select("tok")
    several = stash(several, "jaccard-several")
    lists = stash(lists.join(several, "tok"), "jaccard-lists")
    own = ["k", "n", "pos", "c", *_BITS]
    links = None
    tried = None
    comp = reps.select("k", F.col("k").alias("c"))
    for turn in range(star_rounds + 1):
        now = lists if turn == 0 else lists.join(comp.withColumnRenamed("c", "c0"), "k", "left").withColumn("c", F.coalesce("c0", "k")).drop("c0")
        now = now.withColumn("c", F.col("k")) if turn == 0 else now
        mixed = now.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("tok")
        mixed = stash(mixed, "jaccard-mixed")
        now = stash(now.join(mixed, "tok"), "jaccard-open")
        if now.isEmpty():
            break
        if turn < star_rounds:
            # the first heads are those with the fewest rare tokens before the common one: they are nearest to the others
            by = F.struct("pos", "k") if not turn else F.struct(F.xxhash64("k", F.lit(turn)), "k")
            heads = now.groupBy("tok").agg(F.min_by(F.struct(*own), by).alias("h"))
            heads = heads.select("tok", *[F.col(f"h.{x}").alias(f"{x}_") for x in own])
            heads = stash(heads, "jaccard-heads")
            pairs = now.join(heads, "tok").filter((F.col("c") != F.col("c_")) & _enough(percent))
        else:
            pairs = rest_of_lists(now, own, percent)
        pairs = pairs.select(F.least("k", "k_").alias("a"), F.greatest("k", "k_").alias("b")).filter("a <> b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stash(pairs, "jaccard-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stash(verify(pairs, reps, percent), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        if turn < star_rounds:
            comp = stash(components(links).select(F.col("id").alias("k"), F.col("component_id").alias("c")), "jaccard-comp")
    edges = same if links is None else same.unionByName(links)
    whole = components(edges).withColumnRenamed("id", "k")
    sizes = every.select("k", "n")
    return sizes.join(whole, "k", "left").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id")
    )


def keep_one(docs: DataFrame, percent: int = 75, k: int = 5, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """`docs` without the near copies: of each component the row with the least key stays. Rows that share a key are one node
    and stay or go together; rows with a null key stay."""
    found = jaccard_components(docs, percent, k, key, text, **more)
    gone = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone, key, "left_anti")
