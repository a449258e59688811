"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Terms are `k`-word shingles of the lower-cased (A-Z) text; a term's weight is 1 + log of its count, in whole parts of 1 / `PARTS`, so that
sums are exact and equal texts have equal fingerprints whatever the machine's order of summation. Each of a term's hash
bits votes with the weight for a one or against it; the sign of the sum is the fingerprint's bit. Several 64-bit hashes of
a term make fingerprints of any multiple of 64 bits. Likeness of two fingerprints: cos(pi * distance / bits), at
least 0, an estimate of the cosine of their term vectors.

Search: with radius r, bits are cut into r + `extra` blocks; two fingerprints within r agree on at least `extra` of them
exactly. A table a choice of `extra` blocks, with those blocks permuted to the front as the key, finds every pair: an
equi-join on a hash of table and key. The tables hold only that hash and a hash of the fingerprint; whole fingerprints
are joined to the distinct candidates, whose distances are then exact. Ids that collide add candidates and lose none. Queries are a stated set of keys, all rows are searched.
Rows with equal fingerprints are one entry with a count, so copies do not multiply candidates.

Null text counts as empty; texts without words have the fingerprint of zeros. Keys are integers. Repeated rows repeat; texts of any
length are hashed whole, a batch of votes at a time; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm.common import UNIT, span_of, stash, text_of, volume, with_next_key
from tidegrid.llm.wordhash import blocks, mix, shingles


#: Parts of 1 in which a term's weight is told.
PARTS = 256
#: Terms whose votes are summed at once; with weights under 16 on average (counts of 3,000,000) the sums are whole numbers below 2^24.
VOTES = 4096


def fingerprints(texts: pa.Array, k: int, bits: int) -> list[bytes]:
    """The fingerprint of each text."""
    out = []
    for _, words, doc, n in blocks(texts):
        h, owner = shingles(words, doc, n, k)
        cuts = np.searchsorted(owner, np.arange(n + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append(_fingerprint(h[a:b], bits))
    return out


def _fingerprint(terms: np.ndarray, bits: int) -> bytes:
    if not len(terms):
        return bytes(bits // 8)
    terms, count = np.unique(terms, return_counts=True)
    weight = np.rint((1 + np.log(count)) * PARTS).astype(np.float32)
    votes = []
    with np.errstate(over="ignore"):
        for j in range(bits // 64):
            total = np.zeros(64)
            for i in range(0, len(terms), VOTES):
                part = mix(terms[i : i + VOTES] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
                total += weight[i : i + VOTES] @ (ones.astype(np.float32) * 2 - 1)
            votes.append(total)
    return np.packbits(np.concatenate(votes) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    bits = 8 * len(a)
    far = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, float(np.cos(np.pi * far / bits)))


def simhash(docs: DataFrame, k: int = 2, bits: int = 128, key: str = "doc_id", text: str = "text", sizes: bool = False) -> DataFrame:
    """(key, fingerprint string of hex digits) of every whole text; with `sizes` also n_chars."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            prints = [f.hex() for f in fingerprints(b.column(1), k, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string()), *b.columns[2:]], names=[key, "fingerprint", *extra])

    extra = ["n_chars"] if sizes else []
    rows = docs.select(key, text_of(text).alias(text), *[F.char_length(text_of(text)).cast("long").alias(n) for n in extra])
    return rows.mapInArrow(run, ", ".join([f"{key} {kind}", "fingerprint string", *[f"{n} bigint" for n in extra]]))


def _distance(a: str, b: str, bits: int):
    """Hamming distance of two hex columns."""
    parts = [
        F.bit_count(F.conv(F.substring(a, i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i, 8), 16, 10).cast("long")))
        for i in range(1, bits // 4, 8)
    ]
    return sum(parts[1:], parts[0])


def near_fingerprints(queries: DataFrame, rows: DataFrame, radius: int = 3, extra: int = 2, bits: int = 128) -> DataFrame:
    """(fingerprint, other, n_rows, distance) for the distinct fingerprints of `queries` and all of `rows` (column
    `fingerprint`) within `radius`, by permuted block tables; n_rows counts the rows that have `other`."""
    count = radius + extra
    digits = bits // 4
    edges = [round(i * digits / count) for i in range(count + 1)]
    tables = list(combinations(range(count), extra))

    def hashed(df, name):
        return df.withColumn(f"{name}_id", F.xxhash64(name))

    def keyed(df, name):
        keys = [
            F.xxhash64(F.lit(t), *[F.substring(name, edges[i] + 1, edges[i + 1] - edges[i]) for i in chosen])
            for t, chosen in enumerate(tables)
        ]
        return df.select(f"{name}_id", F.explode(F.array(*keys)).alias("block_key"))

    every = rows.groupBy("fingerprint").agg(F.count("*").alias("n_rows")).withColumnRenamed("fingerprint", "other")
    every, asked = hashed(every, "other"), hashed(queries.select("fingerprint").distinct(), "fingerprint")
    pairs = keyed(asked, "fingerprint").join(keyed(every, "other"), "block_key").select("fingerprint_id", "other_id").distinct()
    pairs = pairs.join(asked, "fingerprint_id").join(every, "other_id")
    pairs = pairs.withColumn("distance", _distance("fingerprint", "other", bits)).filter(F.col("distance") <= radius)
    return pairs.select("fingerprint", "other", "n_rows", "distance")


def with_edited(docs: DataFrame, k: int = 2, bits: int = 128, group_keys: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document beside its edited text: the last half replaced by the start of the next document (by key).

    (key, n_chars, edited string, fingerprint, edited_fingerprint, near_edited, near_next). Documents meet in blocks of
    consecutive key values, as wide as lets none hold more than 2 * group_keys keys, or fewer where texts have more than `UNIT` bytes
    on average; each block also gets the document that follows it. Rows that share a key
    all precede the next key, and that key's row with the least text follows. Rows of null key have no next document and
    follow none: they keep n_chars and fingerprint, and the other columns are null.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("text")).filter("k is not null")
    n, stored = volume(rows)
    group_keys = max(1, min(group_keys, group_keys * UNIT * n // max(stored, 1)))
    after = with_next_key(rows, "k")
    block = F.shiftright("k", span_of(after, "k", group_keys))
    # the keys that follow a block's last key, with the block that needs them
    last = after.groupBy(block.alias("block")).agg(F.max_by("next_key", "k").alias("k"))
    last = stash(last, "simhash-lent")  # its size is known then: a small one is broadcast and texts need not move
    own = rows.withColumn("block", block).withColumn("lent", F.lit(False))
    lent = rows.join(last, "k").select("k", "text", "block").withColumn("lent", F.lit(True))
    both = own.unionByName(lent)

    def edit(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, texts = group.column("k").to_pylist(), group.column("text").to_pylist()
        lent_to = group.column("lent").to_pylist()
        mine = sorted((i for i in range(len(ids)) if not lent_to[i]), key=lambda i: (ids[i], texts[i]))
        first = {}
        for i in sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])):
            first.setdefault(ids[i], i)
        outside = next((i for i in sorted((i for i in range(len(ids)) if lent_to[i]), key=lambda i: texts[i])), None)
        known = sorted({ids[i] for i in mine})
        follows = dict(zip(known, known[1:], strict=False))
        nexts, edited = [], []
        for i in mine:
            j = first[follows[ids[i]]] if ids[i] in follows else outside
            t, half = texts[i], len(texts[i]) // 2
            nexts.append(j)
            edited.append(t[: len(t) - half] + texts[j][:half])
        prints = fingerprints(pa.array(texts, pa.large_string()), k, bits)
        made = fingerprints(pa.array(edited, pa.large_string()), k, bits)
        return pa.table(
            {
                key: pa.array([ids[i] for i in mine], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in mine], pa.int64()),
                "edited": pa.array(edited, pa.string()),
                "fingerprint": pa.array([prints[i].hex() for i in mine], pa.string()),
                "edited_fingerprint": pa.array([m.hex() for m in made], pa.string()),
                "near_edited": pa.array([likeness(prints[i], m) for i, m in zip(mine, made, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(prints[i], prints[j]) for i, j in zip(mine, nexts, strict=True)], pa.float64()),
            }
        )

    out = both.groupBy("block").applyInArrow(edit, schema).withColumn(key, F.col(key).cast(kind))
    loose = simhash(docs.filter(F.col(key).cast("long").isNull()), k, bits, key, text, sizes=True)
    return out.unionByName(loose, allowMissingColumns=True)
