"""Exact deduplication by an extendible-hash index on shared files. Main path: DataFrame functions only.

An entry is (hash of the normalised text, sha256, key); its bucket is the leading bits of the hash. The directory starts with
one bucket; while any bucket holds more than `capacity` distinct hashes the directory doubles, `step` times a round, and overfull
buckets are split by one more bit each time. There is no last round but that of all 64 bits, where a bucket holds one hash.
A round counts only the hashes of buckets that are still overfull, and writes a page: slots (leading bits) with the bucket
(depth, prefix) that each leads to. A lookup finds its slot in the pages, and with it the bucket whose file rows hold its chain.

Owner tasks process buckets, that is ranges of the hash: they chain the entries of equal hash, a link for each distinct
text. Every entry looks up its link through the directory; without its page it finds none. The members' bytes are compared
within each link, and members of a link that holds different ones (a collision of both hashes) are grouped by their bytes. A hot text is a skewed equi-join of written tables, which AQE splits;
counts are aggregated before they move, and nothing gathers a group.

Null text counts as empty. Texts are equal when identical after lower-casing A-Z. Repeated rows (same key and text) are
members like any other, all with kept = (key = keep_id). A null key is a member and stays only if no other member
has a key. Texts of any length are one entry. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.llm.common import ascii_lower, stash, text_of

_BUCKET = ["depth", "prefix"]


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, norm, hash) of every row."""
    norm = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).select("k", ascii_lower(F.col("t")).alias("norm"))
    return norm.withColumn("hash", F.xxhash64("norm"))


def entries(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, hash, text_sha256) of every row."""
    return normalised(docs, key, text).select("k", "hash", F.sha2("norm", 256).alias("text_sha256"))


def _slot(bits: int):
    """The leading bits of the hash."""
    return F.shiftrightunsigned("hash", 64 - bits)


def directory(hashes: DataFrame, capacity: int, step: int = 12) -> list[tuple[int, DataFrame]]:
    """Pages (bits, table of slot, depth, prefix) of the directory over distinct `hashes`; each is a written table. The
    slots of buckets that one page leaves overfull are in the next one, so every hash is in one page."""
    pages, overfull, done = [], None, 0
    while True:
        bits = min(done + step, 64)
        some = hashes if overfull is None else hashes.withColumn("open", _slot(done)).join(overfull, "open", "left_semi")
        counts = some.groupBy(_slot(bits).alias("slot")).agg(F.count("*").alias("n"))
        at = counts.select("n", "slot", F.explode(F.sequence(F.lit(done), F.lit(bits))).alias("depth"))
        sizes = at.groupBy("depth", F.expr(f"shiftrightunsigned(slot, {bits} - depth)").alias("prefix")).agg(F.sum("n").alias("held"))
        sizes = stash(sizes, "directory-sizes")
        parents = sizes.filter(F.col("held") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        # splitting ends at the first depth that fits; a bucket that fits nowhere in this round stays open
        split = sizes.withColumn("above", F.shiftrightunsigned("prefix", 1)).join(parents, ["depth", "above"], "left_semi")
        leaves = sizes.filter(F.col("depth") == done).unionByName(split.drop("above"))
        fits = leaves.filter(F.col("held") <= capacity)
        width = F.expr(f"shiftleft(1L, {bits} - depth)")
        page = fits.select("depth", "prefix", F.explode(F.sequence(F.lit(0).cast("long"), width - 1)).alias("i"))
        page = page.select((F.expr(f"shiftleft(prefix, {bits} - depth)") + F.col("i")).alias("slot"), "depth", "prefix")
        pages.append((bits, stash(page, "directory-page")))
        overfull = stash(leaves.filter((F.col("held") > capacity) & (F.col("depth") == bits)).select(F.col("prefix").alias("open")), "directory-open")
        if overfull.isEmpty():
            return pages
        done = bits


def route(rows: DataFrame, pages: list[tuple[int, DataFrame]]) -> DataFrame:
    """`rows` (with `hash`) and the bucket (depth, prefix) that the directory has for it; rows without a page are lost."""
    if len(pages) == 1:
        bits, page = pages[0]
        return rows.withColumn("slot", _slot(bits)).join(page, "slot").drop("slot")
    slots = F.explode(F.array(*[F.struct(F.lit(bits).alias("bits"), _slot(bits).alias("slot")) for bits, _ in pages]))
    whole = pages[0][1].withColumn("bits", F.lit(pages[0][0]))
    for bits, page in pages[1:]:
        whole = whole.unionByName(page.withColumn("bits", F.lit(bits)))
    return rows.withColumn("at", slots).select("*", "at.bits", "at.slot").drop("at").join(whole, ["bits", "slot"]).drop("bits", "slot")


def build_index(all_entries: DataFrame, capacity: int = 2_000, step: int = 12) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(index, pages). The index is a written table: (depth, prefix, hash, link, links, text_sha256, head, n), a row per distinct
    text; link: its place in the chain of its hash, of `links` places; n: rows with that text; head: their largest key."""
    links = all_entries.groupBy("hash", "text_sha256").agg(F.max("k").alias("head"), F.count("*").alias("n"))
    links = stash(links, "hash-links")
    pages = directory(links.select("hash").distinct(), capacity, step)
    owned = route(links, pages).repartition(*_BUCKET)
    chain = Window.partitionBy(*_BUCKET, "hash")
    owned = owned.withColumn("link", F.row_number().over(chain.orderBy("text_sha256"))).withColumn("links", F.count("*").over(chain))
    return stash(owned.select(*_BUCKET, "hash", "link", "links", "text_sha256", "head", "n"), "hash-index"), pages


def lookup(known: DataFrame, index: DataFrame, pages: list[tuple[int, DataFrame]]) -> DataFrame:
    """Entries with keep_id and group_size of their link, found through the directory."""
    found = index.select(*_BUCKET, "hash", "text_sha256", F.col("head").alias("keep_id"), F.col("n").alias("group_size"))
    return route(known, pages).join(found, [*_BUCKET, "hash", "text_sha256"]).drop(*_BUCKET)


def exact_dups(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2_000, step: int = 12) -> DataFrame:
    """One row per input row: (key, keep_id, group_size, kept, text_sha256)."""
    known = stash(entries(docs, key, text), "hash-entries")
    index, pages = build_index(known, capacity, step)
    both = ["hash", "text_sha256"]
    several = index.filter("n > 1").select(*both, "links")
    # the second digest is worked out again only where a chain has several links
    same = (F.col("links") == 1) | (F.sha2("norm", 256) == F.col("text_sha256"))
    members = stash(normalised(docs, key, text).join(several, "hash").filter(same).drop("links"), "hash-members")
    # all members of a link have the same bytes if the least and the greatest have; a hot link is compared in part before it moves
    ends = members.groupBy(*both).agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    split = stash(ends.filter("least <> greatest").select(*both), "hash-collisions")
    out = lookup(known, index, pages)
    if not split.isEmpty():
        again = members.join(split, both)
        groups = again.groupBy(*both, "norm").agg(F.max("k").alias("keep_id"), F.count("*").alias("group_size"))
        fixed = again.join(groups, [*both, "norm"]).drop("norm")
        out = out.join(split, both, "left_anti").unionByName(fixed)
    return out.select(
        F.col("k").alias(key), "keep_id", "group_size", F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
