"""Helpers that several operators share: written tables, components, texts, next keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.shared import components, shared_dir, stash, written_tables  # noqa: F401


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column):
    """Lower-case A-Z only. `lower` equals it on pure ASCII and is much faster there."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


#: Bytes of text that count as one document where documents are dealt to groups.
UNIT = 8192


def volume(rows: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents, bytes of text) of a table: what groups are sized by, so that long texts make more groups."""
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length(text).cast("long"))).first()
    return n, size or 0


def with_next_key(keys: DataFrame, key: str) -> DataFrame:
    """Distinct integer keys with the next larger one (after the last: the first) as `next_key`, and their `rank` from 0; a
    written table.

    Keys are dealt by range, whatever their values. Windows run inside a range; a range's last key takes the first key of the next
    range that has one. Only the ranges' edges, as many as spark.sql.shuffle.partitions, meet in one window.
    """
    spark = keys.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = keys.select(F.col(key).cast("long").alias("k")).filter("k is not null").distinct()
    dealt = stash(distinct.repartitionByRange(ranges, "k").select("k", F.spark_partition_id().alias("part")), "keys")
    edges = dealt.groupBy("part").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    order = Window.orderBy("part")
    edges = edges.select(
        "part",
        F.coalesce(F.lead("first").over(order), F.min("first").over(order)).alias("after"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    inside = Window.partitionBy("part").orderBy("k")
    found = dealt.select("k", "part", F.lead("k").over(inside).alias("following"), F.row_number().over(inside).alias("n"))
    found = found.join(edges, "part").select(F.col("k").alias(key), F.coalesce("following", "after").alias("next_key"), (F.col("base") + F.col("n") - 1).alias("rank"))
    return stash(found, "next-keys")


def span_of(ranked: DataFrame, key: str, rows: int) -> int:
    """Bits of a block of consecutive key values that holds 2 * `rows` of the distinct keys at most. `ranked`: (key, rank)."""
    first = ranked.groupBy(F.floor(F.col("rank") / rows).alias("b")).agg(F.min(key).cast("double").alias("first"))
    after = first.select((F.col("b") - 1).alias("b"), F.col("first").alias("then"))
    gap = first.join(after, "b").agg(F.min(F.col("then") - F.col("first"))).first()[0]
    return 62 if gap is None else min(62, max(0, int(math.floor(math.log2(gap)))))
