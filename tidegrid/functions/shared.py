"""Written tables in the shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the folder given to setCheckpointDir.

    Where neither is set, a local session (one JVM, as in tests) gets a temporary folder; a cluster has no folder that is
    known to be shared, so there it is an error.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    place = place or spark.conf.get("tidegrid.scratch.dir", None)
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("tidegrid.scratch.dir", place)
    return place.rstrip("/")


#: Whether a query's shuffle files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_owners: list[list[str]] = []


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Owns the tables that `stash` writes inside: they are deleted at the end, so results must be used up by then."""
    own: list[str] = []
    _owners.append(own)
    try:
        yield own
    finally:
        _owners.remove(own)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for place in own:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(conf).delete(path, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends here and nothing is computed twice. The write's own shuffle files go at its end,
    not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegrid/{label}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of `edges` (a, b long) as (id, component_id), the smallest id reachable.

    Alternating large-star and small-star joins until nothing changes; each round is a written table. Ids without an edge do not
    occur in the result. A star whose centre has many leaves is a skewed join, which AQE splits.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = stash(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label
    )
    before = state(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: every a keeps its least smaller neighbour; the others are hung below that one
        centre = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(centre, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.union(centre.select("a", F.col("m").alias("b"))).distinct()
        current = stash(small, label)
        now = state(current)
        if now == before:
            break
        before = now
    leaves = current.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return leaves.union(current.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
