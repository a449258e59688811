"""Input tables of the registered queries, derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.functions.grid import GridSpec, Region

REGION = Region(0.0, 16.0, 0.0, 16.0)
GRID = GridSpec(REGION, 1.0, 1.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_POINTS = """o_orderkey AS seq, o_orderstatus AS dataset_id,
  CAST((o_orderkey*7919) % 4096 AS DOUBLE)/256 AS x, CAST((o_orderkey*104729 + o_custkey*31) % 4096 AS DOUBLE)/256 AS y,
  o_totalprice/1000 - 250 AS z, CAST(1 + o_orderkey % 4 AS DOUBLE) AS w, CAST(o_custkey % 8 AS DOUBLE)/8 AS u,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 7 WHEN 3 THEN 12 ELSE 29 END AS INT) AS classification"""
_REF = """CAST(floor(o_orderkey/16.0) AS INT) AS row, CAST(o_orderkey % 16 AS INT) AS col, CAST((o_orderkey*37) % 500 AS DOUBLE) - 250 AS ref_z"""
_BEAMS = """l_orderkey, l_linenumber, -l_quantity AS z, l_extendedprice/1000 - 50 AS crosstrack_distance,
  CAST(l_linenumber*3 AS DOUBLE) AS speed, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS beamflag, l_tax*150 AS roll,
  CAST(l_partkey % 90 AS DOUBLE) AS seafloor_grazing_angle, CAST(l_suppkey % 70 AS DOUBLE) AS crosstrack_slope,
  CAST(1980 + l_partkey % 45 AS INT) AS survey_year"""
DATASETS = [("F", "survey_a", 0, 1.0, 0.0), ("O", "survey_b", 1, 0.5, 0.25), ("P", "survey_c", 2, 2.0, 0.0)]


def points(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_split(_POINTS))


def reference(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderkey < 256 AND o_orderkey % 7 <> 0").selectExpr(*_split(_REF))


def beams(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_split(_BEAMS))


def datasets(spark) -> DataFrame:
    return spark.createDataFrame(DATASETS, "dataset_id string, module string, ingest_order int, module_weight double, module_unc double")


def raster(spark, sf_dir, voids: bool = False, quantised: bool = False) -> DataFrame:
    """Cells of the embedding matrix; with voids z is null in some."""
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "z"))
    z = F.col("z").cast("double")
    z = F.floor(z * 8).cast("double") if quantised else z
    z = F.when((F.col("row") * 7 + F.col("col")) % 13 != 0, z) if voids else z
    return cells.select("row", "col", z.alias("z"))


def _split(select: str) -> list[str]:
    """Expressions of a select list; commas inside parentheses do not part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[start:i])
            start = i + 1
    return [*out, select[start:]]


_CELLS = """SELECT CAST(vec_id AS INT) AS row, CAST(pos AS INT) AS col, CAST(v AS DOUBLE) AS z
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""
#: Common table expressions of the fixtures for DuckDB.
SQL = {
    "p": f"p AS (SELECT {_POINTS} FROM orders)",
    "g": "g AS (SELECT * FROM (SELECT *, CAST(floor(x) AS INT) AS col, CAST(floor(16 - y) AS INT) AS row FROM p) WHERE row BETWEEN 0 AND 15 AND col BETWEEN 0 AND 15)",
    "ref": f"ref AS (SELECT {_REF} FROM orders WHERE o_orderkey < 256 AND o_orderkey % 7 <> 0)",
    "b": f"b AS (SELECT {_BEAMS} FROM lineitem)",
    "ds": "ds AS (SELECT * FROM (VALUES ('F','survey_a',0,1.0,0.0),('O','survey_b',1,0.5,0.25),('P','survey_c',2,2.0,0.0)) t(dataset_id, module, ingest_order, module_weight, module_unc))",
    "r": f"r AS ({_CELLS})",
    "rv": f"rv AS (SELECT row, col, CASE WHEN (row*7 + col) % 13 <> 0 THEN z END AS z FROM ({_CELLS}))",
    "rq": f"rq AS (SELECT row, col, floor(z*8) AS z FROM ({_CELLS}))",
}


def with_sql(names: str, body: str) -> str:
    """`body` after the named tables; a body that begins with a comma adds tables of its own."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
