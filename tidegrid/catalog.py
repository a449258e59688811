"""The registered queries of the point and grid engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegrid import catalog_io, catalog_shapes, registry
from tidegrid.functions.grid import GridSpec, age_weight, beam_uncertainty, ensure_schema
from tidegrid.operators import filters, rasters, stacks, surfaces
from tidegrid.plans import chains
from tidegrid.plans.fixtures import GRID, REGION, beams, datasets, points, raster, reference, with_sql
from tidegrid.functions.grid import Region
from tidegrid.sources.readers import cells_to_points, vertices

FLAGSHIP = "simple_stack_global"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_SMALL = Region(2.0, 10.0, 3.0, 12.0)


def _add(name: str, query: Callable, sql: str | None = None) -> None:
    query.__name__ = name
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` decimals, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on_points(name: str, f: Callable[[DataFrame], DataFrame], names: str, body: str, keep=("seq", "classification")) -> None:
    _add(name, lambda spark, sf: _rounded(f(points(spark, sf)).select(*keep)), with_sql(names, body))


def _class(flag: str, src: str = "p", more: str = "") -> str:
    return f"SELECT seq, CASE WHEN {flag} THEN 7 ELSE classification END AS classification FROM {src} {more}"


# point schema and filters
_add(
    "schema_ensure",
    lambda spark, sf: _rounded(ensure_schema(points(spark, sf), 2.0, 0.5).select("seq", "w", "u", "classification", "confidence")),
    with_sql("p", "SELECT seq, w*2 AS w, round(sqrt(u*u + 0.25), 6) AS u, classification, CAST(1 AS SMALLINT) AS confidence FROM p"),
)
_on_points("crop_hard", lambda p: filters.spatial_crop(p, _SMALL), "p", "SELECT seq, classification FROM p WHERE x BETWEEN 2 AND 10 AND y BETWEEN 3 AND 12")
_on_points("crop_soft", lambda p: filters.spatial_crop(p, _SMALL, soft=True), "p", _class("NOT (x BETWEEN 2 AND 10 AND y BETWEEN 3 AND 12)"))
_on_points("range_z", lambda p: filters.range_z(p, -100, 100), "p", _class("z < -100 OR z > 100"))
_on_points("range_z_exclude_invert", lambda p: filters.range_z(p, -100, 100, exclude=(2, 29), invert=True), "p", _class("NOT (z < -100 OR z > 100) AND classification NOT IN (2, 29)"))
_on_points("drop_class", lambda p: filters.drop_class(p, "7/12"), "p", "SELECT seq, classification FROM p WHERE classification NOT IN (7, 12)")
_on_points("drop_class_invert", lambda p: filters.drop_class(p, "7/12", invert=True), "p", "SELECT seq, classification FROM p WHERE classification IN (7, 12)")
_on_points(
    "outlierz", lambda p: filters.outlierz(p, 1.5), "p",
    _class("n >= 3 AND s > 0 AND abs(z - m) > 1.5*s", "p JOIN (SELECT dataset_id, avg(z) m, stddev_pop(z) s, count(*) n FROM p GROUP BY dataset_id) USING (dataset_id)"),
)
_BLOCK = "(SELECT *, row_number() OVER (PARTITION BY floor({x}/2), floor({y}/2) ORDER BY {o}) AS r FROM p)"
_on_points("block_minmax_soft", lambda p: filters.block_minmax(p, 2.0), "p", _class("r > 1", _BLOCK.format(x="x", y="y", o="z, seq")))
_on_points("block_minmax_hard", lambda p: filters.block_minmax(p, 2.0, "max", soft=False), "p", "SELECT seq, classification FROM " + _BLOCK.format(x="x", y="y", o="-z, seq") + " WHERE r = 1")
_LOW = {"x": "(x - (SELECT min(x) FROM p))", "y": "(y - (SELECT min(y) FROM p))"}
_on_points("block_thin", lambda p: filters.block_thin(p, 2.0), "p", _class("r > 1", _BLOCK.format(o="z, seq", **_LOW)))
_on_points("block_thin_first", lambda p: filters.block_thin(p, 2.0, "first", soft=False), "p", "SELECT seq, classification FROM " + _BLOCK.format(o="seq", **_LOW) + " WHERE r = 1")
_on_points(
    "coplanarz", lambda p: filters.coplanarz(p, 0.25, 100.0), "p",
    """, m AS (SELECT a.seq AS s, b.x - a.x AS dx, b.y - a.y AS dy, b.z FROM p a JOIN p b ON b.x BETWEEN a.x - 0.25 AND a.x + 0.25
      AND b.y BETWEEN a.y - 0.25 AND a.y + 0.25 AND (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) <= 0.0625),
    t AS (SELECT s, count(*) AS n, sum(dx) sx, sum(dy) sy, sum(z) sz, sum(dx*dx) sxx, sum(dx*dy) sxy, sum(dy*dy) syy, sum(dx*z) sxz, sum(dy*z) syz FROM m GROUP BY s),
    f AS (SELECT s AS seq, n, n*(sxx*syy-sxy*sxy) - sx*(sx*syy-sxy*sy) + sy*(sx*sxy-sxx*sy) AS det,
      sz*(sxx*syy-sxy*sxy) - sx*(sxz*syy-sxy*syz) + sy*(sxz*sxy-sxx*syz) AS top FROM t) """
    + _class("coalesce(n < 4 OR abs(z - CASE WHEN abs(det) > 1e-12 THEN top/det END) > 100, false)", "p JOIN f USING (seq)"),
)

# sampling joins
_SAMPLED = "(SELECT p.*, ref_z FROM p LEFT JOIN ref ON CAST(floor(16 - y) AS INT) = ref.row AND CAST(floor(x) AS INT) = ref.col)"


def _sampled(name: str, f: Callable, flag: str) -> None:
    query = lambda spark, sf: f(points(spark, sf), reference(spark, sf)).select("seq", "classification")
    _add(name, query, with_sql("p ref", _class(flag, _SAMPLED)))


_sampled("raster_mask", lambda p, r: filters.raster_mask(p, r, GRID, "ref_z"), "coalesce(ref_z, 0) = 0")
_sampled("raster_mask_invert", lambda p, r: filters.raster_mask(p, r, GRID, "ref_z", invert=True), "coalesce(ref_z, 0) <> 0")
_sampled("diffz", lambda p, r: filters.diffz(p, r, GRID, "ref_z", -100, 50), "NOT coalesce(z - ref_z BETWEEN -100 AND 50, false)")
_sampled("rq_diff", lambda p, r: filters.rq(p, r, GRID, "ref_z", 60.0), "coalesce(abs(z - ref_z) > 60, false)")
_sampled(
    "rq_percent", lambda p, r: filters.rq(p, r, GRID, "ref_z", 80.0, "percent"),
    "coalesce(CASE WHEN ref_z = 0 THEN z <> 0 ELSE abs(z - ref_z)/nullif(abs(ref_z), 0)*100 > 80 END, false)",
)


def _unlike_grids(spark: SparkSession, sf: str):
    """Grids of cells of 1, 2 and 4, of which the second has an offset and the first two do not reach all of the region."""
    p = points(spark, sf)
    two, four = GridSpec(Region(0.5, 10.5, 0.5, 14.5), 2.0, 2.0), GridSpec(REGION, 4.0, 4.0)
    mean = lambda g: g.index(p).groupBy("row", "col").agg(F.avg("z").alias("z"))
    first = reference(spark, sf).filter("row < 9").select("row", "col", F.col("ref_z").alias("z"))
    return [(first, GRID), (mean(two), two), (mean(four).filter("row + col < 5"), four)]


def _mosaic(spark: SparkSession, sf: str, **more):
    return rasters.mosaic(_unlike_grids(spark, sf), GridSpec(Region(1.0, 15.0, 2.0, 16.0), 0.5, 0.5), buffer=0.7, **more)


def _at_centres_sql(source: str, out: str, w: float, n: float, inc: float) -> str:
    """The table `out`: bilinear values of `source` at the places x, y of the table m."""
    return f""", {out} AS (SELECT m.row, m.col, CASE WHEN count(z) = count(*) THEN sum(z * wt) END AS z FROM (SELECT row, col, floor(fy) + i AS r, floor(fx) + j AS c,
      (CASE i WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE j WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS wt
      FROM (SELECT row, col, (x - {w})/{inc} - 0.5 AS fx, ({n} - y)/{inc} - 0.5 AS fy FROM m), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)) m
      LEFT JOIN {source} b ON b.row = r AND b.col = c WHERE wt > 1e-7 GROUP BY m.row, m.col)"""


_MOSAIC = (
    """, m AS (SELECT i // 32 AS row, i % 32 AS col, 0.0 + (i % 32 + 0.5) * 0.5 AS x, 17.0 - (i // 32 + 0.5) * 0.5 AS y FROM range(1024) t(i)),
    g1 AS (SELECT row, col, ref_z AS z FROM ref WHERE row < 9),
    g2 AS (SELECT CAST(floor((14.5 - y)/2) AS INT) AS row, CAST(floor((x - 0.5)/2) AS INT) AS col, avg(z) AS z FROM p WHERE x >= 0.5 AND x < 10.5 AND y > 0.5 AND y <= 14.5 GROUP BY 1, 2),
    g4 AS (SELECT CAST(floor((16 - y)/4) AS INT) AS row, CAST(floor(x/4) AS INT) AS col, avg(z) AS z FROM p WHERE y > 0 GROUP BY 1, 2 HAVING row + col < 5)"""
    + _at_centres_sql("g1", "a1", 0, 16, 1) + _at_centres_sql("g2", "a2", 0.5, 14.5, 2) + _at_centres_sql("g4", "a4", 0, 16, 4)
    + """, mo AS (SELECT CAST(m.row AS INT) AS row, CAST(m.col AS INT) AS col, coalesce(CASE WHEN y >= 0 AND y <= 16 AND x <= 16 THEN a1.z END, CASE WHEN x BETWEEN 0.5 AND 10.5 AND y BETWEEN 0.5 AND 14.5 THEN a2.z END, CASE WHEN y >= 0 AND y <= 16 AND x <= 16 THEN a4.z END) AS z
      FROM m LEFT JOIN a1 USING (row, col) LEFT JOIN a2 USING (row, col) LEFT JOIN a4 USING (row, col))"""
)
_add("mosaic", lambda spark, sf: _rounded(_mosaic(spark, sf)[0]).withColumn("z", F.col("z") + 0.0), with_sql("p ref", _MOSAIC + " SELECT row, col, round(z, 6) + 0.0 AS z FROM mo"))


def _rq_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    surface, grid = _mosaic(spark, sf, fill=lambda c: rasters.fill_idw(c, 3))
    return filters.rq(points(spark, sf), surface, grid, "z", 60.0).select("seq", "classification")


_BOX = [[(3.5, 2.5), (9.5, 2.5), (9.5, 11.5), (3.5, 11.5)], [(5.5, 5.5), (6.5, 5.5), (6.5, 7.5), (5.5, 7.5)]]
_IN_BOX = "(x >= 3.5 AND x < 9.5 AND y >= 2.5 AND y < 11.5 AND NOT (x >= 5.5 AND x < 6.5 AND y >= 5.5 AND y < 7.5))"
_on_points("vector_mask", lambda p: filters.vector_mask(p, [_BOX]), "p", _class(_IN_BOX))
_on_points("vector_mask_invert", lambda p: filters.vector_mask(p, [_BOX], invert=True), "p", _class(f"NOT {_IN_BOX}"))

_add(
    "sample_bilinear",
    lambda spark, sf: _rounded(filters.sample_bilinear(points(spark, sf), reference(spark, sf), GRID, "ref_z")),
    with_sql(
        "p ref",
        """, a AS (SELECT seq, floor(x - 0.5) AS c, floor(16 - y - 0.5) AS r, x - 0.5 - floor(x - 0.5) AS fa, 16 - y - 0.5 - floor(16 - y - 0.5) AS fb FROM p),
        k AS (SELECT seq, CAST(r + dr AS INT) AS row, CAST(c + dc AS INT) AS col, (CASE dr WHEN 1 THEN fb ELSE 1 - fb END) * (CASE dc WHEN 1 THEN fa ELSE 1 - fa END) AS w
          FROM a, (VALUES (0), (1)) i(dr), (VALUES (0), (1)) j(dc))
        SELECT seq, round(CASE WHEN count(ref_z) = count(*) THEN sum(w*ref_z) END, 6) AS ref FROM k LEFT JOIN ref USING (row, col) WHERE w > 0 GROUP BY seq""",
    ),
)
_add(
    "chain_land_surface",
    lambda spark, sf: _rounded(chains.land_surface(points(spark, sf), GRID)),
    with_sql("p g", "SELECT row, col, round(sum(z*w)/sum(w), 6) AS z FROM g WHERE z >= 0.01 AND classification <> 7 GROUP BY row, col"),
)
for _chain, _t, _mode, _flag in (
    ("chain_bare_earth", 50.0, "diff", "abs(z - ref_z) > 50"),
    ("chain_soundings", 60.0, "percent", "CASE WHEN ref_z = 0 THEN z <> 0 ELSE abs(z - ref_z)/nullif(abs(ref_z), 0)*100 > 60 END"),
):
    _add(
        _chain,
        lambda spark, sf, t=_t, mode=_mode: _rounded(chains.checked_surface(points(spark, sf), GRID, reference(spark, sf), "ref_z", t, mode)),
        with_sql("p g ref", f"SELECT row, col, round(sum(z*w)/sum(w), 6) AS z FROM g LEFT JOIN ref USING (row, col) WHERE NOT coalesce({_flag}, false) AND classification <> 7 GROUP BY row, col"),
    )

# beams
_add(
    "beam_uncertainty",
    lambda spark, sf: _rounded(
        beams(spark, sf).groupBy("survey_year").agg(F.sum(beam_uncertainty()).alias("u"), F.sum(age_weight("survey_year")).alias("age"), F.count("*").alias("n")), 4
    ),
    with_sql(
        "b",
        """SELECT survey_year, round(sum(sqrt(pow(0.51*(0.25 + 0.02*abs(z)), 2) + pow(0.005*abs(crosstrack_distance), 2) + pow(0.51*least(14.0, abs(speed - 14)), 2))), 4) AS u,
        round(sum(least(0.99, greatest(0.01, 1 - (2024 - survey_year)/44.0))), 4) AS age, count(*) AS n FROM b GROUP BY survey_year""",
    ),
)
_add(
    "beam_quality",
    lambda spark, sf: filters.beam_quality(beams(spark, sf)).groupBy("l_linenumber").agg(F.count("*").alias("n")),
    with_sql("b", "SELECT l_linenumber, count(*) AS n FROM b WHERE beamflag = 0 AND speed > 2 AND abs(roll) < 10 AND abs(seafloor_grazing_angle) > 20 AND abs(crosstrack_slope) < 50 GROUP BY 1"),
)
_add(
    "clean_percent",
    lambda spark, sf: _rounded(stacks.clean_percent(beams(spark, sf)).select((100 - F.col("percent")).alias("removed"))),
    with_sql("b", "SELECT round(count(*) FILTER (beamflag <> 0) * 100 / count(*), 6) AS removed FROM b"),
)

# grids
_U = "round(sqrt(pow(min_by(u, seq), 2) + {s}), 6) AS uncertainty, count(*) AS count"
_ONE = "round(min_by(w, seq) * count(*), 6) AS weight"
_SPREAD = "pow(stddev_pop(z), 2)"
for _mode, _z, _xy, _w, _s in (
    ("mean", "avg(z)", "avg({})", _ONE, _SPREAD),
    ("min", "min(z)", "min({})", _ONE, "0"),
    ("max", "max(z)", "max({})", _ONE, "0"),
    ("median", "median(z)", "avg({})", _ONE, _SPREAD),
    ("std", "stddev_pop(z)", "avg({})", _ONE, "0"),
    ("var", "var_pop(z)", "avg({})", _ONE, "0"),
    ("sums", "sum(z*w)", "sum({}*w)", "sum(w) AS weight", _SPREAD),
):
    _add(
        f"bin_{_mode}",
        lambda spark, sf, mode=_mode: _rounded(stacks.point_pixels(points(spark, sf), GRID, mode)),
        with_sql("p g", f"SELECT row, col, round({_z}, 6) AS z, round({_xy.format('x')}, 6) AS x, round({_xy.format('y')}, 6) AS y, {_w}, {_U.format(s=_s)} FROM g GROUP BY row, col"),
    )
_add("simple_stack_global", lambda spark, sf: _rounded(stacks.simple_stack(points(spark, sf), GRID)), with_sql("p g", "SELECT row, col, round(sum(z*w)/sum(w), 6) AS z FROM g GROUP BY row, col"))
_add(
    "simple_stack_per_dataset",
    lambda spark, sf: _rounded(stacks.simple_stack(points(spark, sf), GRID, ("dataset_id",))),
    with_sql("p g", "SELECT dataset_id, row, col, round(sum(z*w)/sum(w), 6) AS z FROM g GROUP BY ALL"),
)
_add(
    "flagship_pipeline",
    lambda spark, sf: _rounded(
        stacks.simple_stack(filters.drop_class(filters.range_z(filters.spatial_crop(ensure_schema(points(spark, sf)), _SMALL), -150, 150), "7"), GRID)
    ),
    with_sql("p g", "SELECT row, col, round(sum(z*w)/sum(w), 6) AS z FROM g WHERE x BETWEEN 2 AND 10 AND y BETWEEN 3 AND 12 AND z BETWEEN -150 AND 150 AND classification <> 7 GROUP BY row, col"),
)
_STEPS = [
    ("spatial_crop", {"region": _SMALL}), ("range_z", {"min_z": -150, "max_z": 150}), ("drop_class", {"classes": "7"}), ("simple_stack", {"grid": GRID}),
]
_add("operator_chain", lambda spark, sf: _rounded(registry.chain(points(spark, sf), _STEPS)), _SQL["flagship_pipeline"])
_add(
    "chain_sources",
    lambda spark, sf: _rounded(chains.source_surface([points(spark, sf).filter(F.col("seq") % 2 == i) for i in (0, 1)], GRID, [1.0, 3.0])),
    with_sql("p g", "SELECT row, col, round(sum(z*w*(1 + seq % 2 * 2))/sum(w*(1 + seq % 2 * 2)), 6) AS z FROM g GROUP BY row, col"),
)
_PARTS = """, s AS (SELECT row, col, dataset_id, count(*) AS n, sum(w) AS sw, sum(z*w) AS sz, sum(x*w) AS sx, sum(y*w) AS sy,
  pow(min_by(u, seq), 2) + pow(stddev_pop(z), 2) AS suc2, min(z) AS zmin, max(z) AS zmax FROM g GROUP BY row, col, dataset_id),
k AS (SELECT s.*, ingest_order, sw/n AS wavg FROM s JOIN ds USING (dataset_id)) """
_FINISH = """SELECT row, col, round({}, 6) AS z, CAST(sum(n) AS BIGINT) AS count, round(sum(sw), 6) AS weights, round(sqrt(sum(suc2))/sum(n), 6) AS uncertainty,
  CAST(0 AS DOUBLE) AS src_uncertainty, round(sum(sx)/sum(sw), 6) AS x, round(sum(sy)/sum(sw), 6) AS y FROM {} GROUP BY row, col"""
_TIER = "(SELECT *, CAST(wavg >= 2.25 AS INT) + CAST(wavg >= 2.5 AS INT) AS tier FROM k)"
_FROM = {
    "mean": "k",
    "supercede": "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY wavg DESC, ingest_order) AS r FROM k) WHERE r = 1)",
    "mixed": f"(SELECT * FROM (SELECT *, max(tier) OVER (PARTITION BY row, col) AS top FROM {_TIER}) WHERE tier = top)",
}
for _mode in ("mean", "supercede", "mixed", "min", "max"):
    _body = _FINISH.format("sum(sz)/sum(sw)", _FROM[_mode]) if _mode in _FROM else _FINISH.format(f"{_mode}(z{_mode})", "k")
    _add(
        f"multi_stack_{_mode}",
        lambda spark, sf, mode=_mode: _rounded(stacks.multi_stack(points(spark, sf), datasets(spark), GRID, mode, (2.25, 2.5))),
        with_sql("p g ds", _PARTS + _body),
    )
_add(
    "provenance",
    lambda spark, sf: stacks.provenance(points(spark, sf), datasets(spark), GRID),
    with_sql("p g", "SELECT row, col, bit_or(1::BIGINT << CASE dataset_id WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS mask FROM g GROUP BY row, col"),
)
_add("source_masks", lambda spark, sf: stacks.source_masks(points(spark, sf), GRID), with_sql("p g", "SELECT DISTINCT dataset_id, row, col FROM g"))
_add(
    "stream_inf",
    lambda spark, sf: _rounded(stacks.stream_inf(points(spark, sf))),
    with_sql("p", "SELECT dataset_id, count(*) AS numpts, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, round(min(z), 6) AS zmin, round(max(z), 6) AS zmax FROM p GROUP BY 1"),
)
_add("footprints", lambda spark, sf: stacks.footprints(points(spark, sf), REGION), with_sql("p", "SELECT dataset_id, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM p GROUP BY 1"))
_VOTES = {"F": 5.0, "O": -2.0}
_add(
    "coastline_vote",
    lambda spark, sf: _rounded(stacks.coastline_votes(stacks.simple_stack(points(spark, sf), GRID, ("dataset_id",)), _VOTES)),
    with_sql(
        "p g",
        """, c AS (SELECT dataset_id, row, col, sum(z*w)/sum(w) AS z FROM g GROUP BY ALL), l AS (SELECT dataset_id, min(z) AS low FROM c GROUP BY 1),
        v AS (SELECT c.*, low, CASE dataset_id WHEN 'F' THEN 5.0 WHEN 'O' THEN -2.0 ELSE 0.1 END::DOUBLE AS wt FROM c JOIN l USING (dataset_id)),
        t AS (SELECT row, col, sum(CASE WHEN wt > 0 THEN CASE WHEN z > 0 THEN wt ELSE -wt END WHEN low >= 0 THEN CASE WHEN z > 0 THEN -abs(wt) ELSE 0 END
          ELSE CASE WHEN z > 0 THEN wt ELSE -wt END END) AS vote FROM v GROUP BY row, col)
        SELECT row, col, round(vote, 6) AS vote, CAST(vote > 0 AS INT) AS land FROM t""",
    ),
)
_add(
    "chain_coast",
    lambda spark, sf: _rounded(chains.coast({d: points(spark, sf).filter(F.col("dataset_id") == d) for d in "FOP"}, GRID, _VOTES)),
    _SQL["coastline_vote"],
)
_add(
    "registry_skip",
    lambda spark, sf: stacks.unseen(points(spark, sf), datasets(spark).filter("dataset_id = 'O'")).groupBy("dataset_id").agg(F.count("*").alias("n")),
    with_sql("p", "SELECT dataset_id, count(*) AS n FROM p WHERE dataset_id <> 'O' GROUP BY 1"),
)
_add("iqr_fence", lambda spark, sf: _rounded(stacks.iqr_fences(points(spark, sf))), with_sql("p", ", q AS (SELECT quantile_cont(z, 0.25) lo, quantile_cont(z, 0.75) hi FROM p) SELECT round(lo - 1.5*(hi - lo), 6) AS lower, round(hi + 1.5*(hi - lo), 6) AS upper FROM q"))
_add("band_statistics", lambda spark, sf: _rounded(stacks.band_statistics(raster(spark, sf))), with_sql("r", "SELECT 'z' AS band, round(min(z), 6) AS least, round(max(z), 6) AS greatest, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std FROM r"))
_add("value_frequency", lambda spark, sf: raster(spark, sf, quantised=True).groupBy("z").agg(F.count("*").alias("n")), with_sql("rq", "SELECT z, count(*) AS n FROM rq GROUP BY z"))


# grid to grid
def _shifted(cells: DataFrame) -> DataFrame:
    return cells.filter("(row + col) % 5 <> 0").withColumn("z", F.col("z") * 0.5 + 0.1)


_OTHER = ", o AS (SELECT row, col, z*0.5 + 0.1 AS oz FROM r WHERE (row + col) % 5 <> 0) "
_add("raster_diff_difference", lambda spark, sf: _rounded(rasters.raster_diff(raster(spark, sf), _shifted(raster(spark, sf)), "difference")), with_sql("r", _OTHER + "SELECT row, col, round(z - oz, 6) AS z FROM r LEFT JOIN o USING (row, col)"))
_add("raster_diff_filter", lambda spark, sf: _rounded(rasters.raster_diff(raster(spark, sf), _shifted(raster(spark, sf)), "filter", 0.5)), with_sql("r", _OTHER + "SELECT row, col, round(CASE WHEN coalesce(abs(z - oz) <= 0.5, true) THEN z END, 6) AS z FROM r LEFT JOIN o USING (row, col)"))
_add("raster_cut", lambda spark, sf: _rounded(rasters.raster_cut(raster(spark, sf), (10, 90), (5, 40))), with_sql("r", "SELECT row, col, round(z, 6) AS z FROM r WHERE row BETWEEN 10 AND 90 AND col BETWEEN 5 AND 40"))
_FILLED = ", f AS (SELECT *, coalesce(z, (SELECT avg(z) FROM rv)) AS q FROM rv)"
_GRAD = "(coalesce(lead(q) OVER {0}, q) - coalesce(lag(q) OVER {0}, q)) / (CASE WHEN lag(q) OVER {0} IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(q) OVER {0} IS NULL THEN 0 ELSE 1 END)"
_SLOPE = _FILLED + f", s AS (SELECT row, col, z, {_GRAD.format('a')} AS gx, {_GRAD.format('b')} AS gy FROM f WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row)) "
_add("raster_slope", lambda spark, sf: _rounded(rasters.slope(raster(spark, sf, voids=True))), with_sql("rv", _SLOPE + "SELECT row, col, round(z, 6) AS z, round(sqrt(gx*gx + gy*gy), 6) AS slope FROM s"))
_add("raster_slope_filter", lambda spark, sf: _rounded(rasters.slope_filter(raster(spark, sf, voids=True), 0.02, 0.2)), with_sql("rv", _SLOPE + "SELECT row, col, round(CASE WHEN sqrt(gx*gx + gy*gy) BETWEEN 0.02 AND 0.2 THEN z END, 6) AS z FROM s"))


def _zscore(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(rasters.zscore_filter(raster(spark, sf, voids=True), threshold=1.8))


_MIRROR = """, d AS (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM rv),
  mr AS (SELECT row AS r0, row FROM f UNION SELECT row, -1 - row FROM f WHERE row < 2 UNION SELECT row, 2*nr - 1 - row FROM f, d WHERE row >= nr - 2),
  mc AS (SELECT col AS c0, col FROM f UNION SELECT col, -1 - col FROM f WHERE col < 2 UNION SELECT col, 2*nc - 1 - col FROM f, d WHERE col >= nc - 2),
  x AS (SELECT mr.row, mc.col, f.z, f.q FROM f JOIN mr ON f.row = mr.r0 JOIN mc ON f.col = mc.c0),
  h AS (SELECT *, avg(q) OVER w AS m1, avg(q*q) OVER w AS v1 FROM x WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  v AS (SELECT *, avg(m1) OVER w AS m, avg(v1) OVER w AS v FROM h WINDOW w AS (PARTITION BY col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  t AS (SELECT v.*, sqrt(greatest(v - m*m, 0)) AS sd FROM v, d WHERE row BETWEEN 0 AND nr - 1 AND col BETWEEN 0 AND nc - 1)
  SELECT row, col, round(CASE WHEN abs(q - m)/CASE WHEN sd = 0 THEN 1e-6 ELSE sd END <= 1.8 THEN z END, 6) AS z FROM t"""
_add("raster_zscore", _zscore, with_sql("rv", _FILLED + _MIRROR))
_add("raster_flats", lambda spark, sf: rasters.flats_filter(raster(spark, sf, quantised=True), 3000), with_sql("rq", "SELECT row, col, CASE WHEN count(*) OVER (PARTITION BY z) <= 3000 THEN z END AS z FROM rq"))
_add(
    "raster_flats_auto",
    lambda spark, sf: rasters.flats_filter(raster(spark, sf, quantised=True)),
    with_sql("rq", ", c AS (SELECT z, count(*) AS n FROM rq GROUP BY z), q AS (SELECT quantile_cont(n, 0.01) lo, quantile_cont(n, 0.99) hi FROM c) SELECT row, col, CASE WHEN n <= hi + 1.5*(hi - lo) THEN z END AS z FROM rq JOIN c USING (z), q"),
)


def _morph_sql(first: str, second: str | None) -> str:
    steps, src = "", "(SELECT *, z AS e0 FROM rv)"
    for i, f in enumerate([first] * 2 + [second] * 2 if second else [first] * 2):
        line, order = ("row", "col") if i % 2 == 0 else ("col", "row")
        steps += f", m{i} AS (SELECT *, {f}(e{i}) OVER (PARTITION BY {line} ORDER BY {order} RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e{i + 1} FROM {src})"
        src = f"m{i}"
    return steps + f" SELECT row, col, round(CASE WHEN z IS NOT NULL THEN e{i + 1} END, 6) AS z FROM {src}"


for _op, _pair in {"erosion": ("min", None), "dilation": ("max", None), "opening": ("min", "max"), "closing": ("max", "min")}.items():
    _add(f"raster_morph_{_op}", lambda spark, sf, op=_op: _rounded(rasters.morphology(raster(spark, sf, voids=True), op)), with_sql("rv", _morph_sql(*_pair)))
_DEC = "SELECT CAST(floor(row/4) AS INT) AS row, CAST(floor(col/4) AS INT) AS col, {} FROM {} GROUP BY 1, 2"
_add("decimate", lambda spark, sf: _rounded(rasters.decimate(raster(spark, sf, voids=True), 4)), with_sql("rv", _DEC.format("round(avg(z), 6) AS z", "rv")))


def _stacked(spark: SparkSession, sf: str) -> DataFrame:
    """A raster with counts and weights."""
    cells = raster(spark, sf, voids=True)
    n = F.when(F.col("z").isNull(), 0).otherwise(F.col("row") % 3).cast("bigint")
    return cells.withColumn("count", n).withColumn("weights", (F.col("col") % 7) / 4)


_STACKED = ", k AS (SELECT *, CAST(CASE WHEN z IS NULL THEN 0 ELSE row % 3 END AS BIGINT) AS count, (col % 7)/4 AS weights FROM rv) "
_add("auto_stack_mask", lambda spark, sf: _rounded(rasters.auto_stack_mask(_stacked(spark, sf), 0.75)), with_sql("rv", _STACKED + "SELECT row, col, round(CASE WHEN count > 0 AND weights >= 0.75 THEN z END, 6) AS z FROM k"))
_add(
    "blend_background",
    lambda spark, sf: _rounded(rasters.blend_background(_stacked(spark, sf), rasters.decimate(raster(spark, sf, voids=True), 4), 4, 0.5)),
    with_sql(
        "rv",
        _STACKED + ", c AS (" + _DEC.format("avg(z) AS b", "rv") + """) SELECT k.row, k.col, round(coalesce(z, b), 6) AS z, CASE WHEN z IS NULL AND b IS NOT NULL THEN 1 ELSE count END AS count,
        CASE WHEN z IS NULL AND b IS NOT NULL THEN 0.5 ELSE weights END AS weights FROM k LEFT JOIN c ON CAST(floor(k.row/4) AS INT) = c.row AND CAST(floor(k.col/4) AS INT) = c.col""",
    ),
)
_NEAR = """, n AS (SELECT a.row, a.col, b.row AS r, b.col AS c, b.z, (a.row-b.row)*(a.row-b.row) + (a.col-b.col)*(a.col-b.col) AS d2 FROM rv a JOIN rv b
  ON b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 WHERE a.z IS NULL AND b.z IS NOT NULL),
  e AS (SELECT row, col, {} AS f FROM n WHERE d2 <= 9 GROUP BY row, col) SELECT row, col, round(coalesce(z, f), 6) AS z FROM rv LEFT JOIN e USING (row, col)"""
_add("fill_idw", lambda spark, sf: _rounded(rasters.fill_idw(raster(spark, sf, voids=True), 3)), with_sql("rv", _NEAR.format("sum(z/d2)/sum(1/d2)")))
_add("interp_nearest", lambda spark, sf: _rounded(rasters.interp_nearest(raster(spark, sf, voids=True), 3)), with_sql("rv", _NEAR.format("arg_min(z, {d: d2, r: r, c: c})").replace("{{", "{")))


_QUADRANTS = """, h AS (SELECT row, col, CASE WHEN z IS NOT NULL AND (row * 5 + col * 3) % 11 < 3 THEN z END AS z FROM rv),
  q AS (SELECT a.row, a.col, s, t, arg_min(b.z, {d: (a.row-b.row)*(a.row-b.row) + (a.col-b.col)*(a.col-b.col), r: b.row, c: b.col}) AS v, min((a.row-b.row)*(a.row-b.row) + (a.col-b.col)*(a.col-b.col)) AS d2
    FROM h a JOIN h b ON b.row BETWEEN a.row - 6 AND a.row + 6 AND b.col BETWEEN a.col - 6 AND a.col + 6, (VALUES (1), (-1)) s(s), (VALUES (1), (-1)) t(t)
    WHERE a.z IS NULL AND b.z IS NOT NULL AND (b.row - a.row)*s >= 0 AND (b.col - a.col)*t >= 0 AND (a.row-b.row)*(a.row-b.row) + (a.col-b.col)*(a.col-b.col) <= 42.25 GROUP BY ALL),
  f AS (SELECT row, col, sum(v/sqrt(d2))/sum(1/sqrt(d2)) AS f FROM q GROUP BY row, col), p0 AS (SELECT h.row, h.col, coalesce(z, f) AS z, z IS NULL AND f IS NOT NULL AS fresh FROM h LEFT JOIN f USING (row, col))"""
_PASS = """, p{i} AS (SELECT a.row, a.col, any_value(a.fresh) AS fresh, CASE WHEN any_value(a.fresh) THEN avg(b.z) ELSE any_value(a.z) END AS z
  FROM p{j} a JOIN p{j} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col)"""


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    keep = F.expr("z IS NOT NULL AND (row * 5 + col * 3) % 11 < 3")
    return raster(spark, sf, voids=True).withColumn("z", F.when(keep, F.col("z")))


for _n in (0, 2):
    _add(
        f"fill_quadrants_{_n}",
        lambda spark, sf, n=_n: _rounded(rasters.fill_quadrants(_sparse(spark, sf), 6.5, n)).withColumn("z", F.col("z") + 0.0),
        with_sql("rv", _QUADRANTS + "".join(_PASS.format(i=i + 1, j=i) for i in range(_n)) + f" SELECT row, col, round(z, 6) + 0.0 AS z FROM p{_n}"),
    )


def _idw_sql(src: str, out: str, reach: int, more: str = "") -> str:
    """Tables that end in `out`: `src` with voids from the cells with data within `reach`; `more`: what two cells must meet too."""
    return f""", {out}n AS (SELECT a.row, a.col, sum(b.z/(dr*dr + dc*dc))/sum(1/(dr*dr + dc*dc)) AS f FROM {src} a, range(-{reach}, {reach + 1}) s(dr), range(-{reach}, {reach + 1}) t(dc), {src} b
      WHERE a.z IS NULL AND b.z IS NOT NULL AND dr*dr + dc*dc BETWEEN 1 AND {reach * reach} AND b.row = a.row + dr AND b.col = a.col + dc{more} GROUP BY a.row, a.col),
    {out} AS (SELECT row, col, coalesce(z, f) AS z FROM {src} LEFT JOIN {out}n USING (row, col))"""


def _patched_sql(fine: str, coarse: str, out: str, k: int, weight: float) -> str:
    """Tables that end in `out`: `fine` with voids from the surface `coarse`, k times as coarse."""
    filled = "f.z IS NULL AND c.z IS NOT NULL"
    return f""", {out} AS (SELECT f.row, f.col, coalesce(f.z, c.z) AS z, CASE WHEN {filled} THEN 1 ELSE count END AS count, CASE WHEN {filled} THEN {weight} ELSE weights END AS weights
      FROM {fine} f LEFT JOIN {coarse} c ON CAST(floor(f.row/{k}) AS INT) = c.row AND CAST(floor(f.col/{k}) AS INT) = c.col)"""


def _kernel_sql(t: str) -> str:
    """The cubic convolution kernel at |t| < 2."""
    return f"CASE WHEN abs({t}) <= 1 THEN 1.5*pow(abs({t}), 3) - 2.5*pow(abs({t}), 2) + 1 ELSE -0.5*pow(abs({t}), 3) + 2.5*pow(abs({t}), 2) - 4*abs({t}) + 2 END"


def _convolved_sql(fine: str, coarse: str, out: str, k: int) -> str:
    """The table `out`: cells of `fine` with the value `c` of the cubic convolution of `coarse`, k times as coarse."""
    w = f"({_kernel_sql('fr - c.row')}) * ({_kernel_sql('fc - c.col')})"
    return f""", {out} AS (SELECT f.row, f.col, CASE WHEN sum({w}) >= 0.25 THEN sum({w} * c.z)/sum({w}) END AS c FROM (SELECT row, col, (row + 0.5)/{k} - 0.5 AS fr, (col + 0.5)/{k} - 0.5 AS fc FROM {fine}) f
      JOIN (SELECT * FROM {coarse} WHERE z IS NOT NULL) c ON c.row BETWEEN floor(fr) - 1 AND floor(fr) + 2 AND c.col BETWEEN floor(fc) - 1 AND floor(fc) + 2 GROUP BY f.row, f.col)"""


def _patched_cubic_sql(fine: str, coarse: str, out: str, k: int, weight: float) -> str:
    """As `_patched_sql`, by cubic convolution."""
    filled = "f.z IS NULL AND c IS NOT NULL"
    return _convolved_sql(fine, coarse, f"{out}c", k) + f""", {out} AS (SELECT f.row, f.col, coalesce(f.z, c) AS z, CASE WHEN {filled} THEN 1 ELSE count END AS count, CASE WHEN {filled} THEN {weight} ELSE weights END AS weights
      FROM {fine} f LEFT JOIN {out}c USING (row, col))"""


def _cudem_sql(factors=(9, 3, 1), weights=(0.25, 0.5, 1.0), reach: int = 4, side: str | None = None, patched=_patched_sql) -> str:
    """Tables that end in s1: the multi-resolution fill of k; `side`: what tells a cell of a level apart, from its centre x and y."""
    steps, before = "", None
    for k, w in zip(factors, weights, strict=True):
        steps += f", d{k} AS (SELECT CAST(floor(row/{k}) AS INT) AS row, CAST(floor(col/{k}) AS INT) AS col, avg(z) AS z, ceil(avg(count)) AS count, avg(weights) AS weights FROM k GROUP BY 1, 2)"
        level = f"d{k}"
        if before:
            steps += patched(level, f"s{before}", f"b{k}", before // k, w)
            level = f"b{k}"
        steps += f", m{k} AS (SELECT row, col, CASE WHEN count > 0 AND weights >= {w} THEN z END AS z FROM {level})"
        centre = lambda t: side.replace("x", f"(({t}.col + 0.5)*{k})").replace("y", f"(16 - ({t}.row + 0.5)*{k})")  # noqa: B023, E731
        steps += _idw_sql(f"m{k}", f"s{k}", reach, f" AND ({centre('a')}) = ({centre('b')})" if side and k != factors[-1] else "")
        before = k
    return steps


_add(
    "rq_mosaic",
    _rq_mosaic,
    with_sql(
        "p ref",
        _MOSAIC + _idw_sql("mo", "mf", 3) + """ SELECT seq, CASE WHEN coalesce(abs(p.z - mf.z) > 60, false) THEN 7 ELSE classification END AS classification
        FROM p LEFT JOIN mf ON mf.col = CAST(floor(x/0.5) AS INT) AND mf.row = CAST(floor((17 - y)/0.5) AS INT)""",
    ),
)
_add(
    "ms_cudem_step",
    lambda spark, sf: _rounded(rasters.ms_cudem_step(_stacked(spark, sf), 4, 0.5)),
    with_sql(
        "rv",
        _STACKED.rstrip() + ", d AS (" + _DEC.format("avg(z) AS z", "rv") + ")" + _idw_sql("d", "e", 4) + _patched_sql("k", "e", "b", 4, 0.5)
        + " SELECT row, col, round(z, 6) AS z, CAST(count AS BIGINT) AS count, round(weights, 6) AS weights FROM b",
    ),
)
#: A barrier across the rasters, as a polygon and as a condition on x and y.
_WALL = [[(10.3, 3.2), (40.3, 3.2), (40.3, -60.8), (10.3, -60.8)]]
_IN_WALL = "x > 10.3 AND x < 40.3 AND y < 3.2 AND y > -60.8"
_add(
    "barrier_split",
    lambda spark, sf: _rounded(rasters.by_side(raster(spark, sf, voids=True), GRID, [_WALL], lambda c: rasters.fill_idw(c, 3))),
    with_sql(
        "rv",
        _idw_sql("rv", "t", 3, " AND " + " = ".join("(" + _IN_WALL.replace("x", f"({t}.col + 0.5)").replace("y", f"(16 - ({t}.row + 0.5))") + ")" for t in "ab"))
        + " SELECT row, col, round(z, 6) AS z FROM t",
    ),
)
_HALF = GridSpec(REGION, 2.0, 2.0)
_add(
    "raster_diff_aligned",
    lambda spark, sf: _rounded(rasters.raster_diff(raster(spark, sf), rasters.decimate(raster(spark, sf), 2), "difference", grid=GRID, other_grid=_HALF)),
    with_sql(
        "r",
        ", d AS (" + _DEC.replace("/4", "/2").format("avg(z) AS z", "r") + """), a AS (SELECT row, col, z, (row + 0.5)/2 - 0.5 AS fr, (col + 0.5)/2 - 0.5 AS fc FROM r),
        t AS (SELECT a.row, a.col, any_value(a.z) AS z, CASE WHEN count(d.z) = 4 THEN sum(d.z*(1 - abs(fr - d.row))*(1 - abs(fc - d.col))) END AS o
          FROM a LEFT JOIN d ON d.row IN (floor(fr), floor(fr) + 1) AND d.col IN (floor(fc), floor(fc) + 1) GROUP BY a.row, a.col)
        SELECT row, col, round(z - o, 6) AS z FROM t""",
    ),
)
_add(
    "raster_diff_cubic",
    lambda spark, sf: _rounded(rasters.raster_diff(raster(spark, sf), rasters.decimate(raster(spark, sf, voids=True), 3), "difference", grid=GRID, other_grid=GridSpec(REGION, 3.0, 3.0), method="cubic")).withColumn("z", F.col("z") + 0.0),
    with_sql("r rv", ", d AS (" + _DEC.replace("/4", "/3").format("avg(z) AS z", "rv") + ")" + _convolved_sql("r", "d", "t", 3) + " SELECT row, col, round(z - c, 6) + 0.0 AS z FROM r LEFT JOIN t USING (row, col)"),
)
_add(
    "blend_background_cubic",
    lambda spark, sf: _rounded(rasters.blend_background(_stacked(spark, sf), rasters.decimate(raster(spark, sf, voids=True), 4), 4, 0.5, "cubic")).withColumn("z", F.col("z") + 0.0),
    with_sql("rv", _STACKED.rstrip() + ", d AS (" + _DEC.format("avg(z) AS z", "rv") + ")" + _patched_cubic_sql("k", "d", "b", 4, 0.5) + " SELECT row, col, round(z, 6) + 0.0 AS z, CAST(count AS BIGINT) AS count, round(weights, 6) AS weights FROM b"),
)
_add(
    "raster_diff_nearest",
    lambda spark, sf: _rounded(rasters.raster_diff(raster(spark, sf), rasters.decimate(raster(spark, sf), 2), "difference", grid=GRID, other_grid=_HALF, method="nearest")),
    with_sql("r", "SELECT row, col, round(z - avg(z) OVER (PARTITION BY row // 2, col // 2), 6) AS z FROM r"),
)
_add(
    "raster_points",
    lambda spark, sf: _rounded(cells_to_points(raster(spark, sf, voids=True), GRID)),
    with_sql("rv", "SELECT col + 0.5::DOUBLE AS x, 16 - (row + 0.5)::DOUBLE AS y, round(z, 6) AS z, 1.0::DOUBLE AS w, 0.0::DOUBLE AS u FROM rv WHERE z IS NOT NULL"),
)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """A polygon of each supplier-like point, as GeoJSON, and its vertices."""
    p = points(spark, sf).select("seq", "x", "y", "z")
    ring = F.concat(*[s for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 0)) for s in (F.lit("["), F.col("x") + dx, F.lit(","), F.col("y") + dy, F.lit("],"))])
    shape = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.rtrim(ring, F.lit(",")), F.lit("]]}"))
    features = p.select(shape.alias("geometry"), F.concat(F.lit('{"elevation":'), F.col("seq"), F.lit("}")).alias("properties"))
    return vertices(features).groupBy("z").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


_add("vertices_explode", _features, with_sql("p", "SELECT CAST(seq AS DOUBLE) AS z, CAST(4 AS BIGINT) AS n, 4*x + 2 AS sx, 4*y + 1 AS sy FROM p"))


# surfaces
def _taxi_sql(src: str, out: str, mask: str, name: str, keep: str = "*") -> str:
    """Tables that end in `out`: `src` with the taxicab distance to the nearest cell where `mask` holds."""
    return f""", {out}1 AS (SELECT {keep}, least(col - max(CASE WHEN {mask} THEN col END) OVER a, min(CASE WHEN {mask} THEN col END) OVER b - col) AS _d1 FROM {src}
      WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY row ORDER BY col DESC)),
    {out} AS (SELECT * EXCLUDE (_d1), CAST(least(min(_d1 - row) OVER a + row, min(_d1 + row) OVER b - row) AS INT) AS {name} FROM {out}1
      WINDOW a AS (PARTITION BY col ORDER BY row), b AS (PARTITION BY col ORDER BY row DESC))"""


def _lines_sql(src: str, out: str, z: str) -> str:
    """Tables that end in `out`: `src` with voids of `z` filled along lines as `{z}_new`."""
    ends = ", ".join(
        f"last_value(CASE WHEN {z} IS NOT NULL THEN {order} END IGNORE NULLS) OVER {w} AS {w}p, last_value({z} IGNORE NULLS) OVER {w} AS {w}v"
        for w, order in (("ra", "col"), ("rb", "col"), ("ca", "row"), ("cb", "row"))
    )
    line = lambda a, b, order: f"CASE WHEN {z} IS NULL THEN {a}v + ({b}v - {a}v)*({order} - {a}p)/({b}p - {a}p) END"
    return f""", {out}1 AS (SELECT *, {ends} FROM {src} WINDOW
      ra AS (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), rb AS (PARTITION BY row ORDER BY col DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      ca AS (PARTITION BY col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), cb AS (PARTITION BY col ORDER BY row DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    {out}2 AS (SELECT *, {line("ra", "rb", "col")} AS h, {line("ca", "cb", "row")} AS v, rbp - rap AS hg, cbp - cap AS vg FROM {out}1),
    {out} AS (SELECT * EXCLUDE (h, v, hg, vg, rap, rav, rbp, rbv, cap, cav, cbp, cbv), coalesce({z}, CASE WHEN h IS NULL THEN v WHEN v IS NULL THEN h ELSE (h*vg + v*hg)/(hg + vg) END) AS {z}_new FROM {out}2)"""


def _closed_sql(src: str, out: str, mask: str, name: str) -> str:
    """Tables that end in `out`: `src` with the 8-connected closing of `mask`."""
    steps, last = "", f"(SELECT *, CASE WHEN {mask} THEN 1 ELSE 0 END AS _e0 FROM {src})"
    for i, (f, line, order) in enumerate((("max", "row", "col"), ("max", "col", "row"), ("min", "row", "col"), ("min", "col", "row"))):
        steps += f", {out}{i} AS (SELECT * EXCLUDE (_e{i}), {f}(_e{i}) OVER (PARTITION BY {line} ORDER BY {order} RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS _e{i + 1} FROM {last})"
        last = f"{out}{i}"
    return steps + f", {out} AS (SELECT * EXCLUDE (_e4), _e4 = 1 AS {name} FROM {last})"


_add(
    "taxicab_distance",
    lambda spark, sf: surfaces.taxicab(raster(spark, sf), F.col("z") > 0.3).select("row", "col", "distance"),
    with_sql("r", _taxi_sql("r", "t", "z > 0.3", "distance") + " SELECT row, col, distance FROM t"),
)
_add("interp_linear", lambda spark, sf: _rounded(surfaces.interp(raster(spark, sf, voids=True))), with_sql("rv", _lines_sql("rv", "t", "z") + " SELECT row, col, round(z_new, 6) AS z FROM t"))


def _cubic_sql() -> str:
    """Voids of rv by the cubics through the two knots on either side along row and column, or the line through one on either side."""
    knots, ends, found = "", "", []
    for line, order in (("row", "col"), ("col", "row")):
        w = f"OVER (PARTITION BY {line} ORDER BY {order})"
        sides = ", ".join(f"{{'p': {order}, 'v': z, 'pp': {f}({order}) {w}, 'pv': {f}(z) {w}}} AS {line}_{f}" for f in ("lag", "lead"))
        knots += f", knots_{line} AS (SELECT row, col, {sides} FROM rv WHERE z IS NOT NULL)"
        ends += f", last_value({line}_lag IGNORE NULLS) {w} AS {line}_a, last_value({line}_lead IGNORE NULLS) OVER (PARTITION BY {line} ORDER BY {order} DESC) AS {line}_b"
        a, b = f"{line}_a", f"{line}_b"
        at = [f"{a}.pp", f"{a}.p", f"{b}.p", f"{b}.pp"]
        value = [f"{a}.pv", f"{a}.v", f"{b}.v", f"{b}.pv"]
        cubic = " + ".join(f"{value[i]}" + "".join(f"*({order} - {at[j]})/({at[i]} - {at[j]})" for j in range(4) if j != i) for i in range(4))
        found.append(f"CASE WHEN z IS NULL THEN coalesce({cubic}, {a}.v + ({b}.v - {a}.v)*({order} - {a}.p)/({b}.p - {a}.p)) END AS {line}_z, {b}.p - {a}.p AS {line}_gap")
    return (
        knots + f", ends AS (SELECT row, col, z{ends} FROM rv LEFT JOIN knots_row USING (row, col) LEFT JOIN knots_col USING (row, col)), found AS (SELECT row, col, z, {', '.join(found)} FROM ends)"
        " SELECT row, col, round(coalesce(z, CASE WHEN row_z IS NULL THEN col_z WHEN col_z IS NULL THEN row_z ELSE (row_z*col_gap + col_z*row_gap)/(row_gap + col_gap) END), 6) AS z FROM found"
    )


_add("interp_cubic", lambda spark, sf: _rounded(surfaces.interp(raster(spark, sf, voids=True), "cubic")), with_sql("rv", _cubic_sql()))
_NO_SIGN = " SELECT row, col, round(z, 6) + 0.0 AS z FROM s1"  # no negative zero
_add("ms_cudem", lambda spark, sf: _rounded(surfaces.ms_cudem(_stacked(spark, sf))).withColumn("z", F.col("z") + 0.0), with_sql("rv", _STACKED.rstrip() + _cudem_sql() + _NO_SIGN))
_add(
    "ms_cudem_cubic",
    lambda spark, sf: _rounded(surfaces.ms_cudem(_stacked(spark, sf), **surfaces.cudem_levels(3, (0.75, 0.5), (1, 2)), background="cubic")).withColumn("z", F.col("z") + 0.0),
    with_sql("rv", _STACKED.rstrip() + _cudem_sql((18, 6, 2, 1), (0.125, 0.25, 0.5, 0.75), patched=_patched_cubic_sql) + _NO_SIGN),
)
_add(
    "ms_cudem_barrier",
    lambda spark, sf: _rounded(surfaces.ms_cudem(_stacked(spark, sf), barrier=[_WALL], grid=GRID)).withColumn("z", F.col("z") + 0.0),
    with_sql("rv", _STACKED.rstrip() + _cudem_sql(side=_IN_WALL) + _NO_SIGN),
)
_add(
    "ms_blend",
    lambda spark, sf: _rounded(surfaces.ms_blend(_stacked(spark, sf), 1.25, 2, random_scale=0)),
    with_sql(
        "rv",
        _STACKED + ", f AS (SELECT row, col, z, z IS NOT NULL AND weights >= 1.25 AS fg FROM k)" + _closed_sql("f", "cl", "fg", "core") + _taxi_sql("cl", "far", "core", "dc")
        + _taxi_sql("far", "near", "fg", "df") + ", zo AS (SELECT *, coalesce(z IS NOT NULL AND NOT core AND dc <= 2, false) AS zone FROM near)"
        + ", zi AS (SELECT *, CASE WHEN NOT zone THEN z END AS i FROM zo)" + _lines_sql("zi", "li", "i")
        + """, e AS (SELECT min(df) AS lo, max(df) AS hi FROM zo WHERE zone), q AS (SELECT li.*, CASE WHEN hi > lo THEN (df - lo)/(hi - lo) ELSE 0 END AS t FROM li, e)
        SELECT row, col, round(CASE WHEN zone THEN coalesce((1 - t)*i_new + t*z, z) ELSE z END, 6) AS z FROM q""",
    ),
)
_PATCH = "row BETWEEN 40 AND 90 AND col BETWEEN 8 AND 40"
_add(
    "raster_blend",
    lambda spark, sf: _rounded(surfaces.raster_blend(raster(spark, sf, voids=True), _shifted(raster(spark, sf)).filter(_PATCH), 3, random_scale=0)),
    with_sql(
        "r rv",
        _OTHER + ", f AS (SELECT row, col, rv.z, oz FROM rv LEFT JOIN (SELECT * FROM o WHERE row BETWEEN 40 AND 90 AND col BETWEEN 8 AND 40) USING (row, col))"
        + _closed_sql("f", "cl", "oz IS NOT NULL", "core") + _taxi_sql("cl", "far", "core", "dc") + ", gr AS (SELECT *, coalesce(dc <= 3, false) AS grown FROM far)"
        + _taxi_sql("gr", "ed", "NOT grown", "de") + ", zo AS (SELECT *, grown AND z IS NOT NULL AS zone, coalesce(oz, CASE WHEN NOT grown THEN z END) AS i FROM ed)" + _lines_sql("zo", "li", "i")
        + """, e AS (SELECT min(de) AS lo, max(de) AS hi FROM zo WHERE zone), q AS (SELECT li.*, CASE WHEN hi > lo THEN (de - lo)/(hi - lo) ELSE 0 END AS t FROM li, e)
        SELECT row, col, round(CASE WHEN zone THEN z + coalesce(i_new - z, 0)*t ELSE z END, 6) AS z FROM q""",
    ),
)


def _coast(spark: SparkSession, sf: str) -> DataFrame:
    return stacks.simple_stack(points(spark, sf), GRID)


_LAND = "land AS (SELECT row, col FROM (SELECT row, col, sum(z*w)/sum(w) AS z FROM g GROUP BY row, col) WHERE z < -98)"
_add(
    "polygonize",
    lambda spark, sf: surfaces.polygons(_coast(spark, sf), F.col("z") < -98, GRID),
    with_sql("p g", f", {_LAND}" + """, touch AS (SELECT a.row*100 + a.col AS a, b.row*100 + b.col AS b FROM land a JOIN land b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
      nodes AS (SELECT row*100 + col AS id, row, col FROM land), met AS (SELECT a, count(*) AS n FROM touch GROUP BY a),
      best AS (SELECT id, coalesce((SELECT min(y) FROM reach WHERE x = id), id) AS root FROM nodes)
      SELECT CAST(root // 100 AS BIGINT) * 4294967296 + root % 100 AS label, count(*) AS n_cells, CAST(sum(4 - coalesce(met.n, 0)) AS BIGINT) AS n_sides, count(*)::DOUBLE AS area,
        min(col)::DOUBLE AS w, (max(col) + 1)::DOUBLE AS e, (16 - (max(row) + 1))::DOUBLE AS s, (16 - min(row))::DOUBLE AS n
      FROM best JOIN nodes USING (id) LEFT JOIN met ON met.a = id GROUP BY root""").replace("WITH p", "WITH RECURSIVE p", 1).replace("      nodes AS", "      reach(x, y) AS (SELECT a, b FROM touch UNION SELECT x, b FROM reach JOIN touch ON y = a), nodes AS", 1),
)


_RING = [(13.2, 8.1, 8.1, 13.3), (8.1, 13.3, 2.9, 8.1), (2.9, 8.1, 8.1, 2.8), (8.1, 2.8, 13.2, 8.1)]
_add(
    "coast_patches",
    lambda spark, sf: surfaces.coast_patches(spark.createDataFrame(_RING, "x1 double, y1 double, x2 double, y2 double"), GRID),
    f"""WITH RECURSIVE l(x1, y1, x2, y2) AS (VALUES {", ".join(map(str, _RING))}),
      u AS (SELECT x1::DOUBLE AS u1, 16 - y1::DOUBLE AS v1, x2::DOUBLE AS u2, 16 - y2::DOUBLE AS v2 FROM l), s AS (SELECT *, ceil(greatest(abs(u2 - u1), abs(v2 - v1))*2) AS n FROM u),
      wall AS (SELECT DISTINCT CAST(floor(v1 + (v2 - v1)*i/n) AS INT) AS row, CAST(floor(u1 + (u2 - u1)*i/n) AS INT) AS col FROM s, range(100) t(i) WHERE i <= n),
      land AS (SELECT CAST(i // 16 AS INT) AS row, CAST(i % 16 AS INT) AS col FROM range(256) t(i) EXCEPT SELECT row, col FROM wall),
      touch AS (SELECT a.row*100 + a.col AS a, b.row*100 + b.col AS b FROM land a JOIN land b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
      reach(x, y) AS (SELECT a, b FROM touch UNION SELECT x, b FROM reach JOIN touch ON y = a),
      best AS (SELECT row, col, coalesce((SELECT min(y) FROM reach WHERE x = row*100 + col), row*100 + col) AS root FROM land),
      vote AS (SELECT k > 0 AS on_left, CAST(floor((v1 + v2)/2 - k*2*(u2 - u1)/m) AS INT) AS row, CAST(floor((u1 + u2)/2 + k*2*(v2 - v1)/m) AS INT) AS col
        FROM (SELECT *, sqrt((u2 - u1)*(u2 - u1) + (v2 - v1)*(v2 - v1)) AS m FROM u), (VALUES (1), (-1)) t(k)),
      told AS (SELECT root, avg(CAST(on_left AS INT)) > 0.5 AS land FROM vote JOIN best USING (row, col) GROUP BY root)
      SELECT row, col, CAST(root // 100 AS BIGINT) * 4294967296 + root % 100 AS label, told.land FROM best LEFT JOIN told USING (root)""",
)


def queries() -> dict:
    return _QUERIES | catalog_io.queries() | catalog_shapes.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql.replace(") , ", "), ") for name, sql in (_SQL | catalog_io.oracle_sql(_SQL) | catalog_shapes.oracle_sql()).items()}
