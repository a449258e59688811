"""Land polygons out of coast lines that have the land on their left.

Lines are tables of segments (x1, y1, x2, y2) in walking order, which need not say what line they belong to: segments are joined by their ends. They are cut
at the region. Where a line leaves it, the land's border goes on along the region's, against the clock, to where the next line comes in; so open lines
close to rings, with corners of the region between. Rings nest as shells and holes; a hole that no shell holds lies in land that
fills the region. Lines that end inside the region close to nothing and are left out, as are the ways along the border that led to them.

Places on the border are ordered within short stretches of it, so no task orders all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.grid import Region
from tidegrid.functions.shared import stash
from tidegrid.operators import rings

_EDGE = ["x1", "y1", "x2", "y2"]
#: Stretches of a side of the region.
_STRETCHES = 256


def clip(lines: DataFrame, region: Region) -> DataFrame:
    """Segments (x1, y1, x2, y2) cut at a region, with `enters` and `leaves` where an end lies on its border because of that. Segments along the border
    or outside go."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high = F.lit(0.0), F.lit(1.0)
    for start, d, least, most in ((F.col("x1"), dx, region.w, region.e), (F.col("y1"), dy, region.s, region.n)):
        a, b = F.try_divide(F.lit(least) - start, d), F.try_divide(F.lit(most) - start, d)
        still = d == 0
        within = (start > least) & (start < most)
        low = F.greatest(low, F.when(still, F.when(within, 0.0).otherwise(2.0)).otherwise(F.least(a, b)))
        high = F.least(high, F.when(still, 1.0).otherwise(F.greatest(a, b)))
    at = lines.select(*[F.col(c).cast("double").alias(c) for c in _EDGE]).withColumn("t", low).withColumn("u", high).filter("t < u")
    # an end on the border is one exactly
    snap = lambda v, least, most: F.when(F.abs(v - least) <= 1e-12 * (most - least), least).when(F.abs(v - most) <= 1e-12 * (most - least), most).otherwise(v)
    x = lambda t: snap(F.col("x1") + F.col(t) * dx, region.w, region.e)
    y = lambda t: snap(F.col("y1") + F.col(t) * dy, region.s, region.n)
    cut = at.select(
        F.when(F.col("t") > 0, x("t")).otherwise(F.col("x1")).alias("x1"), F.when(F.col("t") > 0, y("t")).otherwise(F.col("y1")).alias("y1"),
        F.when(F.col("u") < 1, x("u")).otherwise(F.col("x2")).alias("x2"), F.when(F.col("u") < 1, y("u")).otherwise(F.col("y2")).alias("y2"),
    )
    edge = lambda i: F.expr(f"x{i} <= {region.w}D OR x{i} >= {region.e}D OR y{i} <= {region.s}D OR y{i} >= {region.n}D")
    return cut.withColumn("enters", edge(1)).withColumn("leaves", edge(2))


def _along(x: str, y: str, r: Region):
    """The way along the border from its south-western corner, against the clock; a side is 1."""
    a, b = (F.col(x) - r.w) / (r.e - r.w), (F.col(y) - r.s) / (r.n - r.s)
    return F.when(F.col(y) <= r.s, a).when(F.col(x) >= r.e, 1 + b).when(F.col(y) >= r.n, 3 - a).otherwise(4 - b)


def border_ways(cut: DataFrame, region: Region) -> DataFrame:
    """(x1, y1, x2, y2): the parts of the region's border from where lines leave it to where the next one comes in, corner by corner."""
    places = [cut.filter(kind).select(_along(x, y, region).alias("way"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(kind == "enters").alias("comes_in")) for kind, x, y in (("leaves", "x2", "y2"), ("enters", "x1", "y1"))]
    events = stash(places[0].unionByName(places[1]).withColumn("way", F.pmod("way", F.lit(4.0))).withColumn("stretch", F.floor(F.col("way") * _STRETCHES).cast("int")), "border")
    # where a line leaves and another comes in at one point, nothing lies between
    point = F.struct("way", "x", "y", "comes_in")
    order = Window.partitionBy("stretch").orderBy("way", "comes_in")
    first = events.groupBy("stretch").agg(F.min(point).alias("first"))  # a row a stretch at most
    round_ = Window.orderBy("stretch")
    first = first.select("stretch", F.coalesce(F.lead("first").over(round_), F.first("first").over(round_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    found = events.withColumn("next", F.lead(point).over(order)).join(F.broadcast(first), "stretch").withColumn("next", F.coalesce("next", "after"))
    ways = found.filter("NOT comes_in AND next.comes_in").select("way", "x", "y", F.col("next.way").alias("to"), F.col("next.x").alias("tx"), F.col("next.y").alias("ty"))
    ways = ways.withColumn("to", F.when(F.col("to") < F.col("way"), F.col("to") + 4).otherwise(F.col("to")))
    turn = F.floor("way").cast("int") + 1
    between = F.when(turn < F.col("to"), F.sequence(turn, F.ceil("to").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    corners = [(region.w, region.s), (region.e, region.s), (region.e, region.n), (region.w, region.n)]
    table = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    stops = F.concat(F.array(F.struct("x", "y")), F.transform(between, lambda k: F.get(table, k % 4)), F.array(F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"))))
    steps = ways.select(stops.alias("p")).select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("i"))
    at = lambda d, c: F.get("p", F.col("i") + d)[c]
    return steps.select(at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(1, "x").alias("x2"), at(1, "y").alias("y2")).filter("x1 <> x2 OR y1 <> y2")


def land_border(lines: DataFrame, region: Region) -> DataFrame:
    """(id, x1, y1, x2, y2, ring, position, length): the closed border of the land in a region, the land on its left. Where no line runs through the region, it is land if it
    lies to the left of the first line east of it. Without any line there is no land: lines do not say what a region without a coast is."""
    cut = stash(clip(lines, region), "clipped").filter("x1 <> x2 OR y1 <> y2")
    c = [(region.w, region.s), (region.e, region.s), (region.e, region.n), (region.w, region.n)]
    frame = [(*map(float, (*c[i], *c[(i + 1) % 4])), i) for i in range(4)]
    frame = lines.sparkSession.createDataFrame(frame, "x1 double, y1 double, x2 double, y2 double, position long").withColumn("id", F.xxhash64(*_EDGE))
    frame = frame.select("id", *_EDGE, F.lit(-(1 << 62)).cast("long").alias("ring"), "position", F.lit(4).cast("long").alias("length"))
    if cut.isEmpty():
        return frame if _left_of_first(lines, region) else frame.limit(0)
    edges = cut.select(*_EDGE).unionByName(border_ways(cut, region)).distinct().withColumn("id", F.xxhash64(*_EDGE))
    found = stash(rings.link(stash(edges, "coast")), "coast-rings")
    # lakes in land that fills the region
    return found if rings.nest(found).filter("shell IS NULL").isEmpty() else found.unionByName(frame.select(found.columns))


def _left_of_first(lines: DataFrame, region: Region) -> bool:
    """Whether the region lies to the left of the line that comes first east of its western side's middle."""
    x, y = float(region.w), (region.s + region.n) / 2
    at = lines.filter((F.col("y1") > y) != (F.col("y2") > y)).select((F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("at"), (F.col("y2") > F.col("y1")).alias("up"))
    return bool(at.filter(F.col("at") > x).agg(F.min_by("up", "at")).first()[0])  # one row


def land_polygons(lines: DataFrame, region: Region) -> DataFrame:
    """(shell, wkt, area, holes): the land in a region as polygons."""
    border = stash(land_border(lines, region), "land")
    return rings.wkt(border, rings.nest(border))
