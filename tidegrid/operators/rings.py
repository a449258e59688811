"""Closed rings out of directed edges, and polygons with holes out of rings.

Edges (id, x1, y1, x2, y2) have their inside on the left. Each leads to the edge that begins where it ends. Where there are several, first the one most
to the left, so that parts that touch at a point stay apart; a ring that then passes a point twice is linked anew with the one most
to the right among its own, so that a hole that touches its shell is a ring of its own, and no ring passes a point twice. Rings are ordered by pointer doubling: after k rounds every edge knows the least id among
the 2 ** k edges from it on, and how many lie between it and the ring's first; so the rounds grow with the logarithm of the longest ring, and no
task walks along one. Each round is a written table.

Shells run against the clock and have a positive area, holes the other way. A hole belongs to the smallest shell around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.grid import GridSpec
from tidegrid.functions.shared import stash
from tidegrid.operators.filters import crossings
from tidegrid.operators.surfaces import label_cells

_CELL = ["row", "col"]


def successors(edges: DataFrame, within: str | None = None) -> DataFrame:
    """(id, next) of edges (id, x1, y1, x2, y2): the edge that goes on from each, most to the left; or, of those with the same value of the column `within`,
    most to the right. An edge with none has no row."""
    same = [within] if within else []
    on = edges.select(*same, F.col("id").alias("next"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    met = edges.join(on, [*same, "x2", "y2"])
    ax, ay, bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by) * (-1 if within else 1)
    turn = F.when((ax * by == ay * bx) & (ax * bx + ay * by < 0), F.lit(-10.0)).otherwise(turn)  # back along itself: the last choice
    return met.groupBy("id").agg(F.max_by("next", F.struct(turn, -F.col("next"))).alias("next"))


def ranked(links: DataFrame, label: str = "ring") -> DataFrame:
    """(id, ring, position, length) of closed chains of links (id, next): the least id of the chain, the place after it from 0, and the links of the
    chain. Every id must have one next and be the next of one."""
    # where a jump leads, the least id among those jumped over, and how far away that is
    state = stash(links.select("id", F.col("next").alias("to"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead")), label)
    size = 1
    while True:
        there = state.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("ring").alias("r"), F.col("ahead").alias("h"))
        met = state.join(there, "to")
        less = F.col("r") < F.col("ring")
        moved = met.select(
            "id", F.col("far").alias("to"), F.least("ring", "r").alias("ring"), F.when(less, F.col("h") + size).otherwise(F.col("ahead")).alias("ahead"), less.alias("less")
        )
        state, size = stash(moved, label), size * 2
        if state.filter("less").isEmpty():
            break
    length = state.groupBy("ring").agg(F.count("*").alias("length"))
    out = state.join(length, "ring")
    return out.select("id", "ring", F.when(F.col("ahead") == 0, 0).otherwise(F.col("length") - F.col("ahead")).cast("long").alias("position"), "length")


def _closed(links: DataFrame) -> DataFrame:
    """The links that are on closed chains. Of several that lead to one edge the least id's counts. What leads to an end is found by doubling
    too, so that long open lines take no more rounds than rings."""
    links = stash(links.groupBy("next").agg(F.min("id").alias("id")).select("id", "next"), "links")
    state = links.select("id", F.col("next").alias("to"))
    while True:
        there = state.select(F.col("id").alias("to"), F.col("to").alias("far"))
        moved = stash(state.filter("to IS NOT NULL").join(there, "to", "left").select("id", F.col("far").alias("to"), F.col("far").isNull().alias("ended")), "ends")
        if moved.filter("ended").isEmpty():
            return links.join(moved.select("id"), "id", "left_semi")
        state = moved.filter("NOT ended").select("id", "to")


def link(edges: DataFrame, within: str | None = None) -> DataFrame:
    """`edges` (id, x1, y1, x2, y2, more columns) with ring, position and length; edges that close to no ring are left out. `within`: a column
    that tells connected parts apart, if there is one."""
    if within:
        return edges.join(ranked(_closed(successors(edges, within))), "id")
    found = stash(edges.join(ranked(_closed(successors(edges))), "id"), "linked")
    twice = stash(found.groupBy("ring", "x1", "y1").agg(F.count("*").alias("n")).filter("n > 1").select("ring").distinct(), "twice")
    if twice.isEmpty():
        return found
    again = found.join(twice, "ring", "left_semi").withColumnRenamed("ring", "_part").drop("position", "length")
    again = link(stash(again, "again"), "_part").drop("_part")
    return found.join(twice, "ring", "left_anti").select(*again.columns).unionByName(again)


def ring_shapes(edges: DataFrame, *by: str) -> DataFrame:
    """(ring, n, area, w, e, s, n_edge bounds, x, y of the first corner) of linked edges; `by`: further columns that a ring has one value of."""
    twice = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy("ring", *by).agg(
        F.count("*").alias("n_edges"), (F.sum(twice) / 2).alias("area"), F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"),
        F.min_by("x1", "position").alias("x"), F.min_by("y1", "position").alias("y"),
    )


def nest(edges: DataFrame) -> DataFrame:
    """(ring, shell, area) of linked edges: a shell is its own; a hole's is the smallest shell around its first edge's middle, null without one."""
    shapes = stash(ring_shapes(edges), "rings")
    first = edges.filter("position = 0").select("ring", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    holes = shapes.filter("area < 0").select("ring").join(first, "ring")
    shells = shapes.filter("area > 0").select("ring", F.col("area").alias("size"))
    sides = edges.join(shells.select("ring"), "ring", "left_semi").select(F.col("ring").alias("poly"), "x1", "y1", "x2", "y2")
    # the middle of a hole's edge may lie on its shell only where they share an edge, which rings of one side do not
    around = crossings(holes, sides, "ring").filter("n % 2 = 1").select("ring", F.col("poly").alias("shell"))
    around = around.join(shells.select(F.col("ring").alias("shell"), "size"), "shell")
    best = around.groupBy("ring").agg(F.min_by("shell", F.struct("size", "shell")).alias("shell"))
    own = shapes.filter("area > 0").select("ring", F.col("ring").alias("shell"), "area")
    return own.unionByName(shapes.filter("area < 0").select("ring", "area").join(best, "ring", "left").select("ring", "shell", "area"))


def _number(c: str) -> Column:
    """A coordinate without needless digits."""
    whole = F.col(c).cast("long")
    return F.when(F.col(c) == whole, whole.cast("string")).otherwise(F.col(c).cast("string"))


def wkt(edges: DataFrame, shells: DataFrame) -> DataFrame:
    """(shell, wkt, area, holes) of linked edges and their (ring, shell, area): a POLYGON for each shell, holes by ring. One polygon is one value."""
    point = F.concat_ws(" ", _number("x1"), _number("y1"))
    text = edges.groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("position", point.alias("p")))).alias("ps"))
    text = text.select("ring", F.concat(F.lit("("), F.array_join(F.transform("ps", lambda p: p["p"]), ", "), F.lit(", "), F.col("ps")[0]["p"], F.lit(")")).alias("text"))
    parts = text.join(shells.filter("shell IS NOT NULL"), "ring")
    order = F.struct((F.col("ring") != F.col("shell")).alias("hole"), "ring", "text")
    out = parts.groupBy("shell").agg(F.array_sort(F.collect_list(order)).alias("parts"), F.sum("area").alias("area"), (F.count("*") - 1).alias("holes"))
    return out.select("shell", F.concat(F.lit("POLYGON ("), F.array_join(F.transform("parts", lambda p: p["text"]), ", "), F.lit(")")).alias("wkt"), "area", "holes")


def outline_runs(cells: DataFrame, mask: Column) -> DataFrame:
    """(id, label, i1, j1, i2, j2, next): the outlines of the patches where `mask` holds, as straight runs between lattice points (column line, row line from
    the north), the patch on the left. Runs are found along their own line of the grid, so corners alone are linked."""
    p = label_cells(cells, mask).filter("sides > 0").select(*_CELL, "label")
    # side, the neighbour beyond it, where it begins and ends in (row line, column line)
    four = [("n", -1, 0, (0, 1), (0, 0)), ("w", 0, -1, (0, 0), (1, 0)), ("s", 1, 0, (1, 0), (1, 1)), ("e", 0, 1, (1, 1), (0, 1))]
    sides = [
        F.struct(F.lit(k).alias("side"), (F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"), *[(F.col(c) + d).cast("int").alias(n) for n, c, d in (("j1", "r0", a[0]), ("i1", "c0", a[1]), ("j2", "r0", b[0]), ("i2", "c0", b[1]))])
        for k, (_, dr, dc, a, b) in enumerate(four)
    ]
    each = p.withColumnRenamed("row", "r0").withColumnRenamed("col", "c0").select("label", "r0", "c0", F.inline(F.array(*sides)))
    each = each.join(cells.filter(mask).select(*_CELL), _CELL, "left_anti").drop(*_CELL)
    each = each.withColumn("id", (F.shiftleft(F.col("r0").cast("long"), 31) + F.col("c0")) * 4 + F.col("side")).drop("r0", "c0")
    each = stash(each.select("id", "label", "side", "i1", "j1", "i2", "j2"), "sides")
    # where the next cell along has the same side the way goes straight on: no other side begins there
    line = F.when(F.col("side") % 2 == 0, F.col("j1")).otherwise(F.col("i1"))
    place = F.when(F.col("side") == 0, -F.col("i1")).when(F.col("side") == 1, F.col("j1")).when(F.col("side") == 2, F.col("i1")).otherwise(-F.col("j1"))
    each = each.withColumn("line", line).withColumn("place", place)
    along = Window.partitionBy("side", "line").orderBy("place")
    begins = F.coalesce(F.lag("place").over(along) != F.col("place") - 1, F.lit(True))
    each = each.withColumn("run", F.last(F.when(begins, F.col("id")), True).over(along))
    runs = each.groupBy("run", "label", "side").agg(*[F.min_by(c, "place").alias(c) for c in ("i1", "j1")], *[F.max_by(c, "place").alias(c) for c in ("i2", "j2")])
    return stash(runs.select(F.col("run").alias("id"), "label", "side", "i1", "j1", "i2", "j2"), "runs")


def grid_rings(cells: DataFrame, mask: Column, grid: GridSpec) -> DataFrame:
    """(label, ring, position, length, x1, y1, x2, y2): the outlines of the 4-connected patches where `mask` holds, as rings of straight edges."""
    r = grid.region
    x, y = (lambda i: F.lit(r.w) + F.col(i) * grid.xinc), (lambda j: F.lit(r.n) - F.col(j) * grid.yinc)
    edges = outline_runs(cells, mask).select("id", "label", x("i1").alias("x1"), y("j1").alias("y1"), x("i2").alias("x2"), y("j2").alias("y2"))
    return link(edges, "label")


def patch_polygons(cells: DataFrame, mask: Column, grid: GridSpec) -> DataFrame:
    """(label, wkt, area, holes): a polygon with its holes for each 4-connected patch, whose one shell its holes belong to."""
    edges = stash(grid_rings(cells, mask, grid), "ringed")
    shapes = ring_shapes(edges, "label")
    shells = shapes.filter("area > 0").select("label", F.col("ring").alias("shell"))
    return wkt(edges, shapes.join(shells, "label").select("ring", "shell", "area")).join(shells, "shell").select("label", "wkt", "area", "holes")
