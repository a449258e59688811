"""Grid geometry and the standard point schema as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def parse_resolution(text) -> tuple[float, float]:
    """(x, y) cell size: 'Ns' is N arc seconds, 'a/b' two sizes, else a number."""
    text = str(text)
    if "/" in text:
        a, b = text.split("/")
        return parse_resolution(a)[0], parse_resolution(b)[0]
    size = float(text[:-1]) / 3600 if text.endswith("s") else float(text)
    return size, size


@dataclass(frozen=True)
class Region:
    """Bounds west, east, south, north."""

    w: float
    e: float
    s: float
    n: float

    def buffer(self, by: float) -> Region:
        return Region(self.w - by, self.e + by, self.s - by, self.n + by)

    def union(self, o: Region) -> Region:
        return Region(min(self.w, o.w), max(self.e, o.e), min(self.s, o.s), max(self.n, o.n))

    def intersection(self, o: Region) -> Region | None:
        r = Region(max(self.w, o.w), min(self.e, o.e), max(self.s, o.s), min(self.n, o.n))
        return r if r.w <= r.e and r.s <= r.n else None

    def contains(self, x: str = "x", y: str = "y") -> Column:
        """Closed on all sides."""
        return F.col(x).between(self.w, self.e) & F.col(y).between(self.s, self.n)


@dataclass(frozen=True)
class GridSpec:
    """A region cut into cells of `xinc` by `yinc`; row 0 is the northern edge."""

    region: Region
    xinc: float
    yinc: float

    @classmethod
    def of(cls, region: Region, res) -> GridSpec:
        return cls(region, *parse_resolution(res))

    @staticmethod
    def _count(width: float, inc: float) -> int:
        n = width / inc
        return round(n) if abs(n - round(n)) <= 1e-9 * max(abs(n), 1) else int(n)

    @property
    def cols(self) -> int:
        return self._count(self.region.e - self.region.w, self.xinc)

    @property
    def rows(self) -> int:
        return self._count(self.region.n - self.region.s, self.yinc)

    def col(self, x: str = "x") -> Column:
        return F.floor((F.col(x) - self.region.w) / self.xinc).cast("int")

    def row(self, y: str = "y") -> Column:
        return F.floor((F.lit(self.region.n) - F.col(y)) / self.yinc).cast("int")

    def index(self, points: DataFrame) -> DataFrame:
        """`points` inside the grid with row and col; x at the eastern and y at the southern edge lie outside."""
        p = points.withColumn("row", self.row()).withColumn("col", self.col())
        return p.filter(F.col("row").between(0, self.rows - 1) & F.col("col").between(0, self.cols - 1))

    def centres(self, cells: DataFrame) -> DataFrame:
        """`cells` with the coordinates of their centres."""
        return cells.withColumn("x", F.lit(self.region.w) + (F.col("col") + 0.5) * self.xinc).withColumn(
            "y", F.lit(self.region.n) - (F.col("row") + 0.5) * self.yinc
        )


def ensure_schema(points: DataFrame, weight: float = 1.0, uncertainty: float = 0.0) -> DataFrame:
    """The standard columns w, u, classification, confidence: present ones are scaled or combined, absent ones set."""
    has = set(points.columns)
    w = F.col("w") * weight if "w" in has else F.lit(float(weight))
    if "u" not in has:
        u = F.lit(float(uncertainty))
    else:
        u = F.sqrt(F.col("u") * F.col("u") + uncertainty * uncertainty) if uncertainty > 0 else F.col("u")
    out = points.withColumn("w", w).withColumn("u", u)
    if "classification" not in has:
        out = out.withColumn("classification", F.lit(0))
    return out if "confidence" in has else out.withColumn("confidence", F.lit(1).cast("smallint"))


def beam_uncertainty(speed: str = "speed", z: str = "z", across: str = "crosstrack_distance") -> Column:
    """Sounding uncertainty from depth, distance across the track and speed."""
    depth = F.pow(0.51 * (0.25 + 0.02 * F.abs(F.col(z))), 2)
    way = F.pow(0.51 * F.least(F.lit(14.0), F.abs(F.col(speed) - 14)), 2)
    return F.sqrt(depth + F.pow(0.005 * F.abs(F.col(across)), 2) + way)


def age_weight(year: str, now: int = 2024) -> Column:
    """Weight by survey year; 1 without one."""
    w = F.least(F.lit(0.99), F.greatest(F.lit(0.01), 1 - (now - F.col(year)) / 44))
    return F.coalesce(w, F.lit(1.0))


def mercator(x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """Longitude and latitude in degrees to spherical Mercator metres."""
    r = 6378137.0
    return F.radians(x) * r, F.log(F.tan(F.radians(F.col(y)) / 2 + F.lit(0.7853981633974483))) * r


def projected(points: DataFrame, to: str | int, source: str | int = "geographic") -> DataFrame:
    """`points` with x and y in another system: "geographic" degrees, "mercator" metres, or any that `projections.system` knows."""
    if to == source:
        return points
    plain = {"mercator": mercator, "geographic": geographic}
    if to in plain and source in plain:
        x, y = plain[to]()
        return points.withColumns({"x": x, "y": y})
    from tidegrid.functions.projections import moved

    return moved(points, to, source)


def geographic(x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """Spherical Mercator metres to degrees."""
    r = 6378137.0
    return F.degrees(F.col(x) / r), F.degrees(2 * F.atan(F.exp(F.col(y) / r)) - F.lit(1.5707963267948966))
