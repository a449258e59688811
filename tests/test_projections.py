"""Coordinate systems at published control points, there and back."""

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import projections as P
from tidegrid.functions.grid import projected
from tidegrid.sources import readers

FOOT = 1200 / 3937
#: fixed values: worked examples of the guidance note on coordinate conversions: system, longitude, latitude, x, y
CONTROL = [
    (P.System("tm", "Airy1830", -2.0, 49.0, (), 0.9996013, 400000.0, -100000.0), 0.5, 50.5, 577274.99, 69740.50),
    (P.System("lambert", "Clarke1866", -99.0, 27 + 50 / 60, (28 + 23 / 60, 30 + 17 / 60), 1.0, 2000000.0 * FOOT, 0.0, FOOT), -96.0, 28.5, 2963503.91, 254759.80),
    (P.System("polar", "WGS84", 0.0, 90.0, (), 0.994, 2000000.0, 2000000.0), 44.0, 73.0, 3320416.75, 632668.43),
    (P.System("polar", "WGS84", 70.0, -71.0, (), 1.0, 6000000.0, 6000000.0), 120.0, -75.0, 7255380.79, 7053389.56),
]


@pytest.mark.parametrize("at", CONTROL)
def test_control_points(spark, at):
    s, lon, lat, x, y = at
    one = spark.createDataFrame([(lon, lat)], "x double, y double")
    r = P.moved(one, s).first()
    assert (r["x"], r["y"]) == pytest.approx((x, y), abs=0.006)  # they are published to the centimetre
    back = P.moved(P.moved(one, s), "geographic", s).first()
    assert (back["x"], back["y"]) == pytest.approx((lon, lat), abs=1e-9)


def test_a_shift_of_seven_parameters(spark):
    x, y, z = (F.lit(v) for v in (3657660.66, 255768.55, 5201382.11))
    shift = (0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219)
    to = P.shifted(x, y, z, shift)
    r = spark.range(1).select(*to, *P.shifted(*to, shift, back=True)).first()
    assert r[:3] == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.006) and r[3:] == pytest.approx((3657660.66, 255768.55, 5201382.11), abs=1e-6)


def test_geocentric_round_trip(spark):
    el = P.Ellipsoid.of("GRS80")
    rows = [(float(a), float(b), h) for a in (-170, -3, 0, 91) for b in (-89, -45, 0, 12, 80) for h in (-500.0, 0.0, 4000.0)]
    df = spark.createDataFrame(rows, "a double, b double, h double")
    for r in df.select("*", *[c.alias(n) for n, c in zip("xyz", P.from_geocentric(*P.geocentric(F.col("a"), F.col("b"), F.col("h"), el), el), strict=True)]).collect():
        assert (r["x"], r["y"]) == pytest.approx((r["a"], r["b"]), abs=1e-10) and r["z"] == pytest.approx(r["h"], abs=1e-5)


PLACES = {32631: (3.7, 51.2), 32733: (17.0, -33.9), 26918: (-75.1, 40.2), 25832: (8.5, 47.4), 2154: (2.3, 48.8), 3034: (11.0, 46.0), 3347: (-75.7, 45.4), 3031: (-120.0, -78.0), 3413: (20.0, 79.0), 27700: (-1.5, 53.0), 31467: (9.2, 48.8), 3857: (100.0, -60.0)}


@pytest.mark.parametrize("code", sorted(PLACES))
def test_round_trips_of_all_codes(spark, code):
    lon, lat = PLACES[code]
    rows = [(lon + i / 3, lat + j / 3) for i in range(-2, 3) for j in range(-2, 3)]
    there = projected(spark.createDataFrame(rows, "x double, y double").withColumns({"ox": F.col("x"), "oy": F.col("y")}), f"EPSG:{code}")
    for r in projected(there.withColumns({"mx": F.col("x"), "my": F.col("y")}), "geographic", f"EPSG:{code}").collect():
        assert (r["x"], r["y"]) == pytest.approx((r["ox"], r["oy"]), abs=3e-8 if P.system(code).shift else 2e-9)
        assert abs(r["mx"] - r["ox"]) > 1000  # metres, not degrees


def test_well_known_places(spark):
    """The tower in Greenwich's longitude and latitude of the British grid differs from WGS 84 by its datum; false origins give round numbers."""
    one = lambda x, y, to: projected(spark.createDataFrame([(x, y)], "x double, y double"), to).first()
    r = one(9.0, 0.0, 32632)
    assert (r["x"], r["y"]) == pytest.approx((500000, 0), abs=1e-6)
    r = one(15.0, -0.0, 32733)
    assert (r["x"], r["y"]) == pytest.approx((500000, 1e7), abs=1e-6)
    r = one(3.0, 46.5, 2154)
    assert (r["x"], r["y"]) == pytest.approx((700000, 6600000), abs=1e-6)
    with pytest.raises(ValueError):
        P.system("EPSG:99999")


def test_a_source_in_another_system(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("500000 0 5\n")
    r = readers.read_points(spark, str(tmp_path / "a.xyz"), src_srs="EPSG:32632").first()
    assert (r["x"], r["y"], r["z"]) == pytest.approx((9, 0, 5), abs=1e-9)
