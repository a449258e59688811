"""Grid files: round trips, tiles that are read, foreign layouts, lost tasks."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.grid import GridSpec, Region
from tidegrid.sources import tiff

GRID = GridSpec(Region(100.0, 135.0, 50.0, 74.0), 0.5, 0.5)  # 48 rows, 70 columns


def cells(spark, z, more=None):
    rows = [(r, c, None if np.isnan(v) else float(v), float(r * c)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "row int, col int, z double, weights double")


@pytest.fixture(scope="module")
def surface():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 100, (48, 70))
    z[rng.random(z.shape) < 0.1] = np.nan
    z[0, 0], z[5, 5] = 1e-300, -1e300
    return z


def array(rows, shape, name="z"):
    out = np.full(shape, np.inf)
    for r in rows:
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def test_round_trip_of_bands_and_places(spark, tmp_path, surface):
    path = f"{tmp_path}/grid"
    tiff.write_grid(cells(spark, surface), path, GRID, ("z", "weights"), block=32, tile=16, epsg=4326)
    assert sorted(os.listdir(path)) == sorted(f"r{i}_c{j}.tif" for i in range(2) for j in range(3))
    rows = tiff.read_grid(spark, path, ("z", "weights"), GRID, tiles=2).collect()
    assert len(rows) == 48 * 70
    assert (array(rows, (48, 70)) == surface)[~np.isnan(surface)].all() and (np.isnan(array(rows, (48, 70))) == np.isnan(surface)).all()
    assert all(r["weights"] == r["row"] * r["col"] for r in rows)
    with open(f"{path}/r1_c2.tif", "rb") as f:
        at = tiff.Layout.of(f)
    assert (at.west, at.north, at.xinc, at.width, at.height, at.epsg, at.nodata) == (132.0, 58.0, 0.5, 6, 16, 4326, -9999.0)
    alone = tiff.read_grid(spark, f"{path}/r1_c2.tif").collect()
    assert (array(alone, (16, 6)) == surface[32:, 64:])[~np.isnan(surface[32:, 64:])].all()


def test_only_tiles_of_a_region_are_read(spark, tmp_path, surface):
    path = f"{tmp_path}/grid"
    tiff.write_grid(cells(spark, surface), path, GRID, block=32, tile=16)
    whole = tiff.read_grid(spark, path, grid=GRID, tiles=1)
    assert whole.rdd.getNumPartitions() == 3 * 5
    part = whole.filter("row BETWEEN 20 AND 31 AND col > 15 AND col <= 33")
    assert part.rdd.getNumPartitions() == 2  # a row of tiles, of which two files hold one each
    assert sorted((r["row"], r["col"]) for r in part.collect()) == [(r, c) for r in range(20, 32) for c in range(16, 34)]
    assert whole.filter("row = 47 AND col IN (1, 2)").rdd.getNumPartitions() == 1
    assert whole.filter("row > 48").count() == 0
    assert whole.filter("z > 0").count() == (surface > 0).sum()


def foreign(z, order, dtype, compression=1, predictor=1, strips=None, big=False, together=1, nodata=None):
    """A file of strips in another byte order, type and packing; bands together are z, z + 1, .."""
    h, w = z.shape
    rows = strips or h
    data = np.stack([z + k for k in range(together)], -1).astype(f"{order}{dtype}")
    parts = []
    for i in range(0, h, rows):
        part = data[i : i + rows].copy()
        if predictor == 2:
            plain = part.view(f"{order}u{dtype[1:]}")
            flat = plain.astype(f"u{dtype[1:]}")
            flat[:, 1:] -= flat[:, :-1].copy()
            part = flat.astype(f"{order}u{dtype[1:]}")
        raw = part.tobytes()
        parts.append(zlib.compress(raw) if compression == 8 else lzw_packed(raw) if compression == 5 else raw)
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42)
    head += struct.pack(f"{order}HHQ", 8, 0, 0) if big else struct.pack(f"{order}I", 0)
    body, offsets = bytearray(head), []
    for p in parts:
        offsets.append(len(body))
        body += p
    form = {"u": 1, "i": 2, "f": 3}[dtype[0]]
    fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * int(dtype[1:])] * together), (259, 3, [compression]), (273, 4, offsets), (277, 3, [together]), (278, 4, [rows]), (279, 4, [len(p) for p in parts]), (317, 3, [predictor]), (339, 3, [form] * together)]
    if nodata is not None:
        fields.append((42113, 2, list(f"{nodata}\0".encode())))
    entries = b""
    for tag, kind, values in fields:
        raw = struct.pack(f"{order}{len(values)}{ {2: 'B', 3: 'H', 4: 'I'}[kind]}", *values)
        room = 8 if big else 4
        if len(raw) > room:
            place = len(body)
            body += raw
            raw = struct.pack(f"{order}{'Q' if big else 'I'}", place)
        entries += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, kind, len(values)) + raw.ljust(room, b"\0")
    struct.pack_into(f"{order}{'Q' if big else 'I'}", body, 8 if big else 4, len(body))
    return bytes(body) + struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + entries + bytes(8)


def lzw_packed(raw):
    """A plain encoder."""
    out, bits, have = bytearray(), 0, 0
    table, width, text = {bytes([i]): i for i in range(256)}, 9, b""

    def put(code):
        nonlocal bits, have
        bits, have = (bits << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((bits >> have) & 255)

    put(256)
    n = 258
    for b in raw:
        more = text + bytes([b])
        if more in table:
            text = more
            continue
        put(table[text])
        table[more], n = n, n + 1
        if n in (512, 1024, 2048):
            width += 1
        if n == 4095:
            put(256)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        text = bytes([b])
    if text:
        put(table[text])
        n += 1
        if n in (512, 1024, 2048):
            width += 1
    put(257)
    if have:
        out.append((bits << (8 - have)) & 255)
    return bytes(out)


@pytest.mark.parametrize(
    "how",
    [dict(order="<", dtype="f4"), dict(order=">", dtype="f8", strips=5), dict(order="<", dtype="i2", compression=8, predictor=2, strips=7), dict(order=">", dtype="u1", together=3),
     dict(order="<", dtype="u1", compression=5), dict(order=">", dtype="i4", compression=5, strips=9, predictor=2), dict(order="<", dtype="f4", big=True, compression=8), dict(order="<", dtype="i2", nodata=7)],
)
def test_foreign_layouts(spark, tmp_path, how):
    z = np.random.default_rng(1).integers(0, 100, (23, 31)).astype(float)
    (tmp_path / "a.tif").write_bytes(foreign(z, **how))
    n = how.get("together", 1)
    rows = tiff.read_grid(spark, f"{tmp_path}/a.tif", [f"b{k}" for k in range(n)]).collect()
    for k in range(n):
        got = array(rows, z.shape, f"b{k}")
        want = np.where(z + k == how["nodata"], np.nan, z + k) if "nodata" in how else z + k
        assert ((got == want) | (np.isnan(got) & np.isnan(want))).all()


def test_wrong_files_and_cells_are_errors(spark, tmp_path, surface):
    (tmp_path / "a.tif").write_bytes(b"no grid at all..")
    with pytest.raises(Exception, match="not a TIFF"):
        tiff.read_grid(spark, f"{tmp_path}/a.tif").collect()
    (tmp_path / "b.tif").write_bytes(foreign(surface[:3, :3], "<", "f8"))
    with pytest.raises(Exception, match="1 bands, 2 are asked for"):
        tiff.read_grid(spark, f"{tmp_path}/b.tif", ("z", "w")).collect()
    with pytest.raises(Exception, match="outside the grid"):
        tiff.write_grid(cells(spark, np.zeros((50, 3))), f"{tmp_path}/out", GRID, block=32, tile=16)
    assert not [f for _, _, files in os.walk(f"{tmp_path}/out") for f in files]  # nothing is left of a failed write
    unsorted = cells(spark, surface).select("row", "col", "z").coalesce(1).orderBy(F.rand(1))
    spark.dataSource.register(tiff.GridTiff)
    with pytest.raises(Exception, match="by block"):
        unsorted.write.format("grid_tiff").option("path", f"{tmp_path}/out").option("grid", tiff.spec_text(GRID)).option("block", 32).option("tile", 16).mode("append").save()


def test_an_empty_table_writes_nothing(spark, tmp_path, surface):
    tiff.write_grid(cells(spark, surface).limit(0), f"{tmp_path}/none", GRID)
    assert not os.path.exists(f"{tmp_path}/none") or not os.listdir(f"{tmp_path}/none")
