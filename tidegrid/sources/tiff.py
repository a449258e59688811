"""Grids in TIFF files as a Spark data source: tiles are read where a query asks for them, and cells are written as files of tiles.

    spark.dataSource.register(GridTiff)
    spark.read.format("grid_tiff").option("path", ..).option("bands", "z,weights").load()   # row, col, z, weights

A file's directory is parsed, not the file: a partition is a run of tiles (or strips), and filters on row and col leave out tiles, and whole files, that
they cannot meet (with `spark.sql.python.filterPushdown.enabled`, which `read_grid` sets). Classic and big files, either byte order, tiles and strips, bands
apart or together, integers and floats of 8 to 64 bits, no compression, deflate or LZW, and predictors 1 to 3 are read. No-data values and NaN are null;
every cell of a tile is a row.

`write_grid` deals cells to tasks by block; a task writes one file a block, with tiles of its own, under a name of this attempt. When all tasks are done the
files get their names; when one fails all that were written go. So no task or driver holds more than a block, and a lost task is done again.
"""

from __future__ import annotations

import glob
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from tidegrid.functions.grid import GridSpec, Region
from tidegrid.sources.files import located, opened

#: fixed values: size of a field of each type, and its code
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: fixed values: tags
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, EXTRA, FORMAT, SCALE, TIE, KEYS, NODATA = 317, 322, 323, 324, 325, 338, 339, 33550, 33922, 34735, 42113


def _directory(f) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory of an opened file."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(f"{order}Q", head, 8)[0] if big else struct.unpack_from(f"{order}I", head, 4)[0]
    f.seek(at)
    (n,) = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(8 if big else 2))
    size, room = (20, 8) if big else (12, 4)
    raw, out = f.read(n * size), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", raw, i * size)
        code = _TYPES.get(kind)
        if code is None:
            continue
        length = struct.calcsize(f"{order}{code}") * count
        body = raw[i * size + size - room : i * size + size]
        if length > room:
            f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", body)[0])
            body = f.read(length)
        out[tag] = (body[:count],) if code == "s" else struct.unpack_from(f"{order}{code * count if len(code) > 1 else f'{count}{code}'}", body)
    return order, out


@dataclass
class Layout:
    """How the cells of a file are stored, and where on the ground they lie."""

    order: str
    width: int
    height: int
    samples: int
    dtype: str
    compression: int
    predictor: int
    apart: bool
    tile: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    west: float | None = None
    north: float | None = None
    xinc: float | None = None
    yinc: float | None = None
    nodata: float | None = None
    epsg: int | None = None

    @classmethod
    def of(cls, f) -> Layout:
        order, d = _directory(f)
        one = lambda tag, default=None: d[tag][0] if tag in d else default
        bits, form = one(BITS, 1), one(FORMAT, 1)
        if bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or one(COMPRESSION, 1) not in (1, 5, 8, 32946) or len(set(d.get(BITS, (1,)))) > 1:
            raise ValueError(f"cells of {bits} bits, format {form} and compression {one(COMPRESSION, 1)} are not read")
        tiled = TILES in d
        tile = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, one(HEIGHT)), one(HEIGHT)), one(WIDTH))
        place = {}
        if SCALE in d and TIE in d:
            i, j, _, x, y, _ = d[TIE][:6]
            xinc, yinc = d[SCALE][:2]
            place = {"west": x - i * xinc, "north": y + j * yinc, "xinc": xinc, "yinc": yinc}
        keys = d.get(KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        text = one(NODATA, b"").split(b"\0")[0].strip()
        return cls(
            order, one(WIDTH), one(HEIGHT), one(SAMPLES, 1), "uif"[form - 1] + str(bits // 8), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2, tile,
            d[TILES if tiled else STRIPS], d[TILE_SIZES if tiled else STRIP_SIZES], **place, nodata=float(text) if text else None, epsg=codes.get(3072) or codes.get(2048),
        )

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.tile[0])

    def read(self, f, row: int, col: int, bands: int) -> np.ndarray:
        """(bands, rows, columns) of the tile number row, col, cut to the file's size."""
        h, w = self.tile
        at, n = row * self.across + col, self.across * self.down
        rows, cols = min(h, self.height - row * h), min(w, self.width - col * w)
        parts = []
        for band in range(bands if self.apart else 1):
            k, spp = at + band * n, 1 if self.apart else self.samples
            lines = h if self.tile[1] != self.width or len(self.offsets) == n and self.sizes[k] else rows
            if not self.sizes[k]:  # a tile that was never written has no data
                parts.append(np.full((1 if self.apart else self.samples, rows, cols), np.nan))
                continue
            f.seek(self.offsets[k])
            raw = unpacked(f.read(self.sizes[k]), self.compression)
            whole = decoded(raw, self.dtype, self.order, self.predictor, w, spp)
            parts.append(np.moveaxis(whole[: min(lines, len(whole))][:rows, :cols], 2, 0))
        out = np.concatenate(parts)[:bands].astype(float)
        return np.where(out == self.nodata, np.nan, out) if self.nodata is not None else out


def unpacked(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    return lzw(raw) if compression == 5 else zlib.decompress(raw)


def lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest first, that grow one code early; 256 begins anew and 257 ends."""
    out, table, width, bits, have, last = [], [], 9, 0, 0, None
    for byte in raw:
        bits, have = (bits << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        text = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + text[:1])
        out.append(text)
        last = text
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def decoded(raw: bytes, dtype: str, order: str, predictor: int, width: int, spp: int) -> np.ndarray:
    """(rows, width, samples) of a tile's bytes."""
    size = int(dtype[1:])
    line = width * spp * size
    data = np.frombuffer(raw, np.uint8)[: len(raw) // line * line].reshape(-1, line)
    if predictor == 3:  # differences of bytes, highest bytes of a line first
        steps = np.cumsum(data.reshape(len(data), -1, spp), 1, dtype=np.uint8).reshape(len(data), size, width * spp)
        return np.ascontiguousarray(steps.transpose(0, 2, 1)).view(f">{dtype}").reshape(-1, width, spp)
    cells = data.view(f"{order}{dtype}").reshape(-1, width, spp)
    if predictor == 2:
        kind = np.dtype(f"u{size}")
        cells = np.cumsum(cells.view(f"{order}u{size}").astype(kind), 1, dtype=kind).view(dtype)
    return cells


def encoded(cells: np.ndarray) -> bytes:
    """A tile of 64-bit floats, deflated after differences of bytes."""
    h, w = cells.shape
    planes = cells.astype(">f8").view(np.uint8).reshape(h, w, 8).transpose(0, 2, 1).reshape(h, w * 8)
    steps = planes.copy()
    steps[:, 1:] -= planes[:, :-1]
    return zlib.compress(steps.tobytes())


def packed(bands: np.ndarray, tile: int, west: float, north: float, xinc: float, yinc: float, nodata: float, epsg: int | None) -> bytes:
    """A TIFF file of (bands, rows, columns), NaN as no data, in tiles."""
    n, height, width = bands.shape
    down, across = -(-height // tile), -(-width // tile)
    body, offsets, sizes = bytearray(b"II*\0\0\0\0\0"), [], []
    for band in np.where(np.isnan(bands), nodata, bands):
        padded = np.full((down * tile, across * tile), nodata)
        padded[:height, :width] = band
        for i in range(down):
            for j in range(across):
                part = encoded(padded[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile])
                offsets.append(len(body))
                sizes.append(len(part))
                body += part + bytes(len(part) % 2)
    text = f"{nodata:g}".encode() + b"\0"
    fields = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [64] * n), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [n]), (PLANAR, "H", [2]), (PREDICTOR, "H", [3]),
        (TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILES, "I", offsets), (TILE_SIZES, "I", sizes), *([(EXTRA, "H", [0] * (n - 1))] if n > 1 else []), (FORMAT, "H", [3] * n),
        (SCALE, "d", [xinc, yinc, 0.0]), (TIE, "d", [0.0, 0.0, 0.0, west, north, 0.0]),
    ]
    if epsg:
        flat = 4000 <= epsg < 5000
        fields.append((KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, epsg]))
    fields.append((NODATA, "s", text))
    entries, kinds = b"", {"H": 3, "I": 4, "d": 12, "s": 2}
    for tag, kind, values in fields:
        raw = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        if len(raw) > 4:
            place, body = len(body), body + raw + bytes(len(raw) % 2)
            raw = struct.pack("<I", place)
        entries += struct.pack("<HHI", tag, kinds[kind], len(values)) + raw.ljust(4, b"\0")
    struct.pack_into("<I", body, 4, len(body))
    return bytes(body) + struct.pack("<H", len(fields)) + entries + bytes(4)


def listed(path: str) -> list[str]:
    """TIFF files of a file's name, a pattern or a folder."""
    if "*" in path:
        return sorted(glob.glob(path.removeprefix("file://")))
    from pyarrow import fs

    system, place = located(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    prefix = path[: path.rindex(place)] if "://" in path and place in path else ""
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted(prefix + i.path for i in found if i.path.lower().endswith((".tif", ".tiff")) and "/_" not in i.path[len(place) :])


def _spec(text: str | None) -> GridSpec | None:
    if not text:
        return None
    w, e, s, n, xinc, yinc = map(float, text.split(","))
    return GridSpec(Region(w, e, s, n), xinc, yinc)


def spec_text(grid: GridSpec) -> str:
    r = grid.region
    return ",".join(map(repr, (r.w, r.e, r.s, r.n, grid.xinc, grid.yinc)))


@dataclass
class Tiles(InputPartition):
    """Tiles (number of row and column) of a file, whose first cell is that of `row`, `col`."""

    path: str
    row: int
    col: int
    tiles: list[tuple[int, int]] = field(default_factory=list)


class GridTiff(DataSource):
    """row, col and the named bands of grid files. Options: path (a file, pattern or folder), bands (names of the first bands, z if not given), grid (w,e,s,n,xinc,yinc, by
    which cells of many files are numbered by their place on the ground; without it each file is numbered by itself), tiles (of a partition, 16)."""

    @classmethod
    def name(cls) -> str:
        return "grid_tiff"

    def schema(self) -> str:
        return "row int, col int, " + ", ".join(f"`{b}` double" for b in self._bands())

    def _bands(self) -> list[str]:
        return self.options.get("bands", "z").split(",")

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options["path"], self._bands(), _spec(self.options.get("grid")), int(self.options.get("tiles", 16)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        epsg = int(o["epsg"]) if o.get("epsg") else None
        return TiffWriter(o["path"], [f.name for f in schema if f.name not in ("row", "col")], _spec(o["grid"]), int(o.get("block", 1024)), int(o.get("tile", 256)), float(o.get("nodata", -9999)), epsg)


class TiffReader(DataSourceReader):
    def __init__(self, path: str, bands: list[str], grid: GridSpec | None, tiles: int):
        self.path, self.bands, self.grid, self.tiles = path, bands, grid, tiles
        self.low, self.high = {"row": -math.inf, "col": -math.inf}, {"row": math.inf, "col": math.inf}

    def pushFilters(self, filters: list[Filter]):
        """Bounds of row and col out of the filters, all of which Spark applies again to the rows."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in self.low:
                values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
                if values and None not in values:
                    if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)):
                        self.low[name] = max(self.low[name], min(values) + isinstance(f, GreaterThan))
                    if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)):
                        self.high[name] = min(self.high[name], max(values) - isinstance(f, LessThan))
            yield f

    def _look(self, path: str) -> list[Tiles]:
        with opened(path) as f:
            at = Layout.of(f)
        if len(self.bands) > at.samples:
            raise ValueError(f"{path}: {at.samples} bands, {len(self.bands)} are asked for")
        row = col = 0
        if self.grid is not None:
            if at.west is None or abs(at.xinc - self.grid.xinc) > 1e-9 * at.xinc or abs(at.yinc - self.grid.yinc) > 1e-9 * at.yinc:
                raise ValueError(f"{path}: not of the grid's cell size")
            row, col = round((self.grid.region.n - at.north) / at.yinc), round((at.west - self.grid.region.w) / at.xinc)
        h, w = at.tile
        span = lambda name, first, step, n: range(
            max(0, math.floor(max(self.low[name] - first, 0) / step)), min(n, math.floor(min(self.high[name] - first, n * step - 1) / step) + 1)
        )
        met = [(i, j) for i in span("row", row, h, at.down) for j in span("col", col, w, at.across)]
        return [Tiles(path, row, col, met[i : i + self.tiles]) for i in range(0, len(met), self.tiles)]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            return [t for found in pool.map(self._look, listed(self.path)) for t in found]

    def read(self, part: Tiles) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        names = ["row", "col", *self.bands]
        with opened(part.path) as f:
            at = Layout.of(f)
            for i, j in part.tiles:
                cells = at.read(f, i, j, len(self.bands))
                r, c = np.mgrid[: cells.shape[1], : cells.shape[2]]
                r, c = r + part.row + i * at.tile[0], c + part.col + j * at.tile[1]
                bands = [pa.array(b.ravel(), pa.float64(), from_pandas=True) for b in cells]
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), *bands], names=names)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are, and what they will be called."""

    files: list[tuple[str, str]]


class TiffWriter(DataSourceArrowWriter):
    def __init__(self, path: str, bands: list[str], grid: GridSpec, block: int, tile: int, nodata: float, epsg: int | None):
        if tile % 16 or block % tile:
            raise ValueError("tiles must be multiples of 16 cells, and blocks of tiles")
        self.path, self.bands, self.grid, self.block, self.tile, self.nodata, self.epsg = path.rstrip("/"), bands, grid, block, tile, nodata, epsg

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple[str, str]] = []
        system, folder = located(self.path)
        try:
            held, at, done = None, None, set()
            for batch in iterator:
                if not batch.num_rows:
                    continue
                row, col = (batch.column(n).to_numpy() for n in ("row", "col"))
                values = [batch.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in self.bands]
                keys = np.stack((row // self.block, col // self.block))
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), len(row)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    key = (int(keys[0, a]), int(keys[1, a]))
                    if key != at:
                        if at is not None:
                            files.append(self._put(system, folder, at, held))
                        if key in done:
                            raise ValueError("cells must come by block; use write_grid")
                        at, held = key, np.full((len(self.bands), self.block, self.block), np.nan)
                        done.add(key)
                    for k, v in enumerate(values):
                        held[k, row[a:b] % self.block, col[a:b] % self.block] = v[a:b]
            if at is not None:
                files.append(self._put(system, folder, at, held))
        except BaseException:
            self._drop([Written(files)])
            raise
        return Written(files)

    def _put(self, system, folder: str, key: tuple[int, int], cells: np.ndarray) -> tuple[str, str]:
        g, (i, j) = self.grid, key
        rows, cols = min(self.block, g.rows - i * self.block), min(self.block, g.cols - j * self.block)
        if rows <= 0 or cols <= 0 or min(key) < 0 or not (np.isnan(cells[:, rows:]).all() and np.isnan(cells[:, :, cols:]).all()):
            raise ValueError("cells outside the grid")
        raw = packed(cells[:, :rows, :cols], self.tile, g.region.w + j * self.block * g.xinc, g.region.n - i * self.block * g.yinc, g.xinc, g.yinc, self.nodata, self.epsg)
        temporary = f"{folder}/_temporary/{uuid.uuid4().hex}.tif"
        system.create_dir(os.path.dirname(temporary), recursive=True)
        with system.open_output_stream(temporary) as out:
            out.write(raw)
        return temporary, f"{folder}/r{i}_c{j}.tif"

    def commit(self, messages) -> None:
        system, folder = located(self.path)
        for m in messages:
            for temporary, name in m.files if m else ():
                system.move(temporary, name)
        self._clear(system, folder)

    def abort(self, messages) -> None:
        self._drop(messages)
        self._clear(*located(self.path))

    @staticmethod
    def _clear(system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{folder}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary")

    def _drop(self, messages) -> None:
        system, _ = located(self.path)
        for m in messages:
            for temporary, _ in m.files if m else ():
                system.delete_file(temporary)


def read_grid(spark: SparkSession, path: str, bands=("z",), grid: GridSpec | None = None, tiles: int = 16) -> DataFrame:
    """row, col and bands of TIFF files; filters on row and col reach the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridTiff)
    source = spark.read.format("grid_tiff").option("path", path).option("bands", ",".join(bands)).option("tiles", tiles)
    return (source.option("grid", spec_text(grid)) if grid else source).load()


def write_grid(cells: DataFrame, path: str, grid: GridSpec, bands=("z",), block: int = 1024, tile: int = 256, nodata: float = -9999.0, epsg: int | None = None) -> None:
    """Write bands of cells (row, col, ..) as TIFF files of at most `block` by `block` cells into a folder, each cell at most once."""
    cells.sparkSession.dataSource.register(GridTiff)
    by = [F.floor(F.col(c) / block).alias(f"_{c}") for c in ("row", "col")]
    dealt = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(b).cast("double").alias(b) for b in bands], *by)
    dealt = dealt.repartition("_row", "_col").sortWithinPartitions("_row", "_col").drop("_row", "_col")
    out = dealt.write.format("grid_tiff").option("path", path).option("grid", spec_text(grid)).option("block", block).option("tile", tile).option("nodata", nodata)
    (out.option("epsg", epsg) if epsg else out).mode("append").save()
