"""Binary vector files: Shapefile with its DBF, and GeoPackage, read as whole files in tasks (up to 2 GB a file).

Rows come as from the other readers: fid, source_layer, geom_type, parts (outer rings, lines or points), attributes as text.
A Shapefile's companions are found by name beside it; a GeoPackage is opened in memory by the SQLite library.
"""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import FEATURES, text_of

# Shape types (also with heights or measures: + 10, + 20) and geometry codes of well-known binary.
SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
WKB = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
COLUMNS = ["fid", "source_layer", "geom_type", "parts", "attributes"]


def ring_area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))


def as_points(points: np.ndarray) -> list[dict[str, float]]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def shape_records(data: bytes) -> Iterator[tuple[str | None, list[np.ndarray]]]:
    """(type, parts) of each record of a `.shp` file; outer rings run clockwise, holes are left out."""
    at = 100
    while at + 12 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        code = struct.unpack("<i", body[:4])[0]
        kind = SHAPES.get(code % 10)
        if code == 0 or kind is None:
            yield None, []
        elif kind == "Point":
            yield kind, [np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)]
        elif kind == "MultiPoint":
            n = struct.unpack("<i", body[36:40])[0]
            yield "Point", list(np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 1, 2))
        else:
            parts, n = struct.unpack("<ii", body[36:44])
            edges = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            points = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
            pieces = [points[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]
            yield kind, [p for p in pieces if kind != "Polygon" or ring_area(p) <= 0] or pieces[:1]


def dbf_rows(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Attributes of each record of a `.dbf` file as text; numbers lose their padding, empty values are ''."""
    count, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    for k in range(count):
        row, at = {}, head + k * width + 1
        for name, kind, size in fields:
            raw = data[at : at + size]
            at += size
            try:
                text = raw.decode(encoding)
            except UnicodeDecodeError:
                text = raw.decode("cp1252", "replace")
            text = text.replace("\0", "").strip()
            if kind in "NF" and re.fullmatch(r"[+-]?\d*\.\d+", text):
                text = text_of(float(text))
            row[name] = text
        yield row


def read_shapefile(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Features of the Shapefiles at a path (folder, file or pattern of `.shp`); the layer is the file's stem."""
    folder = path if not path.lower().endswith(".shp") else path.rsplit("/", 1)[0]
    pattern = "*.{shp,dbf,cpg,SHP,DBF,CPG}" if folder == path else f"{path.rsplit('/', 1)[1][:-4]}.{{shp,dbf,cpg,SHP,DBF,CPG}}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    whole = files.groupBy(stem.alias("stem")).agg(*[F.first(F.when(kind == k, F.col("content")), ignorenulls=True).alias(k) for k in ("shp", "dbf", "cpg")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stem, shp, dbf, cpg in zip(batch["stem"], batch["shp"], batch["dbf"], batch["cpg"], strict=True):
                name = layer or stem.rsplit("/", 1)[-1]
                page = bytes(cpg).decode("ascii", "ignore").strip().lower() if cpg is not None else "utf-8"
                page = {"1252": "cp1252", "ansi 1252": "cp1252", "88591": "latin-1"}.get(page, page or "utf-8")
                rows = dbf_rows(bytes(dbf), page) if dbf is not None else iter(())
                out = []
                for fid, (kind, parts) in enumerate(shape_records(bytes(shp))):
                    out.append((fid, name, kind, [as_points(p) for p in parts], next(rows, {})))
                    if len(out) == 2048:
                        yield pd.DataFrame(out, columns=COLUMNS)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=COLUMNS)

    return whole.where("shp is not null").mapInPandas(run, FEATURES)


def wkb_parts(data: bytes, at: int = 0) -> tuple[str | None, list[np.ndarray], int]:
    """(simple type, parts, end) of well-known binary, multi types and collections of one type taken apart; outer rings only."""
    order = "<" if data[at] else ">"
    code = struct.unpack(order + "I", data[at + 1 : at + 5])[0]
    flat = code & 0x0FFFFFFF
    dims = 2 + (flat // 1000 in (1, 3) or bool(code & 0x80000000)) + (flat // 1000 in (2, 3) or bool(code & 0x40000000))
    kind, at = WKB.get(flat % 1000), at + 5

    def run(n: int, at: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2], at + 8 * n * dims

    def number(at: int) -> tuple[int, int]:
        return struct.unpack(order + "I", data[at : at + 4])[0], at + 4

    if kind == "Point":
        points, at = run(1, at)
        return kind, [points] if not np.isnan(points).any() else [], at
    if kind == "LineString":
        n, at = number(at)
        points, at = run(n, at)
        return kind, [points] if n else [], at
    if kind == "Polygon":
        rings, at = number(at)
        outer: list[np.ndarray] = []
        for k in range(rings):
            n, at = number(at)
            points, at = run(n, at)
            if k == 0 and n:
                outer.append(points)
        return kind, outer, at
    if kind is None:
        return None, [], len(data)
    n, at = number(at)
    kinds, parts = set(), []
    for _ in range(n):
        own, more, at = wkb_parts(data, at)
        kinds.add(own)
        parts += more
    single = kind.removeprefix("Multi") if kind != "GeometryCollection" else kinds.pop() if len(kinds) == 1 else None
    return single, parts if single else [], at


def package_geometry(blob: bytes | None) -> tuple[str | None, list[np.ndarray]]:
    """A GeoPackage geometry: its header with an optional envelope, then well-known binary."""
    if not blob or blob[:2] != b"GP" or blob[3] & 16:
        return None, []
    at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(blob[3] >> 1 & 7, 0)
    return wkb_parts(bytes(blob), at)[:2]


def package_layers(base: sqlite3.Connection) -> list[tuple[str, str]]:
    """(layer, geometry column) in the order of the file's contents."""
    return base.execute("select c.table_name, g.column_name from gpkg_contents c join gpkg_geometry_columns g on g.table_name = c.table_name where c.data_type = 'features' order by c.rowid").fetchall()


def chosen(layers: list[tuple[str, str]], wanted: list[str] | None, file: str) -> list[tuple[str, str]]:
    """Layers by name or number; none named: the first. A name that the file lacks is an error."""
    if not wanted:
        return layers[:1]
    by_name = dict(layers)
    out = [layers[int(w)] if w.isdigit() and w not in by_name and int(w) < len(layers) else (w, by_name.get(w)) for w in wanted]
    if missing := [w for w, c in out if c is None]:
        raise ValueError(f"{file}: no layer {', '.join(missing)}")
    return out


def read_geopackage(spark: SparkSession, path: str, layers: list[str] | None = None, alias: str | None = None) -> DataFrame:
    """Features of the chosen layers of the GeoPackages at a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                base = sqlite3.connect(":memory:")
                base.deserialize(bytes(data))
                for name, geometry in chosen(package_layers(base), layers, where):
                    quoted = '"' + name.replace('"', '""') + '"'
                    info = base.execute(f"pragma table_info({quoted})").fetchall()
                    keys = {c[1] for c in info if c[5]} or {"fid"}
                    rows = base.execute(f"select * from {quoted}")
                    names = [c[0] for c in rows.description]
                    fid = 0
                    while got := rows.fetchmany(2048):
                        out = []
                        for row in got:
                            record = dict(zip(names, row, strict=True))
                            kind, parts = package_geometry(record.pop(geometry))
                            text = {k: text_of(v) for k, v in record.items() if k not in keys and not isinstance(v, bytes)}
                            out.append((fid, alias or name, kind, [as_points(p) for p in parts], text))
                            fid += 1
                        yield pd.DataFrame(out, columns=COLUMNS)
                base.close()

    return files.select("path", "content").mapInPandas(run, FEATURES)
