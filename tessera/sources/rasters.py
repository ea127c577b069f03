"""Elevation files: HGT and ASC to long form, and DEM sniffing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

VOID = -32768
CELLS = "grid string, west double, north double, cell_lon double, cell_lat double, r int, c int, h double"


def hgt_bounds(name: str) -> tuple[int, int]:
    """South-west corner in a file name such as N45E006."""
    m = re.search(r"([NS])(\d{1,2})([EW])(\d{1,3})", name.upper())
    if not m:
        raise ValueError(f"no tile corner in {name}")
    return int(m[2]) * (1 if m[1] == "N" else -1), int(m[4]) * (1 if m[3] == "E" else -1)


def read_hgt(name: str, data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """Square big-endian grid with voids as nan; (west, north, cell_lon, cell_lat)."""
    n = int(round((len(data) / 2) ** 0.5))
    if n * n * 2 != len(data) or n < 2:
        raise ValueError(f"{name}: not a square grid")
    h = np.frombuffer(data, ">i2").reshape(n, n).astype(float)
    south, west = hgt_bounds(name)
    return np.where(h == VOID, np.nan, h), (float(west), float(south + 1), 1 / (n - 1), 1 / (n - 1))


def read_asc(text: str) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """Six header lines, then rows from the north; the count is checked."""
    words = text.split()
    head = {words[k].lower(): float(words[k + 1]) for k in range(0, 12, 2)}
    rows, cols, cell = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    h = np.array(words[12:], float)
    if len(h) != rows * cols:
        raise ValueError(f"{len(h)} values, {rows * cols} expected")
    h = np.where(h == head["nodata_value"], np.nan, h).reshape(rows, cols)
    west = head.get("xllcorner", head.get("xllcenter", 0.0))
    south = head.get("yllcorner", head.get("yllcenter", 0.0))
    half = cell / 2 if "xllcorner" in head else 0.0
    return h, (west + half, south + half + cell * (rows - 1), cell, cell)


def kind_of(name: str, data: bytes) -> str | None:
    """By extension, exact size or the words at the start."""
    low = name.lower()
    if low.endswith(".hgt") or len(data) in (2 * 1201 * 1201, 2 * 3601 * 3601):
        return "hgt"
    if low.endswith(".asc") or b"ncols" in data[:256].lower():
        return "asc"
    return None


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the elevation files under a folder; other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                name, data = where.rsplit("/", 1)[-1], bytes(data)
                kind = kind_of(name, data)
                if kind is None:
                    continue
                h, (west, north, dx, dy) = read_hgt(name, data) if kind == "hgt" else read_asc(data.decode("latin-1"))
                for at in range(0, len(h), 256):
                    part = h[at : at + 256]
                    r, c = np.indices(part.shape)
                    yield pd.DataFrame({"grid": name, "west": west, "north": north, "cell_lon": dx, "cell_lat": dy, "r": (r + at).ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "h": [None if v != v else float(v) for v in part.ravel()]})

    return files.select("path", "content").mapInPandas(run, CELLS)
