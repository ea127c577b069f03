"""Tables of the binary map's layers: cells' shapes, chunks, road references, route nodes and delta streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, roads

#: Fixed values of the format: the background's type code, the least extended type.
BACKGROUND, EXTENDED = 0x4B, 0x10000


def backgrounds(cells: DataFrame) -> DataFrame:
    """One rectangle a cell (open ring from the south-west corner, by way of the south-east), before its other shapes."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("minx", "miny"), at("maxx", "miny"), at("maxx", "maxy"), at("minx", "maxy"))
    return cells.select("cell", F.lit(BACKGROUND).alias("type_code"), F.lit(0).alias("seq"), ring.alias("geometry"))


def labelled_chunks(chunks: DataFrame, cell: str, feature: str, chunk: str, label: str) -> DataFrame:
    """The first chunk of a feature in a cell keeps its label, the others have none; extended types go to a section of their own."""
    first = F.row_number().over(Window.partitionBy(cell, feature).orderBy(chunk)) == 1
    return chunks.withColumn(label, F.when(first, F.col(label)).otherwise(0)).withColumn("extended", F.col("type_code") >= EXTENDED)


def open_ring(ring: Column) -> Column:
    """A ring of over three points without its repeated last one."""
    same = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when((F.size(ring) > 3) & same, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def chunk_flags(flags: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Node flags of points [start, end) of a line, and whether they reach its end."""
    return F.slice(flags, start + 1, end - start), end == F.size(flags)


def road_references(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Per road the (polyline number, cell) places where its pieces lie, in order."""
    return rows.groupBy(*scope, "road").agg(F.array_sort(F.collect_list(F.struct("cell", "polyline"))).alias("refs"))


def node_flags(points: DataFrame, scope: list[str], explicit: str = "explicit") -> DataFrame:
    """Points (as of `roads.vertices`, with a flag of named nodes) + is_node: the named ones if any road of the tile names some, else ends and junctions."""
    found = roads.junctions(points, scope)
    named = points.groupBy(*scope).agg(F.max(explicit).alias("_any")) if scope else points.agg(F.max(explicit).alias("_any"))
    found = found.join(F.broadcast(named), scope) if scope else found.crossJoin(F.broadcast(named))
    return found.withColumn("is_node", F.when(F.col("_any"), F.col(explicit)).otherwise(F.col("is_node"))).drop("_any")


def node_index(points: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Node places of a tile with their number from 0, by first appearance."""
    first = points.where("is_node").groupBy(*scope, "lat_u", "lon_u").agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("node", (F.row_number().over(Window.partitionBy(*scope).orderBy("_first")) - 1).cast("int")).drop("_first")


def boundary_nodes(nodes: DataFrame, scope: list[str], high_only: bool = False) -> DataFrame:
    """Boundary nodes by longitude, then latitude, with their place; `high_only`: of a group above 0."""
    own = nodes.where(F.col("boundary") & ((F.col("node_group") > 0) if high_only else F.lit(True)))
    return own.withColumn("place", (F.row_number().over(Window.partitionBy(*scope).orderBy("lon_u", "lat_u")) - 1).cast("int"))


def routing_parts(mode: Column, has_roads: Column) -> tuple[Column, Column]:
    """(road table, node table) of a tile: none without roads or if disabled, no node table if net-only."""
    net = has_roads & (mode != "disabled")
    return net, net & (mode != "net-only")


def shapes_by_parent(shapes: DataFrame, parents: DataFrame, shape: str, side: int = 1 << 16) -> DataFrame:
    """X11: (shape, parent, geometry): a shape's part in every parent box it meets, by squares of `side` units and a kernel.

    A shape without a part in any goes whole to the parent of its midpoint.
    """
    xs, ys = F.transform("geometry", lambda p: p["x"]), F.transform("geometry", lambda p: p["y"])
    boxed = shapes.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})
    squares = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)))
    own = boxed.select(shape, "minx", "miny", "maxx", "maxy", squares("minx", "maxx").alias("_cx")).select("*", squares("miny", "maxy").alias("_cy"))
    area = parents.withColumn("_cx", squares("p_minx", "p_maxx")).withColumn("_cy", squares("p_miny", "p_maxy"))
    meet = (F.col("minx") <= F.col("p_maxx")) & (F.col("maxx") >= F.col("p_minx")) & (F.col("miny") <= F.col("p_maxy")) & (F.col("maxy") >= F.col("p_miny"))
    pairs = own.join(area, ["_cx", "_cy"]).where(meet).select(shape, "parent", "p_minx", "p_miny", "p_maxx", "p_maxy").distinct()
    near = pairs.groupBy(shape).agg(F.array_sort(F.collect_list(F.struct("parent", "p_minx", "p_miny", "p_maxx", "p_maxy"))).alias("near"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, geometry, boxes in zip(batch[shape], batch["geometry"], batch["near"], strict=True):
                ring = np.array([(p["x"], p["y"]) for p in geometry])
                for parent, part in kernels.parent_pieces(ring, [(b["parent"], (b["p_minx"], b["p_miny"], b["p_maxx"], b["p_maxy"])) for b in boxes]):
                    rows.append((key, parent, [{"x": float(x), "y": float(y)} for x, y in part]))
            yield pd.DataFrame(rows, columns=[shape, "parent", "geometry"])

    kind = shapes.schema[shape].dataType.simpleString()
    return shapes.select(shape, "geometry").join(near, shape).mapInPandas(run, f"{shape} {kind}, parent int, geometry array<struct<x:double,y:double>>")


# --- delta streams ---------------------------------------------------------------------------------------------------


def digits(value: int) -> int:
    return abs(value).bit_length()


def base_of(bits: int) -> int:
    """Least base code that stands for so many bits: single steps from 2, double steps from base 10."""
    return max(0, bits - 2) if bits < 12 else (bits + 8) // 2


def width_of(base: int) -> int:
    return base + 2 if base < 10 else 2 * base - 7


class Bits:
    """A bit stream, lowest bit first."""

    def __init__(self, value: int = 0, size: int = 0):
        self.value, self.size = value, size

    def put(self, number: int, width: int) -> None:
        self.value |= (number & (1 << width) - 1) << self.size
        self.size += width

    def put_signed(self, number: int, width: int) -> None:
        """Sign in the top bit; what exceeds the width goes ahead in full steps marked by the top bit alone."""
        top = 1 << width - 1
        rest = abs(number)
        while rest >= top:
            self.put(top, width)
            rest -= top - 1
        self.put(top - rest | top if number < 0 else rest, width)

    def take(self, width: int) -> int:
        out = self.value & (1 << width) - 1
        self.value >>= width
        return out

    def take_signed(self, width: int) -> int:
        top, extra = 1 << width - 1, 0
        while (got := self.take(width)) == top:
            extra += top - 1
        return got + extra if got < top else got - 2 * top - extra

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def delta_stream(deltas: list[tuple[int, int]], bases: tuple[int, int], one_sign: tuple[bool, bool], flags: list[bool] | None, extended: bool) -> bytes | None:
    """Both bases, both signs (or none), then each step; None if no step is left. `flags`: nodes, with one bit a step."""
    out, negative = Bits(), [any(d[k] < 0 for d in deltas) for k in (0, 1)]
    for b in bases:
        out.put(b, 4)
    for k in (0, 1):
        out.put(one_sign[k], 1)
        if one_sign[k]:
            out.put(negative[k], 1)
    out.put(0, int(extended) + (flags is not None))
    steps = 0
    for n, step in enumerate(deltas, 1):
        if flags is not None and step == (0, 0) and not flags[n] and n != len(deltas):
            continue
        steps += 1
        for k in (0, 1):
            if one_sign[k]:
                out.put(abs(step[k]), width_of(bases[k]))
            else:
                out.put_signed(step[k], width_of(bases[k]) + 1)
        if flags is not None:
            out.put(flags[n], 1)
    return out.bytes() if steps else None


def shortest_stream(deltas: list[tuple[int, int]], flags: list[bool] | None = None, extended: bool = False) -> bytes | None:
    """The stream of a line's steps; smaller bases with overflow marks are tried while they shorten it."""
    if not deltas:
        return None
    if flags is not None:  # a named node counts on the first of the points that share its place
        moved, first = [False] * (len(deltas) + 1), 0
        for n, step in enumerate(deltas, 1):
            first = n if step != (0, 0) or flags[n] else first
            moved[first] = moved[first] or flags[n]
        flags = moved
    start = tuple(base_of(max(digits(min(d[k] for d in deltas)), digits(max(d[k] for d in deltas)))) for k in (0, 1))
    signs = tuple(not (min(d[k] for d in deltas) < 0 < max(d[k] for d in deltas)) for k in (0, 1))
    plain = best = delta_stream(deltas, start, signs, flags, extended)
    if plain is None:
        return None
    chosen = start
    for axis, kept in ((0, (False, signs[1])), (1, (False, False))):
        worse = 0
        for base in range(start[axis] - 1, -1, -1):
            bases = (base, start[1]) if axis == 0 else (chosen[0], base)
            tried = delta_stream(deltas, bases, kept, flags, extended)
            if len(tried) < len(best):
                best, chosen = tried, bases
            else:
                worse += 1
                if worse == 2:
                    break
    return plain if len(plain) == len(best) else best


def read_stream(data: bytes, steps: int, flagged: bool = False, extended: bool = False) -> list[tuple[int, int]]:
    """The steps of a stream."""
    s = Bits(int.from_bytes(data, "little"))
    bases = s.take(4), s.take(4)
    signs = []
    for _ in (0, 1):
        signs.append((-1 if s.take(1) else 1) if s.take(1) else 0)
    s.take(int(extended) + flagged)
    out = []
    for _ in range(steps):
        out.append(tuple(sign * s.take(width_of(b)) if sign else s.take_signed(width_of(b) + 1) for b, sign in zip(bases, signs, strict=True)))
        s.take(int(flagged))
    return out
