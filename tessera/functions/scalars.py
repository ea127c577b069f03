"""Numeric column functions: coordinates, distances, node ids, road attributes. All native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map format: earth radius and circumference factor in metres, 2^24 units to a circle.
RADIUS = 6378137.0
CIRCUMFERENCE = RADIUS * 2 * math.pi
UNITS = 1 << 24
HIGH_UNITS = 1 << 30


def rounded(x: Column) -> Column:
    """Half away from zero, as a double."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("double")


def quantize(degrees: Column) -> Column:
    """Degrees to integer 1e-7 degrees."""
    return rounded(degrees * 1e7).cast("int")


def snap(degrees: Column) -> Column:
    """Integer key of a coordinate on a 1e-6 degree raster."""
    return rounded(degrees * 1e6).cast("long")


def node_id(lat: Column, lon: Column, level: Column) -> Column:
    """31-bit FNV-1a over the little-endian bytes of three 32-bit integers; bits above 31 never matter."""
    h = F.lit(69346085).cast("long")
    for value in (lat, lon, level):
        for k in range(4):
            byte = F.shiftrightunsigned(value.cast("int"), 8 * k).cast("long").bitwiseAND(F.lit(255))
            h = (h.bitwiseXOR(byte) * 435).bitwiseAND(F.lit(2147483647))
    return F.greatest(h, F.lit(1)).cast("int")


def map_units(degrees: Column) -> Column:
    """Degrees to 24-bit units, half a unit away from zero and then truncated."""
    half = 360.0 / UNITS / 2
    return (F.when(degrees > 0, degrees + half).otherwise(degrees - half) * float(UNITS) / 360.0).cast("int")


def unit_degrees(unit: Column) -> Column:
    """N5."""
    return unit.cast("double") * (360.0 / UNITS)


def high_precision(degrees: Column) -> Column:
    """30-bit units."""
    return rounded(degrees * float(HIGH_UNITS) / 360.0).cast("int")


def unit_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between map-unit points; flat below 10 km, great circle above."""
    a1, o1, a2, o2 = (unit_degrees(c) for c in (lat1, lon1, lat2, lon2))
    dlat, dlon = F.abs(a1 - a2), F.abs(o1 - o2)
    dlat = F.when(dlat > 90, dlat - 180).otherwise(dlat)
    dlon = F.when(dlon > 180, dlon - 360).otherwise(dlon) * F.cos(F.radians((a1 + a2) / 2))
    flat = F.lit(CIRCUMFERENCE / 360.0) * F.sqrt(dlat * dlat + dlon * dlon)
    s1, s2 = F.sin((F.radians(a1) - F.radians(a2)) / 2), F.sin((F.radians(o1) - F.radians(o2)) / 2)
    circle = 2 * F.asin(F.sqrt(s1 * s1 + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * s2 * s2)) * RADIUS
    return F.when(flat < 10000, flat).otherwise(circle)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Rhumb-line bearing in [0, 360), from map units."""
    a1, o1, a2, o2 = (F.radians(unit_degrees(c)) for c in (lat1, lon1, lat2, lon2))
    d = o2 - o1
    d = F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d)
    up = F.ln(F.tan(a2 / 2 + math.pi / 4) / F.tan(a1 / 2 + math.pi / 4))
    return F.pmod(F.degrees(F.atan2(d, up)), F.lit(360.0))


def heading_byte(degrees: Column) -> Column:
    """Direction as a signed byte (wraps at half a circle)."""
    return (F.pmod(rounded(degrees * 256.0 / 360.0).cast("int") + 128, F.lit(256)) - 128).cast("int")


def round_coord(unit: Column, shift: int) -> Column:
    """To the raster of a level."""
    return unit if shift == 0 else (unit + (1 << shift >> 1)).bitwiseAND(F.lit(-(1 << shift)))


def polygon_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x, y>>, closed or open."""
    n = F.size(ring)
    step = F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(step, F.lit(0.0), lambda a, b: a + b)) / 2)


def number(text: Column) -> Column:
    """Decimal number of a text as strict parsers read it: no blanks around it; null else."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def speed_class(kmh: Column) -> Column:
    """Speed class 0-7 of km/h (missing: 0)."""
    out = F.when(F.coalesce(kmh, F.lit(0.0)) < 10, 0)
    # fixed values: upper bounds of the classes
    for k, bound in enumerate((20, 30, 45, 60, 75, 95), 1):
        out = out.when(kmh < bound, k)
    return out.otherwise(7)


# Road class by administrative class, else by nature (default 1).
CLASS_BY_ADMIN = {"Autoroute": 4, "Nationale": 3, "Départementale": 2, "Route intercommunale": 1}
CLASS_BY_NATURE = {"Type autoroutier": 4, "Route empierrée": 0, "Chemin": 0, "Sentier": 0, "Escalier": 0, "Bac ou liaison maritime": 0, "Bac auto": 0, "Bac piéton": 0}


def road_class(admin: Column, nature: Column) -> Column:
    """N13."""
    table = lambda c, values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.coalesce(c, F.lit(""))]
    return F.coalesce(table(admin, CLASS_BY_ADMIN), table(nature, CLASS_BY_NATURE), F.lit(1))


def one_way(direction: Column) -> tuple[Column, Column]:
    """(one-way bit, direction indicator)."""
    mark = F.when(direction == "Sens direct", 1).when(direction == "Sens inverse", -1).otherwise(0)
    return F.abs(mark), mark


def access_bits(vehicles: Column) -> tuple[Column, Column]:
    """(toll, no motor vehicles)."""
    return F.when(vehicles.isin("A péage", "À péage"), 1).otherwise(0), F.when(vehicles == "Physiquement impossible", 1).otherwise(0)


def foot_denied(pedestrians: Column) -> Column:
    return F.when(F.coalesce(pedestrians, F.lit("")).isin("Libre", ""), 0).otherwise(1)


def hundredths(metres: Column, factor: int = 100) -> Column:
    """Metres to centimetres (tonnes with 1000), only above zero."""
    return F.when(metres > 0, rounded(metres * factor).cast("long"))


def access_mask(route_param: Column) -> Column:
    """8 access flags of a route parameter text; bit k for field 4 + k."""
    parts = F.split(route_param, ",")
    return sum((F.when(F.trim(F.get(parts, F.lit(4 + k))) == "1", 1 << k).otherwise(0) for k in range(8)), F.lit(0))


def arc_units(metres: Column) -> Column:
    """Arc length in units of 4.8 m."""
    return rounded(metres / 4.8).cast("int")


def type_parts(code: Column) -> tuple[Column, Column]:
    """(type, subtype) of a type code."""
    return F.when(code < 256, code).otherwise(F.shiftright(code, 8)), F.when(code < 256, 0).otherwise(code.bitwiseAND(F.lit(255)))


def hex_type(text: Column) -> Column:
    """Type code of hexadecimal or decimal text; 0 if neither."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike(r"^0x[0-9a-f]{1,8}$"), F.conv(F.substr(low, F.lit(3)), 16, 10).cast("long")).when(low.rlike(r"^\d{1,9}$"), low.try_cast("long")).otherwise(0)


def bits_needed(value: Column) -> Column:
    """Binary digits of the magnitude."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value))))


def base_bits(base: Column) -> Column:
    """Bits that a base code stands for: single steps from 2, double steps from base 10."""
    return F.when(base < 10, base + 2).otherwise(2 * base - 7)


def round_pof2(value: Column, shift: int) -> Column:
    """To a multiple of 2^shift, halves up."""
    return F.shiftleft(F.shiftright(F.shiftright(value, shift - 1) + 1, 1), shift) if shift > 0 else value


def split_area(minx: Column, miny: Column, maxx: Column, maxy: Column, nx: int, ny: int, shift: int) -> Column:
    """Cells of a box of map units, x-major, inner borders on multiples of 2^shift; empty cells go, one cell left of several is null."""

    def borders(low: Column, high: Column, n: int) -> list[Column]:
        out = [low]
        for left in range(n, 1, -1):
            out.append(round_pof2((out[-1] + ((high - out[-1]) / left).cast("int")).cast("int"), shift))
        return [*out, high]

    xs, ys = borders(minx, maxx, nx), borders(miny, maxy, ny)
    cells = F.array(*[F.struct(a.alias("minx"), c.alias("miny"), b.alias("maxx"), d.alias("maxy")) for a, b in zip(xs[:-1], xs[1:], strict=True) for c, d in zip(ys[:-1], ys[1:], strict=True)])
    kept = F.filter(cells, lambda c: (c["minx"] < c["maxx"]) & (c["miny"] < c["maxy"]))
    return F.when((F.size(kept) == nx * ny) | (F.size(kept) > 1), kept)


def arc_length_code(units: Column, curve: Column) -> tuple[Column, Column]:
    """(flag bits, bytes) of an arc length: 10 bits while they last, else 14 (15 with a curve) or 22 bits behind a full flag."""
    byte = lambda at, mask=0xFF: F.shiftright(units, at).bitwiseAND(F.lit(mask))
    short = units < F.when(curve, 0x300).otherwise(0x400)
    flag = F.when(short, F.when(curve, 0x20).otherwise(0).bitwiseOR(byte(5, 0x18))).otherwise(0x38)
    long_ = F.array(byte(0, 0x3F).bitwiseOR(F.lit(0xC0)), byte(6), byte(14))
    middle = F.when(curve, F.array(byte(0, 0x7F), byte(7))).otherwise(F.array(byte(0, 0x3F).bitwiseOR(F.lit(0x80)), byte(6)))
    return flag, F.when(short, F.array(byte(0))).when(units >= 1 << 14, long_).otherwise(middle)


def chaikin(geometry: Column, iterations: int, ring: bool = False) -> Column:
    """Corner cutting at a quarter and three quarters of each edge; a line keeps its ends, a ring stays closed."""
    for _ in range(iterations):
        line = geometry
        edges = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("a"), F.slice(line, 2, F.size(line) - 1).alias("b"))
        at = lambda e, p, q: F.struct((p * e["a"]["x"] + q * e["b"]["x"]).alias("x"), (p * e["a"]["y"] + q * e["b"]["y"]).alias("y"))
        cut = F.flatten(F.transform(edges, lambda e: F.array(at(e, 0.75, 0.25), at(e, 0.25, 0.75))))
        made = F.concat(cut, F.slice(cut, 1, 1)) if ring else F.concat(F.slice(line, 1, 1), cut, F.slice(line, -1, 1))
        geometry = F.when(F.size(line) < 3, line).otherwise(made)
    return geometry
