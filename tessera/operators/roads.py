"""Road attributes, junctions, node lists and the directed arcs of a routing graph."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def route_attributes(get: Callable[[str], Column], road_id: Column | None = None) -> Column:
    """Map of routing attributes from source attributes; keys without a value are left out."""
    speed = S.speed_class(S.number(get("VIT_MOY_VL")))
    nature = get("NATURE")
    way, mark = S.one_way(get("SENS"))
    toll, closed = S.access_bits(get("ACCES_VL"))
    foot, no = S.foot_denied(get("ACCES_PED")), F.lit(0)
    param = F.concat_ws(",", *[c.cast("string") for c in (speed, S.road_class(get("CL_ADMIN"), nature), way, toll, no, no, closed, closed, no, foot, no, closed)])
    values = {"RouteParam": param, "DirIndicator": mark.cast("string"), "Roundabout": F.when(nature == "Rond-point", "1")}
    if road_id is not None:
        values["RoadID"] = road_id.cast("string")
    for name, source, factor in (("MaxHeight", "RESTR_H", 100), ("MaxWeight", "RESTR_P", 1000), ("MaxWidth", "RESTR_LAR", 100), ("MaxLength", "RESTR_LON", 100)):
        values[name] = S.hundredths(S.number(get(source)), factor).cast("string")
    made = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_filter(made, lambda k, v: v.isNotNull())


def merged(ruled: Column, routing: Column) -> Column:
    """Rule output, overridden by routing attributes, then the denied mask applied and removed."""
    kept = F.map_concat(F.map_filter(ruled, lambda k, v: ~F.map_contains_key(routing, k)), routing)
    from ..functions.strings import mask_route_param

    patched = F.transform_values(kept, lambda k, v: F.when((k == "RouteParam") & kept["denied_mask"].isNotNull(), mask_route_param(v, kept["denied_mask"])).otherwise(v))
    return F.map_filter(patched, lambda k, v: k != "denied_mask")


def road_numbers(rows: DataFrame, routable: Column, scope: list[str], order: list[str]) -> DataFrame:
    """road_no, counted from 1 over the routable rows of a tile in source order, before any rule drops rows."""
    spec = Window.partitionBy(*scope).orderBy(*order)
    return rows.withColumn("road_no", F.when(routable, F.sum(F.when(routable, 1).otherwise(0)).over(spec.rowsBetween(Window.unboundedPreceding, 0))))


def vertices(roads: DataFrame, level: Column | None = None, geometry: str = "geometry") -> DataFrame:
    """Roads to vertices: pt_idx, lon, lat, level, last_idx."""
    kept = [c for c in roads.columns if c != geometry]
    out = roads.withColumn("_level", level if level is not None else F.lit(0)).withColumn("last_idx", F.size(geometry) - 1)
    out = out.select(*kept, "_level", "last_idx", F.posexplode(geometry).alias("pt_idx", "_p"))
    return out.select(*kept, "pt_idx", F.col("_p.x").alias("lon"), F.col("_p.y").alias("lat"), F.col("_level").alias("level"), "last_idx")


def junctions(points: DataFrame, scope: list[str]) -> DataFrame:
    """vertices(road, pt_idx, lon, lat, level, last_idx) + lat_q, lon_q, uses, is_end, is_node.

    Counts per place are pre-aggregated and joined back, so a hot place costs one row and not a window over its rows.
    """
    p = points.withColumn("lat_q", S.quantize(F.col("lat"))).withColumn("lon_q", S.quantize(F.col("lon")))
    key = [*scope, "lat_q", "lon_q", "level"]
    uses = p.groupBy(*key).agg(F.count("*").alias("uses"))
    p = p.join(uses, key)
    end = (F.col("pt_idx") == 0) | (F.col("pt_idx") == F.col("last_idx"))
    return p.withColumn("is_end", end).withColumn("is_node", end | (F.col("uses") >= 2))


def node_rows(points: DataFrame, scope: list[str], road: str) -> DataFrame:
    """Node rows of every road: node_id at ends and junctions, without immediate repeats; roads with fewer than two are left out."""
    nodes = junctions(points, scope).where("is_node").withColumn("node_id", S.node_id(F.col("lat_q"), F.col("lon_q"), F.col("level")))
    along = Window.partitionBy(*scope, road).orderBy("pt_idx")
    nodes = nodes.withColumn("_before", F.lag("node_id").over(along)).where("_before is null or _before <> node_id").drop("_before")
    return nodes.withColumn("_n", F.count("*").over(Window.partitionBy(*scope, road))).where("_n >= 2").drop("_n")


def node_lists(points: DataFrame, scope: list[str], road: str, boundary: Column | None = None) -> DataFrame:
    """One row a road with its sorted array of (point_index, node_id, boundary)."""
    rows = node_rows(points, scope, road).withColumn("boundary", boundary if boundary is not None else F.lit(False))
    return rows.groupBy(*scope, road).agg(F.array_sort(F.collect_list(F.struct(F.col("pt_idx").alias("point_index"), "node_id", "boundary"))).alias("nodes"))


def canonical_nodes(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Every node row takes the coordinate of the first road (in input order) that names its node id."""
    first = rows.groupBy(*scope, "node_id").agg(F.min_by(F.struct("lat_q", "lon_q"), F.struct(*order)).alias("_first"))
    return rows.drop("lat_q", "lon_q").join(first, [*scope, "node_id"]).select("*", "_first.lat_q", "_first.lon_q").drop("_first")


def boundary_owner(rows: DataFrame, tile: str = "tile") -> DataFrame:
    """Boundary nodes that several tiles share, with the least tile."""
    return rows.where("boundary").groupBy("node_id").agg(F.min(tile).alias("owner"), F.count_distinct(tile).alias("tiles")).where("tiles > 1")


def arcs(points: DataFrame, scope: list[str], road: str) -> DataFrame:
    """Forward and reverse arcs between successive nodes of each road, on map units.

    Lengths run along all vertices; an arc to the same node or of zero whole metres is skipped and starts anew.
    """
    p = junctions(points, scope).withColumn("lat_u", S.map_units(F.col("lat"))).withColumn("lon_u", S.map_units(F.col("lon")))
    along = Window.partitionBy(*scope, road).orderBy("pt_idx")
    here, before, after = ("lat_u", "lon_u"), [F.lag(c).over(along) for c in ("lat_u", "lon_u")], [F.lead(c).over(along) for c in ("lat_u", "lon_u")]
    p = p.withColumn("_step", F.coalesce(S.unit_distance(before[0], before[1], F.col(here[0]), F.col(here[1])), F.lit(0.0)))
    p = p.withColumn("_out", S.bearing(F.col(here[0]), F.col(here[1]), *after)).withColumn("_back", S.bearing(F.col(here[0]), F.col(here[1]), *before))
    p = p.withColumn("_run", F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    n = p.where("is_node").withColumn("node", F.struct("lat_u", "lon_u"))
    for c in ("node", "_run", "_out"):
        n = n.withColumn(f"{c}_0", F.lag(c).over(along))
    n = n.withColumn("length_m", F.floor(F.col("_run") - F.col("_run_0")).cast("long")).where("node_0 is not null and node_0 <> node and length_m > 0")
    both = F.array(
        F.struct(F.col("node_0").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("forward"), S.heading_byte(F.col("_out_0")).alias("heading")),
        F.struct(F.col("node").alias("src"), F.col("node_0").alias("dst"), F.lit(False).alias("forward"), S.heading_byte(F.col("_back")).alias("heading")),
    )
    kept = [c for c in points.columns if c not in ("pt_idx", "lon", "lat", "level", "last_idx")]
    return n.select(*kept, "pt_idx", "length_m", F.explode(both).alias("_a")).select(*kept, "pt_idx", "length_m", "_a.*")


def road_lengths(points: DataFrame, scope: list[str], road: str) -> DataFrame:
    """(scope, road, metres): whole metres along the map units of all vertices, summed in their order; no geometry is gathered."""
    p = points.withColumn("lat_u", S.map_units(F.col("lat"))).withColumn("lon_u", S.map_units(F.col("lon")))
    along = Window.partitionBy(*scope, road).orderBy("pt_idx")
    before = [F.lag(c).over(along) for c in ("lat_u", "lon_u")]
    p = p.withColumn("_step", F.coalesce(S.unit_distance(*before, F.col("lat_u"), F.col("lon_u")), F.lit(0.0)))
    p = p.withColumn("_run", F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(*scope, road).agg(F.floor(F.max("_run")).cast("int").alias("metres"))


def node_class(arc_rows: DataFrame, scope: list[str], road_class: str = "road_class") -> DataFrame:
    """A11."""
    return arc_rows.groupBy(*scope, "src").agg(F.max(F.least(F.col(road_class), F.lit(4))).alias("node_class"))


def node_group(arc_rows: DataFrame, scope: list[str], road: str, road_class: str = "road_class") -> DataFrame:
    """Highest class with two or more roads, else the second-highest used class, else the only one."""
    per = arc_rows.withColumn("_c", F.least(F.col(road_class), F.lit(4))).groupBy(*scope, "src", "_c").agg((F.min(road) != F.max(road)).alias("_n"))
    used = per.groupBy(*scope, "src").agg(F.sort_array(F.collect_list(F.struct("_c", "_n")), asc=False).alias("_used"))
    busy = F.filter("_used", lambda x: x["_n"])
    group = F.when(F.size("_used") == 1, F.element_at("_used", 1)["_c"]).when(F.size(busy) > 0, F.get(busy, F.lit(0))["_c"]).otherwise(F.get("_used", F.lit(1))["_c"])
    return used.select(*scope, "src", group.alias("node_group"))


def node_classes(arc_rows: DataFrame, scope: list[str], road: str, road_class: str = "road_class") -> DataFrame:
    """R5, A11, A12 at once: (scope, src, node_class, node_group) from one aggregate of the arcs.

    Whether there are two roads shows in the least and the greatest one, so no road but these two is held or shuffled.
    """
    per = arc_rows.withColumn("_c", F.least(F.col(road_class), F.lit(4))).groupBy(*scope, "src", "_c").agg((F.min(road) != F.max(road)).alias("_n"))
    used = per.groupBy(*scope, "src").agg(F.sort_array(F.collect_list(F.struct("_c", "_n")), asc=False).alias("_used"))
    busy = F.filter("_used", lambda x: x["_n"])
    top = F.element_at("_used", 1)["_c"]
    group = F.when(F.size("_used") == 1, top).when(F.size(busy) > 0, F.get(busy, F.lit(0))["_c"]).otherwise(F.get("_used", F.lit(1))["_c"])
    return used.select(*scope, "src", top.alias("node_class"), group.alias("node_group"))


def shared_vertices(points: DataFrame, scope: list[str], feature: str) -> DataFrame:
    """Places (1e-6 degrees) that two or more features of a layer pass through."""
    keys = points.select(*scope, feature, S.snap(F.col("lon")).alias("kx"), S.snap(F.col("lat")).alias("ky")).distinct()
    return keys.groupBy(*scope, "kx", "ky").agg(F.count("*").alias("features")).where("features >= 2")


def line_chunks(n: Column, most: int = 250) -> Column:
    """Array of (start, end) chunks of a line of n points, at most `most` each, overlapping by one; the last two are balanced."""
    step = most - 1
    whole = F.greatest(F.floor((n - 2 * most) / step) + 1, F.lit(0)).cast("int")
    rest = n - whole * step
    full = F.transform(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct((k * step).cast("int").alias("start"), (k * step + most).cast("int").alias("end")))
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    at = whole * step
    half = F.floor(rest / 2)
    tail = F.when(rest <= most, F.array(pair(at, n))).otherwise(F.array(pair(at, at + half + 1), pair(at + half, n)))
    return F.when(n <= most, F.array(pair(F.lit(0), n))).otherwise(F.concat(full, tail))


def level_bounds(start: Column, end: Column, n0: Column, n: Column) -> Column:
    """The part of an n-point level that belongs to points [start, end) of the n0-point base line; null if under two points.

    Products of two numbers of points exceed 32 bits, so they are reckoned in 64.
    """
    start, end, n0, n = (c.cast("long") for c in (start, end, n0, n))
    place = lambda i: F.least(F.floor((i * (n - 1) + F.floor((n0 - 1) / 2)) / (n0 - 1)), n - 1)
    a, b = place(start), F.least(place(end - 1) + 1, n)
    return F.when((n0 > 1) & (n >= 2) & (b >= a + 2), F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))


#: Fixed limits of a route centre: side of its box in map units, distinct roads, distinct nodes outside, bytes and halvings.
CENTER_SIDE, CENTER_ROADS, CENTER_OUTSIDE, CENTER_BYTES, CENTER_DEPTH = 0xF800, 248, 254, 8192, 48


def node_bytes(length_m: Column) -> Column:
    """Upper bound of an arc's bytes in a route node; a node itself takes 6 more."""
    return F.size(S.arc_length_code(S.arc_units(length_m), F.lit(False))[1]) + 5


def split_centers(lat: np.ndarray, lon: np.ndarray, size: np.ndarray, roads: list[list[int]], dests: list[list[tuple[int, int]]]) -> list[tuple[int, int, np.ndarray]]:
    """Halve the box of nodes along its longer side until every part keeps the limits; (lat, lon, node numbers by lon, lat)."""
    out: list[tuple[int, int, np.ndarray]] = []
    todo = [(np.arange(len(lat)), 0)]
    while todo:
        own, depth = todo.pop()
        if not len(own):
            continue
        south, north, west, east = int(lat[own].min()), int(lat[own].max()) + 1, int(lon[own].min()), int(lon[own].max()) + 1
        inside = set(zip(lat[own].tolist(), lon[own].tolist(), strict=True))
        used = {r for k in own for r in roads[k]}
        away = {tuple(d) for k in own for d in dests[k]} - inside
        if max(north - south, east - west) < CENTER_SIDE and len(used) < CENTER_ROADS and len(away) < CENTER_OUTSIDE and size[own].sum() < CENTER_BYTES:
            order = own[np.lexsort((lat[own], lon[own]))]
            out.append((int((south + north) / 2), int((west + east) / 2), order))
        elif depth > CENTER_DEPTH:
            raise ValueError(f"{len(own)} route nodes at {south}, {west} do not fit a centre")
        else:
            axis, mid = (lon, int((west + east) / 2)) if east - west > north - south else (lat, int((south + north) / 2))
            low = axis[own] < mid
            todo += [(own[~low], depth + 1), (own[low], depth + 1)]
    return out


def route_centers(nodes: DataFrame, arc_rows: DataFrame, scope: list[str], road: str) -> DataFrame:
    """(scope, bucket, center, center_lat, center_lon, place, src): each node's route centre.

    `nodes`: (scope, src, node_group); nodes without arcs come first (bucket -1), then groups 0 to 4. Arcs are gathered
    per node, then the nodes of one tile and bucket are split in one task: the map format bounds a tile. Nodes that can't
    be split far enough are an error, not dropped.
    """
    out = arc_rows.groupBy(*scope, "src").agg(F.collect_set(road).alias("_roads"), F.collect_set("dst").alias("_dests"), F.sum(node_bytes(F.col("length_m"))).alias("_bytes"))
    n = nodes.join(out, [*scope, "src"], "left").withColumn("bucket", F.when(F.col("_bytes").isNull(), -1).otherwise(F.col("node_group")).cast("int"))
    n = n.select(*scope, "bucket", F.col("src.lat_u").alias("lat"), F.col("src.lon_u").alias("lon"), (6 + F.coalesce("_bytes", F.lit(0))).alias("bytes"), F.coalesce("_roads", F.array()).alias("roads"), F.coalesce("_dests", F.array()).alias("dests"))
    keys = [*scope, "bucket"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lat, lon = rows["lat"].to_numpy(), rows["lon"].to_numpy()
        dests = [[(d["lat_u"], d["lon_u"]) for d in v] for v in rows["dests"]]
        found = split_centers(lat, lon, rows["bytes"].to_numpy(), list(rows["roads"]), dests)
        parts = [pd.DataFrame({"center": c, "center_lat": a, "center_lon": b, "place": np.arange(len(own)), "lat": lat[own], "lon": lon[own]}) for c, (a, b, own) in enumerate(found)]
        made = pd.concat(parts)
        for name, v in zip(keys, key, strict=True):
            made.insert(0, name, v)
        return made[[*keys, "center", "center_lat", "center_lon", "place", "lat", "lon"]]

    kinds = ", ".join(f"`{c}` {n.schema[c].dataType.simpleString()}" for c in keys)
    return n.groupBy(*keys).applyInPandas(run, f"{kinds}, center int, center_lat int, center_lon int, place int, lat int, lon int")
