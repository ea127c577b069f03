"""Registered queries of predicates, texts, numbers, geometry, levels, routing and rasters, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import lines, roads, table, view
from .functions import scalars as S
from .functions import strings as T
from .operators import features, image, kernels, levels, raster, tiles
from .operators import roads as R
from .registry import query
from .sources import vector

# --- predicates and aggregates -----------------------------------------------------------------------------------------


@query("""with t as (select cast(x as int) as "col", cast(y as int) as "row", -1 + x * 0.5::double - 0.125::double minx, 43 + y * 0.5::double - 0.125::double miny from generate_series(0, 7) a(x), generate_series(0, 5) b(y))
  select "col", "row", cast(row_number() over (order by "row", "col") as int) as seq from t where minx <= 1.1::double and minx + 0.5::double + 0.25::double >= 0.2::double and miny <= 45::double and miny + 0.5::double + 0.25::double >= 44.1::double""")
def grid_bbox(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that meet a box, numbered in row order."""
    grid = tiles.Grid(0.5, 0.25, (-1.0, 43.0), (0.2, 44.1, 1.1, 45.0))
    return tiles.grid_tiles(spark, grid, (-1.0, 43.0, 3.0, 46.0)).select("col", "row", "seq")


@query("""select p_partkey as id, p_size % 5 not in (1, 2) as finite, p_size % 9 >= case p_size % 3 when 0 then 4 when 1 then 2 else 1 end as not_empty, p_size >= 16 as large, p_size * p_size / 2::double >= 300 as wide,
  p_size % 4 >= 2 and p_size % 9 >= 2 as routable, cast(case when p_size % 6 <= 2 then p_size % 6 + 1 else 3 end as int) as known from part""")
def feature_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """F16, F21-F23, F25, F27 on made geometries."""
    k = F.col("p_size")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    bad = F.when(k % 5 == 1, F.lit(float("nan"))).when(k % 5 == 2, F.lit(float("inf"))).otherwise(F.lit(1.0))
    n = k % 9
    line = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: p(i, i))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    kind = F.when(k % 3 == 0, "Polygon").when(k % 3 == 1, "LineString").otherwise("Point")
    triangle = F.array(p(F.lit(0), F.lit(0)), p(k, F.lit(0)), p(F.lit(0), k), p(F.lit(0), F.lit(0)))
    attrs = F.when(k % 4 >= 2, F.create_map(F.lit("RoadID"), F.lit("1"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))
    held = F.map_from_arrays(F.sequence(F.lit(0), k % 6), F.transform(F.sequence(F.lit(0), k % 6), lambda i: F.array(i)))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), features.finite(F.array(p(bad, F.lit(1)))).alias("finite"), levels.not_empty(kind, line).alias("not_empty"), levels.large_enough(triangle, 1, F.lit(4)).alias("large"),
        levels.area_at_least(triangle, 300.0).alias("wide"), (F.map_contains_key(attrs, F.lit("RoadID")) & (F.size(line) >= 2)).alias("routable"), F.size(levels.known_levels(held, F.lit(3))).alias("known"),
    )


@query("select case p_size % 5 when 0 then 'Point' when 1 then 'LineString' when 2 then 'Polygon' end as kind, count(*) as n from part where p_size % 5 < 3 group by 1")
def geometry_types(spark: SparkSession, sf: str) -> DataFrame:
    """Simple types with the third dimension dropped, counted."""
    k = F.col("p_size") % 5
    kind = F.when(k == 0, F.when(F.col("p_size") % 2 == 0, "Point").otherwise("Point25D")).when(k == 1, "LineStringZ").when(k == 2, "Polygon").when(k == 3, "CurvePolygon")
    return features.counted(features.supported(table(spark, sf, "part").withColumn("geom_type", kind))[0]).select(F.col("geom_type").alias("kind"), "n")


@query("""with m as (select case p_size % 4 when 0 then 'MultiPoint' when 1 then 'MultiLineString' when 2 then 'MultiPolygon' else 'Point' end kind from part) select kind, count(*) as n from m where kind <> 'Point' group by rollup (kind)""")
def multi_geometries(spark: SparkSession, sf: str) -> DataFrame:
    """A3."""
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "MultiPoint").when(k == 1, "MultiLineString").when(k == 2, "MultiPolygon").otherwise("Point")
    return features.decomposed(table(spark, sf, "part").withColumn("geom_type", kind)).select(F.col("geom_type").alias("kind"), "n")


@query("""select p_brand as layer, count(*) as n, min(p_size) as minx, max(p_size + p_partkey % 7) as maxx from part group by 1""")
def layer_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Count and extent of every layer."""
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.count("*").alias("n"), F.min("p_size").alias("minx"), F.max(F.col("p_size") + F.col("p_partkey") % 7).alias("maxx"))


# --- texts and codes ---------------------------------------------------------------------------------------------------


@query("""select p_partkey as id, cast(p_size as varchar) as whole, case when p_size % 2 = 0 then cast(p_size // 2 as varchar) else (p_size // 2) || '.5' end as number, p_name as name, '' as missing, '["' || p_brand || '","x"]' as list from part""")
def stringified(spark: SparkSession, sf: str) -> DataFrame:
    """P1."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("whole"), (F.col("p_size") / 2).alias("number"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("missing"), F.array("p_brand", F.lit("x")).alias("list"))
    got = rows.select("p_partkey", features.stringified(rows, ["whole", "number", "name", "missing", "list"]).alias("m"))
    return got.select(F.col("p_partkey").alias("id"), *[F.col("m")[c].alias(c) for c in ("whole", "number", "name", "missing", "list")])


@query("""select p_partkey as id, p_partkey * 3 as code, case when p_partkey * 3 < 256 then p_partkey * 3 else (p_partkey * 3) >> 8 end as type, case when p_partkey * 3 < 256 then 0 else (p_partkey * 3) & 255 end as subtype, cast(p_size as bigint) as decimal_code, cast(0 as bigint) as bad from part""")
def type_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of hexadecimal and decimal texts, their type and subtype."""
    code = S.hex_type(F.concat(F.lit(" 0x"), F.hex(F.col("p_partkey") * 3)))
    a, b = S.type_parts(code)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.alias("code"), a.alias("type"), b.alias("subtype"), S.hex_type(F.col("p_size").cast("string")).cast("long").alias("decimal_code"), S.hex_type(F.lit("0xzz")).cast("long").alias("bad"))


@query("""with c as (select p_partkey as id, p_name, case when p_size = 1 then 6956 when p_size % 2 = 0 then p_size + 40 else p_size end n from part)
  select id, 'A ' || chr(cast(case when n = 6956 then 28 when n >= 42 then n - 41 else n end as int)) || p_name as label from c""")
def label_unescape(spark: SparkSession, sf: str) -> DataFrame:
    """T5: codes of labels, the long one, and those that lie higher."""
    k = F.col("p_size")
    n = F.when(k == 1, 0x1B2C).when(k % 2 == 0, k + 40).otherwise(k)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.unescaped(F.concat(F.lit("A ~[0x"), F.lower(F.hex(n)), F.lit("]"), "p_name")).alias("label"))


@query("""select p_partkey as id, case p_partkey % 4 when 0 then 'db' || p_size when 1 then p_name || '.gpkg' when 2 then 'f' || p_size || '.json' else 'x' || p_size || '.shp' end as name from part""")
def source_names(spark: SparkSession, sf: str) -> DataFrame:
    """T7."""
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("PG:host=h dbname=db"), n, F.lit(" user=u"))).when(k == 1, F.concat(F.lit("/data/a/"), "p_name", F.lit(".gpkg"))).when(k == 2, F.concat(F.lit("https://h.example.org/d/f"), n, F.lit(".json?q=1"))).otherwise(F.concat(F.lit("C:\\data\\x"), n, F.lit(".shp")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.source_name(text).alias("name"))


@query("""select p_partkey as id, 'POINT (' || p_size || ' ' || (p_size // 2) || case when p_size % 2 = 0 then '' else '.5' end || ')' as point, 'LINESTRING (0 0, ' || p_size || ' 1)' as line, 'POLYGON ((0 0, ' || p_size || ' 0, 0 1, 0 0))' as area from part""")
def wkt_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of geometries; open rings are closed."""
    k = F.col("p_size").cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, one = F.lit(0.0), F.lit(1.0)
    ring = features.closed(F.array(p(zero, zero), p(k, zero), p(zero, one)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), features.wkt(F.lit("Point"), F.array(p(k, k / 2))).alias("point"), features.wkt(F.lit("LineString"), F.array(p(zero, zero), p(k, one))).alias("line"), features.wkt(F.lit("Polygon"), ring).alias("area"))


@query("""select p_partkey as id, case when p_size % 3 = 0 then null else 'k' || p_size end as key, case when p_size % 3 = 0 then null else p_name || '=x' end as value from part""")
def key_values(spark: SparkSession, sf: str) -> DataFrame:
    """T12."""
    n = F.col("p_size")
    line = F.when(n % 3 == 0, F.concat(F.lit("no sign "), "p_name")).otherwise(F.concat(F.lit("  k"), n.cast("string"), F.lit(" =  "), "p_name", F.lit("=x ")))
    key, value = T.key_value(line)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), key.alias("key"), value.alias("value"))


@query("""select p_partkey as id, case when p_size > 0 then cast(p_size * 5 as bigint) end as height, cast(p_size * 1000 as bigint) as weight, cast(null as bigint) as none, cast(p_size * (360.0::double / 16777216) as double) as degrees,
    cast(round(p_size / 10::double * 1073741824 / 360) as int) as fine from part""")
def restrictions(spark: SparkSession, sf: str) -> DataFrame:
    """Restrictions in hundredths and thousandths, map units to degrees, 30-bit units."""
    k = F.col("p_size")
    metres = S.number((k / 20).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.hundredths(metres).alias("height"), S.hundredths(S.number(k.cast("string")), 1000).alias("weight"), S.hundredths(S.number(F.lit(" 3"))).alias("none"), S.unit_degrees(k).alias("degrees"), S.high_precision(k / 10).alias("fine"))


# --- geometry ----------------------------------------------------------------------------------------------------------


@query("select id, round(lon, 8) as mercator_lon, round(lat, 8) as mercator_lat, round(lon, 7) as lambert_lon, round(lat, 7) as lambert_lat, round(lon, 7) as utm_lon, round(lat, 7) as utm_lat from v_points", "v_points")
def reprojections(spark: SparkSession, sf: str) -> DataFrame:
    """G1: three systems, there and back."""
    p = view(spark, sf, "v_points")
    lon, lat = F.col("lon"), F.col("lat")
    there = p.select("id", (F.radians(lon) * vector.A).alias("mx"), (F.ln(F.tan(F.radians(lat) / 2 + np.pi / 4)) * vector.A).alias("my"), *[c.alias(n) for c, n in zip((*vector.to_lambert93(lon, lat), *vector.to_utm(31)(lon, lat)), ("lx", "ly", "ux", "uy"), strict=True)])
    back = (*vector.from_web_mercator(F.col("mx"), F.col("my")), *vector.from_lambert93(F.col("lx"), F.col("ly")), *vector.from_utm(31)(F.col("ux"), F.col("uy")))
    names = ("mercator_lon", "mercator_lat", "lambert_lon", "lambert_lat", "utm_lon", "utm_lat")
    return there.select("id", *[F.round(c, 8 if n.startswith("m") else 7).alias(n) for c, n in zip(back, names, strict=True)])


VALID_SQL = """case id % 7 when 0 then 'valid' when 1 then 'repaired' when 2 then 'repaired' when 3 then 'repaired' when 4 then 'rejected' when 5 then 'rejected' else 'repaired' end"""


@query(f"""with g as (select id, min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 from v_rings group by 1)
  select id, {VALID_SQL} as state, round(case when id % 7 in (4, 5) then 0 when id % 7 = 6 then (x1 - x0) * (y1 - y0) / 4 else (x1 - x0) * (y1 - y0) end, 9) as area from g""", "v_rings")
def repaired_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Rings that are whole, open, with a spike, with repeats, flat, not finite, and crossing themselves (a bow tie keeps one half)."""

    def spoiled(p: np.ndarray, o: dict) -> list[np.ndarray]:
        k = o["id"] % 7
        a, b, c, d = p[:4]
        far = b + (b - a)
        made = [p, p[:4], np.array([a, b, far, b, c, d, a]), np.array([a, a, b, b, c, d, d, a]), np.array([a, b, a, b, a]), np.array([a, b, [np.nan, 1.0], d, a]), np.array([a, c, b, d, a])][k]
        state, ring = kernels.validate("Polygon", made)
        code = ("valid", "repaired", "rejected").index(state)
        return [np.vstack([[code, 0.0], ring if ring is not None else np.zeros((0, 2))])]

    g = lines(spark, sf, ("id",), "v_rings")
    out = kernels.mapped(g, spoiled, options=("id",))
    code = F.get("geometry", F.lit(0))["x"]
    area = S.polygon_area(F.slice("geometry", 2, 1000))
    return out.select("id", F.when(code == 0, "valid").when(code == 1, "repaired").otherwise("rejected").alias("state"), F.round(area, 9).alias("area"))


@query("""with g as (select id, id % 4 * 2 as s, min(lon) a, min(lat) b, max(lon) c, max(lat) d from v_rings group by 1),
  u as (select id, s, cast(round(a * 100) as int) a, cast(round(b * 100) as int) b, cast(round(c * 100) as int) c, cast(round(d * 100) as int) d from g),
  r as (select id, s, case when s = 0 then a else (a + ((1 << s) >> 1)) & -(1 << s) end a, case when s = 0 then b else (b + ((1 << s) >> 1)) & -(1 << s) end b, case when s = 0 then c else (c + ((1 << s) >> 1)) & -(1 << s) end c, case when s = 0 then d else (d + ((1 << s) >> 1)) & -(1 << s) end d from u)
  select id, cast(5 as int) as points, cast(abs((c - a) * (d - b)) as double) as area from r where s = 0 or (greatest(c - a, d - b) >= (1 << s) and c > a and d > b)""", "v_rings")
def level_filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes of four levels through rounding, least size, obsolete points and too few points."""

    def run(p: np.ndarray, o: dict) -> list[np.ndarray]:
        units = np.sign(p) * np.floor(np.abs(p * 100) + 0.5)  # halves away from zero
        kept = kernels.level_filters(units.astype(int), True, int(o["id"] % 4 * 2), None)
        return [] if kept is None else [kept.astype(float)]

    out = kernels.mapped(lines(spark, sf, ("id",), "v_rings"), run, options=("id",))
    return out.select("id", F.size("geometry").alias("points"), S.polygon_area(F.col("geometry")).alias("area"))


@query("""with recursive b as (select road_id, list(cast(round(lon * 1000) as bigint) order by pt_idx) xs, list(cast(round((lat - 45) * 1000) as bigint) order by pt_idx) ys, count(*) n from v_vertices group by 1),
  s as (select road_id, xs, ys, n, case when n > 2 then [[1, n]] else [] end todo, 2 kept from b union all
    select road_id, xs, ys, n, case when m > 166.4::double then todo[2:] || list_filter([[a, k], [k, z]], lambda q : q[2] - q[1] >= 2) else todo[2:] end, case when m > 166.4::double then kept + 1 else kept end
    from (select *, a + list_position(d, m) k from (select *, list_max(d) m from (select *, list_transform(generate_series(a + 1, z - 1), lambda i :
      case when xs[a] = xs[z] and ys[a] = ys[z] then sqrt(power(xs[i] - xs[a], 2) + power(ys[i] - ys[a], 2))
      else abs((xs[i] - xs[a]) * (ys[z] - ys[a]) - (ys[i] - ys[a]) * (xs[z] - xs[a])) / sqrt(power(xs[z] - xs[a], 2) + power(ys[z] - ys[a], 2)) end) d from (select *, todo[1][1] a, todo[1][2] z from s where len(todo) > 0)))))
  select road_id, cast(case when n = 1 then 1 else max(kept) end as int) as points from s group by road_id, n""", "v_vertices")
def map_unit_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """Douglas-Peucker on whole units with distances to the straight line, the tolerance of a level."""

    def run(p: np.ndarray, _: dict) -> list[np.ndarray]:
        units = np.round((p - [0, 45]) * 1000)
        return [units[kernels.douglas_peucker(units, 2.6 * 2**6, kernels.line_distance)]]

    return kernels.mapped(lines(spark, sf), run).select("road_id", F.size("geometry").alias("points"))


@query("""with recursive n as (select o_orderkey as id, cast(o_custkey as int) as n from orders),
c as (select id, n, 0 k, 0 s, case when n <= 250 then n when n < 500 then n // 2 + 1 else 250 end e from n
  union all select id, n, k + 1, e - 1, case when n - (e - 1) <= 250 then n when n - (e - 1) < 500 then e - 1 + (n - (e - 1)) // 2 + 1 else e - 1 + 250 end from c where e < n),
m as (select *, n // 3 as nn from c where n > 1),
p as (select *, least((s * (nn - 1) + (n - 1) // 2) // (n - 1), nn - 1) a, least(least(((e - 1) * (nn - 1) + (n - 1) // 2) // (n - 1), nn - 1) + 1, nn) b from m where nn >= 2)
select id, cast(k as int) as chunk, cast(a as int) as start_idx, cast(b as int) as end_idx from p where b >= a + 2""")
def level_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The part of a coarser level that belongs to each chunk of a line."""
    n = F.col("o_custkey").cast("int")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n"), F.floor(n / 3).cast("int").alias("nn"), F.posexplode(R.line_chunks(n)).alias("chunk", "c"))
    at = R.level_bounds(F.col("c.start"), F.col("c.end"), F.col("n"), F.col("nn"))
    return o.withColumn("at", at).where("at is not null").select("id", "chunk", F.col("at.start").alias("start_idx"), F.col("at.end").alias("end_idx"))


@query("""with g as (select id, min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 from v_rings group by 1) select id, round((least(x1, 0.5) - x0) * (y1 - y0), 9) as area from g where x0 < 0.5""", "v_rings")
def half_plane_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes against one edge."""
    out = kernels.mapped(lines(spark, sf, ("id",), "v_rings"), lambda p, _: [q for q in [kernels.clip_half(p[:-1], 0, 0.5, True)] if len(q) >= 3 and kernels.area2(q)])
    return out.select("id", F.round(S.polygon_area(F.col("geometry")), 9).alias("area"))


@query("""with g as (select id, min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 from v_rings group by 1),
  u as (select id, cast(round(x0 * 1000) as int) x0, cast(round((y0 - 43) * 1000) as int) y0, cast(round(x1 * 1000) as int) x1, cast(round((y1 - 43) * 1000) as int) y1 from g),
  p as (select cast(i * 2 + j + 1 as int) parent, -1000 + i * 2050 a, j * 1600 b, -1000 + i * 2050 + 2050 c, j * 1600 + 1600 d from generate_series(0, 1) v(i), generate_series(0, 1) w(j))
  select id, parent, round(cast(least(x1, c) - greatest(x0, a) as double) * (least(y1, d) - greatest(y0, b)), 3) as area from u join p on x0 <= c and x1 >= a and y0 <= d and y1 >= b where least(x1, c) >= greatest(x0, a) and least(y1, d) >= greatest(y0, b)""", "v_rings")
def polygon_parents(spark: SparkSession, sf: str) -> DataFrame:
    """X11: the part of a shape in every parent it meets."""
    units = F.transform("geometry", lambda p: F.struct(F.round(p["x"] * 1000).cast("double").alias("x"), F.round((p["y"] - 43) * 1000).cast("double").alias("y")))
    shapes = lines(spark, sf, ("id",), "v_rings").select("id", units.alias("geometry"))
    boxes = [(i * 2 + j + 1, -1000 + i * 2050, j * 1600, -1000 + i * 2050 + 2050, j * 1600 + 1600) for i in range(2) for j in range(2)]
    parents = spark.createDataFrame(boxes, "parent int, p_minx int, p_miny int, p_maxx int, p_maxy int")
    out = image.shapes_by_parent(shapes, parents, "id", side=512)
    return out.select("id", "parent", F.round(S.polygon_area(F.col("geometry")), 3).alias("area"))


# --- cells and chunks --------------------------------------------------------------------------------------------------


@query("""select o_orderkey as item, cast(case when x < 2000 then 1 else 2 end + case when y < 1500 then 0 else 2 end as int) as parent from (select o_orderkey, o_orderkey * 7919 % 4000 x, o_orderkey * 104729 % 3000 y from orders)""")
def parent_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The parent box of every midpoint, right sides open."""
    k = F.col("o_orderkey")
    items = table(spark, sf, "orders").select(k.alias("item"), (k * 7919 % 4000).alias("x"), (k * 104729 % 3000).alias("y"))
    boxes = [(1, 0, 0, 2000, 1500), (2, 2000, 0, 4000, 1500), (3, 0, 1500, 2000, 3000), (4, 2000, 1500, 4000, 3000)]
    return levels.pick_parent(items, spark.createDataFrame(boxes, "parent int, p_minx int, p_miny int, p_maxx int, p_maxy int"), "item", side=256)


@query("select p_partkey as cell, p_brand as parent, p_partkey = max(p_partkey) over (partition by p_brand) as is_last from part")
def last_cells(spark: SparkSession, sf: str) -> DataFrame:
    """W10."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("parent"))
    return levels.last_children(rows, "parent", "cell")


@query("""select p_partkey as cell, cast(75 as int) as type_code, cast(0 as int) as seq, p_size || ' ' || 0 || ',' || (p_size + 10) || ' ' || 0 || ',' || (p_size + 10) || ' ' || 5 || ',' || p_size || ' ' || 5 as ring from part""")
def background_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """G29."""
    k = F.col("p_size")
    cells = table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), k.alias("minx"), F.lit(0).alias("miny"), (k + 10).alias("maxx"), F.lit(5).alias("maxy"))
    ring = F.array_join(F.transform("geometry", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",")
    return image.backgrounds(cells).select("cell", "type_code", "seq", ring.alias("ring"))


@query("""select l_orderkey as feature, l_linenumber as chunk, cast(l_suppkey % 3 as int) as cell, case when row_number() over (partition by l_suppkey % 3, l_orderkey order by l_linenumber) = 1 then l_orderkey else 0 end as label, l_orderkey % 2 = 0 as extended
  from (select l_orderkey, l_linenumber, min(l_suppkey) l_suppkey from lineitem group by 1, 2)""")
def chunk_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of split lines by cell, and which go to the extended section."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    rows = rows.select(F.col("l_orderkey").alias("feature"), F.col("l_linenumber").alias("chunk"), (F.col("s") % 3).cast("int").alias("cell"), F.col("l_orderkey").alias("label"), F.when(F.col("l_orderkey") % 2 == 0, 0x10001).otherwise(6).alias("type_code"))
    return image.labelled_chunks(rows, "cell", "feature", "chunk", "label").select("feature", "chunk", "cell", "label", "extended")


@query("""select id, cast(case when n >= 4 and closed then n - 1 else n end as int) as points from (select p_partkey as id, p_size % 6 + 2 n, p_size % 2 = 0 closed from part)""")
def open_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of over three points lose their repeated end."""
    n = F.col("p_size") % 6 + 2
    ring = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i == n) & (F.col("p_size") % 2 == 0), F.lit(1)).otherwise(i))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.size(image.open_ring(ring)).alias("points"))


@query("""with v as (select o_orderkey as id, cast(o_custkey % 700 + 2 as int) n from orders), c as (select id, n, unnest(case when n <= 250 then [[0, n]] when n < 500 then [[0, n // 2 + 1], [n // 2, n]] else null end) c from v)
  select id, cast(c[1] as int) as start_idx, len(list_filter(generate_series(c[1], c[2] - 1), lambda i : i % 10 = 0)) as nodes, c[2] = n as ends from c""")
def chunk_node_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Node flags of the chunks of a line, and which chunk ends it."""
    n = (F.col("o_custkey") % 700 + 2).cast("int")
    rows = table(spark, sf, "orders").where(n < 500).select(F.col("o_orderkey").alias("id"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i % 10 == 0).alias("flags"), F.explode(R.line_chunks(n)).alias("c"))
    own, ends = image.chunk_flags(F.col("flags"), F.col("c.start"), F.col("c.end"))
    return rows.select("id", F.col("c.start").alias("start_idx"), F.size(F.filter(own, lambda x: x)).cast("long").alias("nodes"), ends.alias("ends"))


@query("""select l_orderkey as road, array_to_string(list(c || ':' || p order by c, p), ',') as refs from (select l_orderkey, l_suppkey % 5 c, l_partkey p from lineitem) group by 1""")
def road_references(spark: SparkSession, sf: str) -> DataFrame:
    """Cells and polyline numbers of every road."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("road"), (F.col("l_suppkey") % 5).alias("cell"), F.col("l_partkey").alias("polyline"))
    got = image.road_references(rows, [])
    return got.select("road", F.array_join(F.transform("refs", lambda x: F.concat_ws(":", x["cell"], x["polyline"])), ",").alias("refs"))


@query("""select road_id, pt_idx, dx, dy from (select road_id, pt_idx, cast(lead(round(lon * 500)) over w - round(lon * 500) as int) dx, cast(lead(round((lat - 45) * 300)) over w - round((lat - 45) * 300) as int) dy from v_vertices window w as (partition by road_id order by pt_idx)) where dx is not null""", "v_vertices")
def delta_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of lines as bit streams, read back."""

    def run(p: np.ndarray, _: dict) -> list[np.ndarray]:
        units = np.round((p - [0, 45]) * [500, 300]).astype(int)
        steps = [tuple(s) for s in np.diff(units, axis=0).tolist()]
        stream = image.shortest_stream(steps)
        return [] if stream is None else [np.array(image.read_stream(stream, len(steps)), float)]

    out = kernels.mapped(lines(spark, sf), run).select("road_id", F.posexplode("geometry").alias("pt_idx", "p"))
    return out.select("road_id", F.col("pt_idx").cast("long").alias("pt_idx"), F.col("p.x").cast("int").alias("dx"), F.col("p.y").cast("int").alias("dy"))


# --- routing -------------------------------------------------------------------------------------------------------------


@query("""with q as (select *, cast(round(lat * 1e7) as int) lat_q, cast(round(lon * 1e7) as int) lon_q, max(pt_idx) over (partition by road_id) last_idx from v_vertices),
  j as (select *, count(*) over (partition by lat_q, lon_q, level) uses, max(case when level = 0 and pt_idx = 1 then 1 else 0 end) over (partition by level) named from q)
  select road_id, pt_idx, case when named = 1 then level = 0 and pt_idx = 1 else pt_idx = 0 or pt_idx = last_idx or uses >= 2 end as is_node from j""", "v_vertices")
def node_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Where some road of a tile names nodes, only named ones count; else ends and junctions (here a tile is a level)."""
    points = roads(spark, sf).withColumn("explicit", (F.col("level") == 0) & (F.col("pt_idx") == 1)).withColumn("tile", F.col("level"))
    return image.node_flags(points, ["tile"]).select("road_id", "pt_idx", "is_node")


@query("""with n as (select level, lat, lon, min(road_id * 100 + pt_idx) f from v_vertices where pt_idx % 2 = 0 group by 1, 2, 3)
  select level, cast(round(lat * 100) as int) as lat_u, cast(round(lon * 100) as int) as lon_u, cast(row_number() over (partition by level order by f) - 1 as int) as node from n""", "v_vertices")
def node_index(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of node places by first appearance."""
    points = view(spark, sf, "v_vertices").withColumns({"is_node": F.col("pt_idx") % 2 == 0, "lat_u": F.round(F.col("lat") * 100).cast("int"), "lon_u": F.round(F.col("lon") * 100).cast("int")})
    return image.node_index(points, ["level"], ["road_id", "pt_idx"])


@query("""with n as (select distinct level, cast(round(lat * 100) as int) la, cast(round(lon * 100) as int) lo from v_vertices)
  select level, la as lat_u, lo as lon_u, cast(row_number() over (partition by level order by lo, la) - 1 as int) as place from n where la % 3 = 0 and lo % 5 > 0""", "v_vertices")
def boundary_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary nodes of a group above 0, by longitude and latitude."""
    n = view(spark, sf, "v_vertices").select("level", F.round(F.col("lat") * 100).cast("int").alias("lat_u"), F.round(F.col("lon") * 100).cast("int").alias("lon_u")).distinct()
    n = n.withColumn("boundary", F.col("lat_u") % 3 == 0).withColumn("node_group", F.col("lon_u") % 5)
    return image.boundary_nodes(n, ["level"], high_only=True).select("level", "lat_u", "lon_u", "place")


@query("""select p_partkey as id, p_size % 2 = 0 and p_size % 4 <> 2 as net, p_size % 2 = 0 and p_size % 4 <> 2 and p_size % 12 <> 4 as nod from part""")
def routing_modes(spark: SparkSession, sf: str) -> DataFrame:
    """R8."""
    k = F.col("p_size")
    mode = F.when(k % 4 == 2, "disabled").when(k % 12 == 4, "net-only").when(k % 12 == 8, "route").otherwise("auto")
    net, nod = image.routing_parts(mode, k % 2 == 0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), net.alias("net"), nod.alias("nod"))


@query("""with k as (select road_id, pt_idx, cast(round(lat * 1e7) as int) la, cast(round(lon * 1e7) as int) lo, cast(round(lon * 100) as int) % 20 node from v_vertices),
  f as (select node, arg_min([la, lo], road_id * 100 + pt_idx) c from k group by 1) select road_id, pt_idx, c[1] as lat_q, c[2] as lon_q from k join f using (node)""", "v_vertices")
def node_interning(spark: SparkSession, sf: str) -> DataFrame:
    """Every node takes the coordinate of the first road that names it."""
    v = view(spark, sf, "v_vertices").select("road_id", "pt_idx", S.quantize(F.col("lat")).alias("lat_q"), S.quantize(F.col("lon")).alias("lon_q"), (F.round(F.col("lon") * 100).cast("int") % 20).alias("node_id"))
    return R.canonical_nodes(v, [], ["road_id", "pt_idx"]).select("road_id", "pt_idx", "lat_q", "lon_q")


@query("""select l_partkey as node_id, min(l_suppkey) as owner, count(distinct l_suppkey) as tiles from lineitem where l_linenumber = 1 group by 1 having count(distinct l_suppkey) > 1""")
def boundary_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes on borders that several tiles share."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("tile"), (F.col("l_linenumber") == 1).alias("boundary"))
    return R.boundary_owner(rows)


def _unit_step() -> str:
    a, b, c, d = ("{} * (360.0::double / 16777216)".format(x) for x in ("la", "lo", "na", "no"))
    flat = f"6378137.0::double * 2 * pi() / 360 * sqrt(power({a} - {c}, 2) + power(abs({b} - {d}) * cos(radians(({a} + {c}) / 2)), 2))"
    circle = f"2 * asin(sqrt(power(sin((radians({a}) - radians({c})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin((radians({b}) - radians({d})) / 2), 2))) * 6378137.0::double"
    return f"case when {flat} < 10000 then {flat} else {circle} end"


UNIT = "cast(trunc((case when {0} > 0 then {0} + 180.0::double / 16777216 else {0} - 180.0::double / 16777216 end) * 16777216 / 360) as int)"


@query(f"""with u as (select road_id, pt_idx, {UNIT.format("lat")} la, {UNIT.format("lon")} lo from v_vertices), n as (select *, lead(la) over w na, lead(lo) over w no from u window w as (partition by road_id order by pt_idx)),
  s as (select road_id, pt_idx, coalesce({_unit_step()}, 0) d from n) select road_id, cast(floor(list_sum(list(d order by pt_idx))) as int) as metres from s group by 1""", "v_vertices")
def road_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """A14."""
    return R.road_lengths(view(spark, sf, "v_vertices"), [], "road_id")


# --- elevation -----------------------------------------------------------------------------------------------------------


@query("""with s as (select p_partkey as id, p_partkey * 37 as pts, 16 * (p_size % 9 + 1) as dist from part), r as (select *, (pts + dist) // (64 * dist) f, cast(ceil(((pts + dist) - (pts + dist) // (64 * dist) * 64 * dist) / cast(dist as double)) as int) q from s)
  select id, cast(greatest(f + case when q >= 32 then 1 else 0 end, 1) as int) as tiles, cast(case when q >= 32 or f = 0 then q else q + 64 end as int) as last_points from r""")
def dem_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles along a side, the last with up to 95 points."""
    n, last = raster.tile_layout(F.col("p_partkey") * 37, 16 * (F.col("p_size") % 9 + 1))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), n.alias("tiles"), last.alias("last_points"))


@query("""with s as (select p_partkey as id, cast((p_partkey * 7919 % 4000 - 2000) * 500 as bigint) as v, 16 * (p_size % 9 + 1) as d, p_partkey % 1000 as raw from part)
  select id, case when v >= 0 then v - v % d + d else v - v % d end as top, case when v >= 0 then v - v % d else v - v % d - d end as left_side, cast((raw + 8) // 16 * 16 as int) as distance from s""")
def dem_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tops move up, left sides move left, distances to multiples of 16."""
    v, d = ((F.col("p_partkey") * 7919 % 4000 - 2000) * 500).cast("long"), 16 * (F.col("p_size") % 9 + 1)
    top, left = raster.aligned(v, v, d)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), top.alias("top"), left.alias("left_side"), raster.aligned_distance(F.col("p_partkey") % 1000).alias("distance"))


@query("""with g as (select cast(y as int) r, cast(x as int) c, 46 - y * 0.5::double lat, -1 + x * 0.75::double lon from generate_series(0, 7) a(y), generate_series(0, 5) b(x)), q as (select *, lon + 1 cf, 46 - lat rf from g), z as (select *, cast(floor(cf) as int) c0, cast(floor(rf) as int) r0 from q),
  h as (select z.r, z.c, case when c0 + 1 >= 5 or r0 + 1 >= 5 then (select h from v_raster v where v.c = cast(round(cf) as int) and v.r = cast(round(rf) as int)) else (1 - (rf - r0)) * ((1 - (cf - c0)) * a.h + (cf - c0) * b.h) + (rf - r0) * ((1 - (cf - c0)) * e.h + (cf - c0) * d.h) end h
    from z left join v_raster a on a.r = r0 and a.c = c0 left join v_raster b on b.r = r0 and b.c = c0 + 1 left join v_raster e on e.r = r0 + 1 and e.c = c0 left join v_raster d on d.r = r0 + 1 and d.c = c0 + 1)
  select r, c, cast(coalesce(round(h + 0.0), 7) as int) as h from h""", "v_raster")
def dem_samples(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of whole heights from two overlapping rasters, of which the first has voids."""
    one = view(spark, sf, "v_raster").select(F.lit("b").alias("grid"), F.lit(-1.0).alias("west"), F.lit(46.0).alias("north"), F.lit(1.0).alias("cell_lon"), F.lit(1.0).alias("cell_lat"), "r", "c", "h")
    cells = one.union(one.withColumn("grid", F.lit("a")).withColumn("h", F.lit(None).cast("double")))
    points = raster.sample_points(spark, 46.0, -1.0, 8, 6, 0.5, 0.75)
    return raster.rounded_heights(raster.sampled(points, cells, ["r", "c"]), 7).select("r", "c", "h")


@query("""select cast(y as int) as r, cast(x as int) as c, round(cast(100 + 2 * x * 20 - y * 30 as double), 3) as h from generate_series(0, 4) a(y), generate_series(0, 4) b(x)""")
def dem_reprojection(spark: SparkSession, sf: str) -> DataFrame:
    """A projected raster on a grid of degrees; on a plane of heights linear in x and y the samples are exact."""
    west, north, step = 2.9, 46.6, 0.01
    p = raster.sample_points(spark, north, west, 5, 5, step, step)
    x, y = vector.A * F.radians(F.col("lon")), vector.A * F.ln(F.tan(F.radians(F.col("lat")) / 2 + np.pi / 4))
    x0, y0 = (float(v) for v in p.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("y")).first())
    cell = 400.0
    cells = raster.sample_points(spark, y0 + 2 * cell, x0 - 2 * cell, 40, 40, cell, cell)
    # heights linear in degrees of longitude and in the latitude's own scale, so that interpolation errors stay small
    lon, lat = vector.from_web_mercator(F.col("lon"), F.col("lat"))
    h = 100 + 2 * (lon - west) / step * 20 - (north - lat) / step * 30
    cells = cells.select(F.lit("m").alias("grid"), "r", "c", h.alias("h"))
    grids = spark.createDataFrame([("m", x0 - 2 * cell, y0 + 2 * cell, cell, cell, 40, 40, "m")], "grid string, west double, north double, cell_lon double, cell_lat double, width int, height int, place string")
    forward = lambda a, b: (vector.A * F.radians(a), vector.A * F.ln(F.tan(F.radians(b) / 2 + np.pi / 4)))
    got = raster.reprojected_grid(cells, forward, (west, north - 4 * step, west + 4 * step, north), step, step, grids)
    return got.where("r < 5 and c < 5").select("r", "c", F.round("h", 3).alias("h"))
