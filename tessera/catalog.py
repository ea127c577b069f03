"""Registered queries of the feature engine and the SQL that DuckDB holds them against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import lines, oracle, roads, table, view
from .functions import scalars as S
from .functions import strings as T
from .operators import features, kernels, labels, levels, raster, tiles
from .operators import roads as R
from .plans.rules import Rule, Ruleset, apply_ruleset, rule_stats, template
from .registry import ORACLES, QUERIES, query
from .sources import mp, storage


def get(name: str) -> F.Column:
    known = {"CL_ADMIN", "NATURE", "NUMERO", "VIT_MOY_VL", "SENS"}
    return F.coalesce(F.col(name), F.lit("")) if name in known else F.lit("")


# --- rules -----------------------------------------------------------------------------------------------------------

ROADS = Ruleset("TRONCON_DE_ROUTE", [
    Rule({"CL_ADMIN": "Autoroute"}, {"Type": "0x01", "Label": "~[0x04]${NUMERO}"}, "lower"),
    Rule({"CL_ADMIN": "in:Nationale, Départementale", "NATURE": "!^Rond"}, {"Type": "0x02", "Label": "${NUMERO} ${NATURE}"}),
    Rule({"CL_ADMIN": '""', "NATURE": "^i:CHEMIN"}, {"Type": "0x0a", "Label": "${NATURE}"}, "upper"),
    Rule({"CL_ADMIN": "!!", "NATURE": "!in:Bretelle,Chemin"}, {"Type": "0x${NOTHING}", "Label": "bad"}),
    Rule({"NATURE": "!Chemin", "SENS": "*"}, {"Type": "0x06", "Label": "${SENS}"}, "capitalize"),
])
RULES_SQL = """with a as (select *, coalesce(CL_ADMIN, '') ca from v_attrs),
r as (select *, case when ca = 'Autoroute' then 1 when ca in ('Nationale', 'Départementale') and not starts_with(NATURE, 'Rond') then 2
    when ca = '' and starts_with(lower(NATURE), 'chemin') then 3 when ca <> '' and NATURE not in ('Bretelle', 'Chemin') then 4 when NATURE <> 'Chemin' then 5 end rule from a),
o as (select *, case rule when 1 then '0x01' when 2 then '0x02' when 3 then '0x0a' when 4 then '0x' when 5 then '0x06' end typ,
    case rule when 1 then '~[0x04]' || lower(NUMERO) when 2 then NUMERO || ' ' || NATURE when 3 then upper(NATURE) when 4 then 'bad' when 5 then upper(substr(SENS, 1, 1)) || lower(substr(SENS, 2)) end label,
    case when rule is null then 'ignored' when rule = 4 then 'error' else 'matched' end status from r)"""


@query(RULES_SQL + " select id, rule, status, typ as type, label from o", "v_attrs")
def rules_first_match(spark: SparkSession, sf: str) -> DataFrame:
    out = apply_ruleset(view(spark, sf, "v_attrs"), ROADS)
    return out.select("id", "rule", "status", F.col("out")["Type"].alias("type"), F.col("out")["Label"].alias("label"))


@query(RULES_SQL + """ select source_layer, count(*) filter (where status = 'matched') matched, count(*) filter (where status = 'ignored') ignored,
  count(*) filter (where status = 'error') errors from o group by rollup (source_layer)""", "v_attrs")
def rules_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rule_stats(apply_ruleset(view(spark, sf, "v_attrs"), ROADS))


PATTERNS = {"any": "*", "some": "!!", "none": '""', "one_of": "in:Brand#11, Brand#22", "not_of": "!in:Brand#11,Brand#22", "not_start_ci": "!^i:brand#1", "not_start": "!^Brand#1", "start_ci": "^i:BRAND#2", "start": "^Brand#2", "not_is": "!Brand#33", "is_": "Brand#33"}


@query("""select p_partkey as id, true as any_, p_brand <> '' as some, p_brand = '' as none, p_brand in ('Brand#11', 'Brand#22') as one_of,
  p_brand not in ('Brand#11', 'Brand#22') as not_of, not starts_with(lower(p_brand), 'brand#1') as not_start_ci, not starts_with(p_brand, 'Brand#1') as not_start,
  starts_with(lower(p_brand), 'brand#2') as start_ci, starts_with(p_brand, 'Brand#2') as start, p_brand <> 'Brand#33' as not_is, p_brand = 'Brand#33' as is_ from part""")
def rules_operators(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.rules import matches

    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("id"), *[matches(F.coalesce("p_brand", F.lit("")), p).alias({"any": "any_"}.get(n, n)) for n, p in PATTERNS.items()])


@query("select p_partkey as id, 'x ' || p_brand || '-' || cast(p_size as varchar) || '' || '!' as text from part")
def rule_templates(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in part.columns else F.lit("")
    return part.select(F.col("p_partkey").alias("id"), template(read, "x ${p_brand}-${p_size}${missing}!").alias("text"))


# --- labels ----------------------------------------------------------------------------------------------------------

@query("select p_partkey as id, upper(p_name) as up, lower(p_name) as low, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) as cap, '~[0x04]' || upper(p_name) as prefixed from part")
def label_cases(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.upper(n).alias("up"), F.lower(n).alias("low"), T.capitalize(n).alias("cap"), T.label_case(F.concat(F.lit("~[0x04]"), n), "upper").alias("prefixed"))


TITLED = "replace(n_name, 'A', '-a') || ' d''eau ' || n_name"


@query(f"""select id, list_aggregate(list_transform(c, lambda x, i : case when i = 1 or c[i - 1] in (' ', '-', '''', '’') then upper(x) else lower(x) end), 'string_agg', '') as title
  from (select n_nationkey as id, string_split({TITLED}, '') c from nation)""")
def label_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), T.title_case(F.concat(F.replace(F.col("n_name"), F.lit("A"), F.lit("-a")), F.lit(" d'eau "), "n_name")).alias("title"))


@query("""select n_nationkey as id, translate(n_name || ' ' || 'ŁódźćčŠőűŋŊħĦŧŦŀĿđĐıā‐≠', 'ŁźćčőűŋŊħĦŧŦŀĿđĐıā‐≠', 'LzccounNhHtTlLdDia?=') as label from nation""")
def cp1252_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), T.cp1252(F.concat("n_name", F.lit(" ŁódźćčŠőűŋŊħĦŧŦŀĿđĐıā‐≠"))).alias("label"))


@query("""select p_partkey as id, case when p_partkey % 3 = 0 then p_name else cast(cast(round(p_size * cast(3.2808399 as double)) as bigint) as varchar) end as label from part""")
def feet_labels(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.feet_label(text).alias("label"))


# --- scans, predicates, aggregates -------------------------------------------------------------------------------------

@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) n from lineitem) where n = 1""")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    return features.dedup_first(table(spark, sf, "lineitem"), "l_linenumber", order, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select p_partkey as id, p_size from part where p_size = (p_size // 10) * 10")
def attr_filter_contour(spark: SparkSession, sf: str) -> DataFrame:
    from .sources.vector import filtered

    return filtered(table(spark, sf, "part"), "p_size = (p_size div 10) * 10").select(F.col("p_partkey").alias("id"), "p_size")


@query("""select o_orderstatus as geom_type, count(*) as n, count(distinct o_orderpriority) as total_sources,
  array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:10], '|') as sources from orders group by 1""")
def unsupported_types(spark: SparkSession, sf: str) -> DataFrame:
    out = features.unsupported_stats(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return out.select(F.col("o_orderstatus").alias("geom_type"), "n", "total_sources", F.array_join("sources", "|").alias("sources"))


@query("""select road_id, min(lon) as minx, min(lat) as miny, max(lon) as maxx, max(lat) as maxy, count(*) as points from v_vertices group by 1""", "v_vertices")
def feature_bounds(spark: SparkSession, sf: str) -> DataFrame:
    g = lines(spark, sf)
    return g.select("road_id", *features.bounds(F.col("geometry")), F.size("geometry").cast("long").alias("points"))


@query("select p_partkey as id, case when p_size % 4 = 0 then 'valid' when p_size % 4 = 1 then 'repaired' else 'rejected' end v from part".join(
    ("with s as (", ") select count(*) filter (where v = 'valid') valid, count(*) filter (where v = 'repaired') repaired, count(*) filter (where v = 'rejected') rejected, count(*) filter (where v = 'repaired') / cast(count(*) filter (where v <> 'valid') as double) recovery_rate from s")))
def validation_stats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 4
    return features.validation_stats(table(spark, sf, "part").withColumn("validity", F.when(k == 0, "valid").when(k == 1, "repaired").otherwise("rejected")))


# --- tiles -------------------------------------------------------------------------------------------------------------

GRID = tiles.Grid(0.25, 0.0625)
TILES_SQL = """e as (select min(minx) x0, min(miny) y0, max(maxx) x1, max(maxy) y1 from v_boxes),
cc as (select x0, y0, y1, unnest(generate_series(0, cast(ceil((x1 - x0) / 0.25::double) as int) - 1)) col from e),
rc as (select *, unnest(generate_series(0, cast(ceil((y1 - y0) / 0.25::double) as int) - 1)) "row" from cc),
t as (select cast(col as int) col, cast("row" as int) "row", x0 + col * 0.25::double - 0.03125::double minx, y0 + "row" * 0.25::double - 0.03125::double miny,
  x0 + col * 0.25::double - 0.03125::double + 0.25::double + 0.0625::double maxx, y0 + "row" * 0.25::double - 0.03125::double + 0.25::double + 0.0625::double maxy,
  cast(row_number() over (order by "row", col) as int) seq from rc)"""
ASSIGN = "from v_boxes f join t on f.minx <= t.maxx and f.maxx >= t.minx and f.miny <= t.maxy and f.maxy >= t.miny"


@query("select min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy, count(*) n from v_boxes", "v_boxes")
def extent(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.extent(view(spark, sf, "v_boxes"))


def _tiled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tiles.tile_features(view(spark, sf, "v_boxes"), GRID)


@query(f"""with {TILES_SQL} select seq, col, "row", minx, miny, maxx, maxy, 't_' || printf('%03d', col) || '_' || printf('%03d', "row") || '_' || cast(seq as varchar) as name, printf('%08d', 6324 * 10000 + seq) as tile_id from t""", "v_boxes")
def grid_tiles(spark: SparkSession, sf: str) -> DataFrame:
    t = _tiled(spark, sf)[0]
    return t.withColumn("name", tiles.tile_name("t_{col:3}_{y:3}_{seq}", F.col("col"), F.col("row"), F.col("seq"))).withColumn("tile_id", tiles.tile_id(6324, F.col("seq")))


@query(f"""with {TILES_SQL} select f.id, t.seq {ASSIGN}""", "v_boxes")
def tile_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _tiled(spark, sf)[1].select("id", "seq")


@query(f"""with {TILES_SQL} select t.col, t."row", count(*) as features {ASSIGN} group by 1, 2""", "v_boxes")
def tile_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _tiled(spark, sf)[1].groupBy("col", "row").agg(F.count("*").alias("features"))


@query(f"""with {TILES_SQL} select distinct f.id {ASSIGN} where (t.col + t."row") % 5 = 0""", "v_boxes")
def spatial_semi(spark: SparkSession, sf: str) -> DataFrame:
    t, near = _tiled(spark, sf)
    return view(spark, sf, "v_boxes").join(near.where("(col + row) % 5 = 0").select("id").distinct(), "id", "left_semi").select("id")


@query(f"""with {TILES_SQL} select seq from t where seq % 3 <> 0""", "v_boxes")
def skip_existing_anti(spark: SparkSession, sf: str) -> DataFrame:
    t = _tiled(spark, sf)[0].withColumn("name", F.col("seq").cast("string"))
    return tiles.missing_tiles(t, t.where("seq % 3 = 0")).select("seq")


@query("""select id, abs(lat - 44) < 5e-8 or abs(lat - 45) < 5e-8 or abs(lon - 0) < 5e-8 or abs(lon - 1) < 5e-8 as boundary from v_points""", "v_points")
def boundary_points(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "v_points").withColumns({"s_minx": F.lit(0.0), "s_maxx": F.lit(1.0), "s_miny": F.lit(44.0), "s_maxy": F.lit(45.0)})
    return p.select("id", tiles.on_boundary(F.col("lon"), F.col("lat")).alias("boundary"))


# --- flagship ----------------------------------------------------------------------------------------------------------

FLAG_SQL = RULES_SQL + """, k as (select * from (select *, row_number() over (partition by NUMERO, VIT_MOY_VL, rule order by id) n from o where NATURE <> 'Bretelle') where n = 1 and status = 'matched'),
b as (select id, min(lon) minx, min(lat) miny, max(lon) maxx, max(lat) maxy from v_rings group by 1),
v_boxes as (select k.id, typ, cast(VIT_MOY_VL as double) v, minx, miny, maxx, maxy from k join b using (id)), """ + TILES_SQL + """
select t.col, t."row", typ as type, case when v < 10 then 0 when v < 20 then 1 when v < 30 then 2 when v < 45 then 3 when v < 60 then 4 when v < 75 then 5 when v < 95 then 6 else 7 end as speed, count(*) as roads """ + ASSIGN + " group by all"


@query(FLAG_SQL, "v_attrs", "v_rings")
def classified_roads(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, filter, first-match rules, dedup, routing class, extent, tile join and count."""
    a = view(spark, sf, "v_attrs").where("NATURE <> 'Bretelle'")
    ruled = features.dedup_first(apply_ruleset(a, ROADS), "NUMERO", ["id"], ["VIT_MOY_VL", "rule"]).where("status = 'matched'")
    box = view(spark, sf, "v_rings").groupBy("id").agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))
    f = ruled.select("id", F.col("out")["Type"].alias("type"), S.speed_class(S.number(get("VIT_MOY_VL"))).alias("speed")).join(box, "id")
    return tiles.tile_features(f, GRID)[1].groupBy("col", "row", "type", "speed").agg(F.count("*").alias("roads"))


# --- roads -------------------------------------------------------------------------------------------------------------

@query("""with a as (select *, cast(VIT_MOY_VL as double) v,
    coalesce(case CL_ADMIN when 'Autoroute' then 4 when 'Nationale' then 3 when 'Départementale' then 2 when 'Route intercommunale' then 1 end, case NATURE when 'Type autoroutier' then 4 when 'Chemin' then 0 else 1 end) rc,
    case SENS when 'Sens direct' then 1 when 'Sens inverse' then -1 else 0 end d from v_attrs)
  select id, (case when v < 10 then 0 when v < 20 then 1 when v < 30 then 2 when v < 45 then 3 when v < 60 then 4 when v < 75 then 5 when v < 95 then 6 else 7 end) || ',' || rc || ',' || abs(d) || ',0,0,0,0,0,0,0,0,0' as route_param,
    cast(d as varchar) as dir_indicator, case when NATURE = 'Rond-point' then '1' end as roundabout,
    (case when v < 10 then 0 when v < 20 then 1 when v < 30 then 2 when v < 45 then 3 when v < 60 then 4 when v < 75 then 5 when v < 95 then 6 else 7 end) || ',' || rc || ',' || abs(d) || ',0,1,0,1,0,0,0,0,1' as masked,
    133 as access_mask from a""", "v_attrs")
def route_params(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "v_attrs").withColumn("m", R.route_attributes(get)).withColumn("p", F.col("m")["RouteParam"])
    masked = R.merged(F.create_map(F.lit("denied_mask"), F.lit("10100001")), F.col("m"))["RouteParam"]
    return a.select("id", F.col("p").alias("route_param"), F.col("m")["DirIndicator"].alias("dir_indicator"), F.col("m")["Roundabout"].alias("roundabout"), masked.alias("masked"), S.access_mask(masked).alias("access_mask"))


@query("""select id, cast(case when p_size % 2 = 0 then sum(case when p_size % 2 = 0 then 1 else 0 end) over (partition by NUMERO order by id rows unbounded preceding) end as bigint) as road_no from v_attrs""", "v_attrs")
def road_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return R.road_numbers(view(spark, sf, "v_attrs"), F.col("p_size") % 2 == 0, ["NUMERO"], ["id"]).select("id", "road_no")


def _fnv(lat: str, lon: str, level: str) -> str:
    h = "69346085"
    for v in (lat, lon, level):
        for k in range(4):
            h = f"((xor(cast({h} as bigint), (((cast({v} as bigint) + 4294967296) % 4294967296) >> {8 * k}) & 255) * 435) & 2147483647)"
    return f"cast(greatest({h}, 1) as int)"


Q = "cast(round({} * 1e7) as int)"


@query(f"select id, {_fnv(Q.format('lat'), Q.format('lon'), '0')} as node_id from v_points", "v_points")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "v_points")
    return p.select("id", S.node_id(S.quantize(F.col("lat")), S.quantize(F.col("lon")), F.lit(0)).alias("node_id"))


JUNCTION_SQL = f"""j as (select *, {Q.format('lat')} lat_q, {Q.format('lon')} lon_q, max(pt_idx) over (partition by road_id) last_idx from v_vertices),
n as (select *, count(*) over (partition by lat_q, lon_q, level) uses, pt_idx = 0 or pt_idx = last_idx is_end from j)"""


@query(f"with {JUNCTION_SQL} select road_id, pt_idx, uses, is_end, is_end or uses >= 2 as is_node from n", "v_vertices")
def junctions(spark: SparkSession, sf: str) -> DataFrame:
    return R.junctions(roads(spark, sf), []).select("road_id", "pt_idx", "uses", "is_end", "is_node")


@query(f"""with {JUNCTION_SQL}, i as (select *, {_fnv('lat_q', 'lon_q', 'level')} node_id from n where is_end or uses >= 2),
l as (select *, lag(node_id) over (partition by road_id order by pt_idx) b from i), k as (select *, count(*) over (partition by road_id) c from l where b is null or b <> node_id)
select road_id, pt_idx, node_id from k where c >= 2""", "v_vertices")
def road_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return R.node_rows(roads(spark, sf), [], "road_id").select("road_id", "pt_idx", "node_id")


@query("""with k as (select distinct road_id, cast(round(lon * 1e6) as bigint) kx, cast(round(lat * 1e6) as bigint) ky from v_vertices)
  select kx, ky, count(*) as features from k group by 1, 2 having count(*) >= 2""", "v_vertices")
def shared_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return R.shared_vertices(view(spark, sf, "v_vertices"), [], "road_id")


UNIT = "cast(trunc((case when {0} > 0 then {0} + 180.0::double / 16777216 else {0} - 180.0::double / 16777216 end) * 16777216 / 360) as int)"


def _dist(a1: str, o1: str, a2: str, o2: str) -> str:
    d = [f"({c} * (360.0::double / 16777216))" for c in (a1, o1, a2, o2)]
    flat = f"6378137.0::double * 2 * pi() / 360 * sqrt(power({d[0]} - {d[2]}, 2) + power(abs({d[1]} - {d[3]}) * cos(radians(({d[0]} + {d[2]}) / 2)), 2))"
    circle = f"2 * asin(sqrt(power(sin((radians({d[0]}) - radians({d[2]})) / 2), 2) + cos(radians({d[0]})) * cos(radians({d[2]})) * power(sin((radians({d[1]}) - radians({d[3]})) / 2), 2))) * 6378137.0::double"
    return f"(case when {flat} < 10000 then {flat} else {circle} end)"


def _bearing(a1: str, o1: str, a2: str, o2: str) -> str:
    r = [f"radians({c} * (360.0::double / 16777216))" for c in (a1, o1, a2, o2)]
    b = f"degrees(atan2({r[3]} - {r[1]}, ln(tan({r[2]} / 2 + pi() / 4) / tan({r[0]} / 2 + pi() / 4))))"
    return f"(case when {b} < 0 then {b} + 360 else {b} end)"


@query(f"""with u as (select id, {UNIT.format('lat')} la, {UNIT.format('lon')} lo from v_points)
  select id, la, lo, (la + 32) & -64 as la6, cast(round({_dist('la', 'lo', str(2097152), str(46603))} * 1e4) as bigint) as distance_e4, cast(round({_bearing('la', 'lo', '2097152', '46603')} * 1e6) as bigint) as bearing_e6,
    cast(((cast(round({_bearing('la', 'lo', '2097152', '46603')} * 256 / 360) as int) + 128) % 256) - 128 as int) as heading from u""", "v_points")
def map_units(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "v_points").select("id", S.map_units(F.col("lat")).alias("la"), S.map_units(F.col("lon")).alias("lo"))
    to = F.lit(2097152), F.lit(46603)
    turn = S.bearing(F.col("la"), F.col("lo"), *to)
    return p.select("id", "la", "lo", S.round_coord(F.col("la"), 6).alias("la6"), S.rounded(S.unit_distance(F.col("la"), F.col("lo"), *to) * 1e4).cast("long").alias("distance_e4"), S.rounded(turn * 1e6).cast("long").alias("bearing_e6"), S.heading_byte(turn).alias("heading"))


ARC_SQL = f"""{JUNCTION_SQL}, u as (select *, {UNIT.format('lat')} la, {UNIT.format('lon')} lo from n),
s as (select *, coalesce({_dist('lag(la) over w', 'lag(lo) over w', 'la', 'lo')}, 0) step from u window w as (partition by road_id order by pt_idx)),
c as (select *, sum(step) over (partition by road_id order by pt_idx rows unbounded preceding) run from s),
p as (select *, lag(la) over w la0, lag(lo) over w lo0, lag(run) over w run0 from c where is_end or uses >= 2 window w as (partition by road_id order by pt_idx)),
a as (select road_id, pt_idx, la0, lo0, la, lo, cast(floor(run - run0) as bigint) m from p where la0 is not null and (la0 <> la or lo0 <> lo) and floor(run - run0) > 0),
b as (select road_id, pt_idx, true fwd, la0 sla, lo0 slo, la dla, lo dlo, m from a union all select road_id, pt_idx, false, la, lo, la0, lo0, m from a)"""


@query(f"with {ARC_SQL} select road_id, pt_idx, fwd as forward, sla as src_lat, slo as src_lon, dla as dst_lat, dlo as dst_lon, m as length_m from b", "v_vertices")
def arcs(spark: SparkSession, sf: str) -> DataFrame:
    a = R.arcs(roads(spark, sf), [], "road_id")
    return a.select("road_id", "pt_idx", "forward", F.col("src.lat_u").alias("src_lat"), F.col("src.lon_u").alias("src_lon"), F.col("dst.lat_u").alias("dst_lat"), F.col("dst.lon_u").alias("dst_lon"), "length_m")


@query(f"""with {ARC_SQL}, x as (select sla, slo, least(road_id % 7, 4) cls, count(distinct road_id) n from b group by all),
g as (select sla, slo, max(cls) node_class, max(case when n >= 2 then cls end) busy, count(*) used, list_sort(list(cls), 'desc') l from x group by all)
select sla as lat, slo as lon, node_class, case when used = 1 then node_class else coalesce(busy, l[2]) end as node_group from g""", "v_vertices")
def node_classes(spark: SparkSession, sf: str) -> DataFrame:
    a = R.arcs(roads(spark, sf), [], "road_id").withColumn("road_class", F.col("road_id") % 7)
    return R.node_classes(a, [], "road_id").select(F.col("src.lat_u").alias("lat"), F.col("src.lon_u").alias("lon"), "node_class", "node_group")


@query()
def route_centers(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of every tile (here: level) in centres that keep the format's limits."""
    a = R.arcs(roads(spark, sf).withColumn("tile", F.col("level")), ["tile"], "road_id").withColumn("road_class", F.col("road_id") % 7)
    return R.route_centers(R.node_classes(a, ["tile"], "road_id"), a, ["tile"], "road_id")


@query("""with recursive n as (select o_orderkey as id, o_custkey as n from orders),
c as (select id, n, 0 k, 0 s, case when n <= 250 then n when n < 500 then n // 2 + 1 else 250 end e from n
  union all select id, n, k + 1, e - 1, case when n - (e - 1) <= 250 then n when n - (e - 1) < 500 then e - 1 + (n - (e - 1)) // 2 + 1 else e - 1 + 250 end from c where e < n)
select id, cast(k as int) as chunk, cast(s as int) as start_idx, cast(e as int) as end_idx from c""")
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(R.line_chunks(F.col("o_custkey").cast("int"))).alias("chunk", "c"))
    return o.select("id", "chunk", F.col("c.start").alias("start_idx"), F.col("c.end").alias("end_idx"))


# --- levels ------------------------------------------------------------------------------------------------------------

@query("""with e as (select id, unnest(generate_series(0, 6)) n from (select distinct id from v_levels)),
  j as (select e.id, e.n, v.n as own from e left join v_levels v on v.id = e.id and v.n = e.n)
  select id, cast(n as int) as n, last_value(own ignore nulls) over (partition by id order by n) as filled from j""", "v_levels")
def level_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_levels").select("id", "n", F.col("n").alias("filled"))
    return levels.filled(rows, "id", "n", "filled", 6).select("id", "n", "filled")


@query("""with g as (select id, any_value(end_level) e, list(n) l from v_levels group by 1), x as (select id, e, l, unnest(generate_series(0, 6)) lv from g)
  select id, cast(lv as int) as level, list_max(list_filter(l, lambda k : k <= lv)) as nearest,
    coalesce(case when list_contains(l, cast(lv as int)) then cast(lv as int) end, list_min(list_filter(l, lambda k : k > lv)), list_max(list_filter(l, lambda k : k < lv))) as bucket,
    case when e = 0 then list_contains(l, cast(lv as int)) else lv <= e and len(list_filter(l, lambda k : k <= lv)) > 0 end as visible, e >= lv as point_visible from x""", "v_levels")
def level_buckets(spark: SparkSession, sf: str) -> DataFrame:
    g = view(spark, sf, "v_levels").groupBy("id").agg(F.first("end_level").alias("e"), F.collect_list("n").alias("l"))
    g = g.withColumn("m", F.map_from_arrays("l", "l")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(6))))
    m, lv = F.col("m"), F.col("level")
    return g.select("id", "level", levels.nearest_lower(m, lv).alias("nearest"), levels.bucket(m, lv).alias("bucket"), levels.visible(m, F.col("e"), lv).alias("visible"), levels.point_visible(F.col("e"), lv).alias("point_visible"))


@query("""with r as (select case when id % 2 = 0 then 'LineString' else 'Polygon' end geom_type, type_code, end_level, n from v_levels)
  select geom_type, type_code, cast(coalesce(max(case when end_level = 0 or n <= end_level then n end), 0) as int) as max_level from r group by 1, 2 union all select 'Polygon', 75, 0""", "v_levels")
def overview_max(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v_levels").withColumn("geom_type", F.when(F.col("id") % 2 == 0, "LineString").otherwise("Polygon"))
    return levels.overviews(v, "geom_type", "type_code", "end_level", "n", background=True)


@query("""with s as (select id, abs(sum(lon * nlat - nlon * lat)) / 2 a from (select *, lead(lon) over w nlon, lead(lat) over w nlat from v_rings window w as (partition by id order by pt_idx)) group by 1)
  select id, round(a, 6) as area, row_number() over (order by round(a, 6) desc, id) as place from s""", "v_rings")
def polygon_area_order(spark: SparkSession, sf: str) -> DataFrame:
    g = lines(spark, sf, ("id",), "v_rings").select("id", F.round(S.polygon_area(F.col("geometry")), 6).alias("area"))
    return levels.placed(g, [F.desc("area"), F.asc("id")])


@query("""with u as (select road_id, pt_idx, (cast(lon * 1000 as int) + 32) & -64 x, (cast((lat - 45) * 1000 as int) + 32) & -64 y from v_vertices),
  l as (select *, lag(x) over w px, lag(y) over w py from u window w as (partition by road_id order by pt_idx))
  select road_id, cast(count(*) filter (where px is null or px <> x or py <> y) as int) as points from l group by 1""", "v_vertices")
def rounded_point_count(spark: SparkSession, sf: str) -> DataFrame:
    g = lines(spark, sf)
    units = F.transform("geometry", lambda p: F.struct(S.rounded(p["x"] * 1000).cast("int").alias("x"), S.rounded((p["y"] - 45) * 1000).cast("int").alias("y")))
    return g.select("road_id", levels.point_count(units, 6).alias("points"))


@query("""select p_partkey as id, least(greatest(cast(floor((p_partkey * 7919 % 4000) * 4 / 4000::double) as int), 0), 3) * 3 + least(greatest(cast(floor((p_partkey * 104729 % 3000) * 3 / 3000::double) as int), 0), 2) as cell,
  case when p_size % 3 = 0 then 9 else 11 + 4 * p_size end as bytes, p_size between 32 and 37 as contour from part""")
def grid_and_size(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k.alias("id"), levels.grid_cell(k * 7919 % 4000, k * 104729 % 3000, 4, 3, 4000, 3000).alias("cell"), levels.encoded_size(F.when(F.col("p_size") % 3 == 0, "Point").otherwise("LineString"), F.col("p_size")).alias("bytes"), levels.is_contour(F.col("p_size")).alias("contour"))


@query()
def level_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of three levels over the points, coarse to fine."""
    p = view(spark, sf, "v_points").select(F.col("id").alias("item"), S.map_units(F.col("lon")).alias("x"), S.map_units(F.col("lat")).alias("y"), F.lit(20).alias("bytes"))
    items = p.withColumn("level", F.explode(F.array(*map(F.lit, range(3)))))
    cells, _ = levels.hierarchy(items, (-50_000, 2_000_000, 140_000, 2_150_000), {2: 4, 1: 2, 0: 0})
    return cells


# --- rasters -----------------------------------------------------------------------------------------------------------

@query("""with p as (select id, lon, lat, (lon + 1) / 1.0::double cf, (46 - lat) / 1.0::double rf from v_points),
  q as (select *, cast(floor(cf) as int) c0, cast(floor(rf) as int) r0 from p)
  select id, round(case when c0 + 1 >= 5 or r0 + 1 >= 5 then (select h from v_raster v where v.c = cast(round(cf) as int) and v.r = cast(round(rf) as int))
    else (1 - (rf - r0)) * ((1 - (cf - c0)) * a.h + (cf - c0) * b.h) + (rf - r0) * ((1 - (cf - c0)) * c.h + (cf - c0) * d.h) end, 6) as h
  from q left join v_raster a on a.r = r0 and a.c = c0 left join v_raster b on b.r = r0 and b.c = c0 + 1 left join v_raster c on c.r = r0 + 1 and c.c = c0 left join v_raster d on d.r = r0 + 1 and d.c = c0 + 1""", "v_points", "v_raster")
def dem_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf, "auto")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """The raster as one read grid: degrees from -1 E, 46 N."""
    return view(spark, sf, "v_raster").select(F.lit("a").alias("grid"), F.lit(-1.0).alias("west"), F.lit(46.0).alias("north"), F.lit(1.0).alias("cell_lon"), F.lit(1.0).alias("cell_lat"), "r", "c", "h")


def _sampled(spark: SparkSession, sf: str, method: str) -> DataFrame:
    out = raster.sampled(view(spark, sf, "v_points"), _cells(spark, sf), ["id"], method)
    return out.select("id", F.round("h", 6).alias("h"))


@query("select cast(floor(r / 2) as int) tile_r, cast(floor(c / 2) as int) tile_c, min(h) low, max(h) high, count(*) filter (where h is null) voids from v_raster group by 1, 2", "v_raster")
def dem_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return raster.dem_tiles(view(spark, sf, "v_raster"), 2)


W = ("0.5 * (-{t} + 2 * {t} * {t} - {t} * {t} * {t})", "0.5 * (2 - 5 * {t} * {t} + 3 * {t} * {t} * {t})", "0.5 * ({t} + 4 * {t} * {t} - 3 * {t} * {t} * {t})", "0.5 * ({t} * {t} * {t} - {t} * {t})")
WEIGHT = "case {k} " + " ".join(f"when {k} then {w}" for k, w in enumerate(W)) + " end"


@query(f"""with p as (select id, (lon + 1) / 1.0::double cf, (46 - lat) / 1.0::double rf from v_points), q as (select *, cast(floor(cf) as int) c1, cast(floor(rf) as int) r1 from p),
  s as (select q.id, sum(h * ({WEIGHT.format(k='v.c - c1 + 1', t='(cf - c1)')}) * ({WEIGHT.format(k='v.r - r1 + 1', t='(rf - r1)')})) h, count(h) n
    from q join v_raster v on v.c between c1 - 1 and c1 + 2 and v.r between r1 - 1 and r1 + 2 group by 1)
  , t as (select id, case when c1 + 1 >= 5 or r1 + 1 >= 5 then (select h from v_raster v where v.c = cast(round(cf) as int) and v.r = cast(round(rf) as int))
    else (1 - (rf - r1)) * ((1 - (cf - c1)) * a.h + (cf - c1) * b.h) + (rf - r1) * ((1 - (cf - c1)) * c.h + (cf - c1) * d.h) end two
    from q left join v_raster a on a.r = r1 and a.c = c1 left join v_raster b on b.r = r1 and b.c = c1 + 1 left join v_raster c on c.r = r1 + 1 and c.c = c1 left join v_raster d on d.r = r1 + 1 and d.c = c1 + 1)
  select t.id, round(case when n = 16 and c1 >= 1 and r1 >= 1 then s.h else two end, 6) as h from t join q using (id) left join s using (id)""", "v_points", "v_raster")
def dem_bicubic(spark: SparkSession, sf: str) -> DataFrame:
    """D3: bicubic where sixteen neighbours are there, else bilinear."""
    return _sampled(spark, sf, "bicubic")


# --- encodings ---------------------------------------------------------------------------------------------------------

@query("""with f as (select p_brand, p_type, min(p_partkey) f, (length(p_type) + 2) // 2 * 2 n from part where p_type <> '' group by 1, 2),
  o as (select p_brand, p_type, (2 + coalesce(sum(n) over (partition by p_brand order by f rows between unbounded preceding and 1 preceding), 0)) // 2 k from f)
  select p_partkey as id, cast(coalesce(k, 0) as bigint) as label_offset from part left join o using (p_brand, p_type)""")
def label_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of each tile (here: brand) stored once, at even bytes."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return labels.interned(part, "p_type", ["p_brand"], ["p_partkey"]).select(F.col("p_partkey").alias("id"), "label_offset")


@query("""select p_partkey as id, hex(p_name) || '00' as utf8, (length(regexp_replace(upper(p_name), '[^ A-Z0-9]', '', 'g')) + 2 * length(regexp_replace(p_name, '[^@!"#$%&''()*+,./-]', '', 'g'))) * 6 // 8 + 1 as six_bit_bytes from part""")
def label_encodings(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.hex(labels.encoded(name, 10)).alias("utf8"), F.length(labels.encoded(name, 6)).alias("six_bit_bytes"))


@query("""with u as (select o_orderkey as id, cast(o_orderkey * 7 % 40000 as int) n, o_custkey % 2 = 0 c from orders)
  select id, case when n < case when c then 768 else 1024 end then (case when c then 32 else 0 end) | ((n >> 5) & 24) else 56 end as flag,
    case when n < case when c then 768 else 1024 end then cast(n & 255 as varchar) when n >= 16384 then (192 | (n & 63)) || ',' || ((n >> 6) & 255) || ',' || (n >> 14)
      when c then (n & 127) || ',' || (n >> 7) else (128 | (n & 63)) || ',' || (n >> 6) end as bytes,
    cast(case when n = 0 then 0 else length(bin(n)) end as int) as bits, case when n % 20 < 10 then n % 20 + 2 else 2 * (n % 20) - 7 end as base, (n + 32) >> 6 << 6 as snapped from u""")
def arc_encodings(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7 % 40000).cast("int").alias("n"), (F.col("o_custkey") % 2 == 0).alias("c"))
    flag, data = S.arc_length_code(F.col("n"), F.col("c"))
    return u.select("id", flag.alias("flag"), F.array_join(data.cast("array<string>"), ",").alias("bytes"), S.bits_needed(F.col("n")).alias("bits"), S.base_bits(F.col("n") % 20).alias("base"), S.round_pof2(F.col("n"), 6).alias("snapped"))


@query("""with a as (select p_partkey as id, cast(p_partkey * 7 as int) x0, cast(p_partkey * 7 + p_size * 9 as int) x2, cast(p_size * 5 as int) y0, cast(p_size * 5 + p_partkey % 300 as int) y1 from part),
  b as (select *, (x0 + (x2 - x0) // 2 + 8) >> 4 << 4 x1 from a),
  c as (select id, x0 minx, y0 miny, x1 maxx, y1 maxy from b where x0 < x1 and y0 < y1 union all select id, x1, y0, x2, y1 from b where x1 < x2 and y0 < y1)
  select id, cast(minx as int) as minx, miny, cast(maxx as int) as maxx, maxy from c where id in (select id from c group by 1 having count(*) = 2)""")
def area_split(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    cells = S.split_area((k * 7).cast("int"), (s * 5).cast("int"), (k * 7 + s * 9).cast("int"), (s * 5 + k % 300).cast("int"), 2, 1, 4)
    return table(spark, sf, "part").select(k.alias("id"), F.explode(cells).alias("cell")).select("id", "cell.*")


# --- kernels -----------------------------------------------------------------------------------------------------------

@query("""with b as (select id, min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 from v_rings group by 1)
  select id, round((least(x1, 1) - greatest(x0, 0)) * (least(y1, 45) - greatest(y0, 44)), 9) as area from b where least(x1, 1) > greatest(x0, 0) and least(y1, 45) > greatest(y0, 44)""", "v_rings")
def clip_boxes(spark: SparkSession, sf: str) -> DataFrame:
    g = lines(spark, sf, ("id",), "v_rings")
    out = kernels.mapped(g, lambda p, _: kernels.clip_polygon(p, (0.0, 44.0, 1.0, 45.0)))
    return out.select("id", F.round(S.polygon_area(F.col("geometry")), 9).alias("area"))


@query("""with e as (select road_id, pt_idx, lon x0, lat y0, lead(lon) over w x1, lead(lat) over w y1 from v_vertices window w as (partition by road_id order by pt_idx)),
  d as (select *, x1 - x0 dx, y1 - y0 dy from e where x1 is not null),
  t as (select *, greatest(0, case when dx > 0 then (0.5 - x0) / dx when dx < 0 then (1.5 - x0) / dx else 0 end, case when dy > 0 then (45.025 - y0) / dy when dy < 0 then (45.75 - y0) / dy else 0 end) t0,
    least(1, case when dx > 0 then (1.5 - x0) / dx when dx < 0 then (0.5 - x0) / dx else 1 end, case when dy > 0 then (45.75 - y0) / dy when dy < 0 then (45.025 - y0) / dy else 1 end) t1,
    (dx <> 0 or x0 between 0.5 and 1.5) and (dy <> 0 or y0 between 45.025 and 45.75) ok from d),
  h as (select *, case when t0 = 0 then x0 else x0 + t0 * dx end px, case when t0 = 0 then y0 else y0 + t0 * dy end py, case when t1 = 1 then x1 else x0 + t1 * dx end qx, case when t1 = 1 then y1 else y0 + t1 * dy end qy
    from t where ok and t0 <= t1),
  o as (select *, coalesce(lag(pt_idx) over w = pt_idx - 1 and lag(t1) over w = 1 and t0 = 0, false) joined from h window w as (partition by road_id order by pt_idx)),
  g as (select *, sum(case when joined then 0 else 1 end) over (partition by road_id order by pt_idx) grp from o),
  p as (select road_id, grp, list(case when px = qx and py = qy then null else pt_idx end) moved, count(*) filter (where t0 < t1 and (px <> qx or py <> qy)) + 1 points,
    min(least(px, qx)) minx, min(least(py, qy)) miny, max(greatest(px, qx)) maxx, max(greatest(py, qy)) maxy from g group by 1, 2)
  select road_id, cast(row_number() over (partition by road_id order by grp) - 1 as int) as piece, cast(points as int) as points, round(minx, 9) minx, round(miny, 9) miny, round(maxx, 9) maxx, round(maxy, 9) maxy from p where points > 1""", "v_vertices")
def clip_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = kernels.mapped(lines(spark, sf), lambda p, _: kernels.clip_line(p, (0.5, 45.025, 1.5, 45.75)))
    box = [F.round(c, 9).alias(n) for c, n in zip(features.bounds(F.col("geometry")), ("minx", "miny", "maxx", "maxy"), strict=True)]
    return out.select("road_id", "piece", F.size("geometry").alias("points"), *box)


@query("""with e as (select road_id, pt_idx, lon, lat, lead(lon) over w nx, lead(lat) over w ny, count(*) over (partition by road_id) n from v_vertices window w as (partition by road_id order by pt_idx)),
  s as (select road_id, lon x, lat y from e where pt_idx = 0 or nx is null or n < 3 union all
    select road_id, 0.75::double * lon + 0.25::double * nx, 0.75::double * lat + 0.25::double * ny from e where nx is not null and n >= 3 union all
    select road_id, 0.25::double * lon + 0.75::double * nx, 0.25::double * lat + 0.75::double * ny from e where nx is not null and n >= 3)
  select road_id, cast(count(*) as int) as points, round(sum(x), 6) as sum_x, round(sum(y), 6) as sum_y from s group by 1""", "v_vertices")
def chaikin(spark: SparkSession, sf: str) -> DataFrame:
    out = lines(spark, sf).withColumn("geometry", S.chaikin(F.col("geometry"), 1))
    total = lambda c: F.round(F.aggregate("geometry", F.lit(0.0), lambda a, p: a + p[c]), 6)
    return out.select("road_id", F.size("geometry").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("""with recursive b as (select road_id, list(lon order by pt_idx) xs, list(lat order by pt_idx) ys, count(*) n from v_vertices group by 1),
  s as (select road_id, xs, ys, n, case when n > 2 then [[1, n]] else [] end todo, 2 kept from b
    union all
    select road_id, xs, ys, n, case when m > 0.2 then todo[2:] || list_filter([[a, k], [k, z]], lambda q : q[2] - q[1] >= 2) else todo[2:] end, case when m > 0.2 then kept + 1 else kept end
    from (select *, a + list_position(d, m) k from (select *, list_max(d) m from (
      select *, list_transform(generate_series(a + 1, z - 1), lambda i : sqrt(power(xs[i] - (xs[a] + t(i) * (xs[z] - xs[a])), 2) + power(ys[i] - (ys[a] + t(i) * (ys[z] - ys[a])), 2))) d from (
        select *, todo[1][1] a, todo[1][2] z from s where len(todo) > 0)))))
  select road_id, cast(case when n = 1 then 1 else max(kept) end as int) points from s group by road_id, n""".replace("t(i)", "(case when xs[z] = xs[a] and ys[z] = ys[a] then 0 else least(1, greatest(0, ((xs[i] - xs[a]) * (xs[z] - xs[a]) + (ys[i] - ys[a]) * (ys[z] - ys[a])) / (power(xs[z] - xs[a], 2) + power(ys[z] - ys[a], 2)))) end)"), "v_vertices")
def douglas_peucker(spark: SparkSession, sf: str) -> DataFrame:
    out = kernels.mapped(lines(spark, sf), lambda p, _: [p[kernels.douglas_peucker(p, 0.2)]])
    return out.select("road_id", F.size("geometry").alias("points"))


@query("""with recursive b as (select road_id, list(struct_pack(i := pt_idx, x := lon, y := lat) order by pt_idx) l from v_vertices group by 1),
  r as (select road_id, l, 0 step from b union all
    select road_id, l[1:k] || l[k + 2:], step + 1 from (select *, list_min(t) m, list_position(t, list_min(t)) k from (
      select *, list_transform(generate_series(2, len(l) - 1), lambda j : abs((l[j].x - l[j - 1].x) * (l[j + 1].y - l[j - 1].y) - (l[j + 1].x - l[j - 1].x) * (l[j].y - l[j - 1].y)) / 2) t from r where len(l) > 2)) where m < 0.05),
  last as (select road_id, arg_max(l, step) l from r group by 1),
  keys as (select distinct road_id, cast(round(lon * 1e6) as bigint) kx, cast(round(lat * 1e6) as bigint) ky from v_vertices), shared as (select kx, ky from keys group by 1, 2 having count(*) >= 2),
  kept as (select road_id, unnest(l).i i from last union select road_id, pt_idx from v_vertices join shared on kx = cast(round(lon * 1e6) as bigint) and ky = cast(round(lat * 1e6) as bigint))
  select road_id, cast(count(*) as int) as points from kept group by 1""", "v_vertices")
def visvalingam(spark: SparkSession, sf: str) -> DataFrame:
    """Topology-safe: vertices shared by two or more roads are anchored."""
    keyed = lambda df: df.withColumn("kx", S.snap(F.col("lon"))).withColumn("ky", S.snap(F.col("lat")))
    v = keyed(view(spark, sf, "v_vertices"))
    anchors = v.join(R.shared_vertices(view(spark, sf, "v_vertices"), [], "road_id"), ["kx", "ky"], "left_semi").groupBy("road_id").agg(F.collect_list("pt_idx").alias("anchors"))
    g = lines(spark, sf).join(anchors, "road_id", "left")
    out = kernels.mapped(g, lambda p, o: [p[kernels.visvalingam(p, 0.05, set(o["anchors"] or ()))]], options=("anchors",))
    return out.select("road_id", F.size("geometry").alias("points"))


@query()
def split_polygons(spark: SparkSession, sf: str) -> DataFrame:
    g = lines(spark, sf, ("id",), "v_rings")
    dense = kernels.mapped(g, lambda p, _: [np.vstack([a + (b - a) * np.linspace(0, 1, 100, endpoint=False)[:, None] for a, b in zip(p[:-1], p[1:], strict=True)] + [p[:1]])])
    out = kernels.mapped(dense.drop("piece"), lambda p, _: kernels.split_polygon(p, 250))
    return out.select("id", "piece", F.size("geometry").alias("points"))


# --- text tiles --------------------------------------------------------------------------------------------------------

@query("""select p_partkey as id, '[POI]' || chr(10) || 'Type=0x2a' || chr(10) || 'Label=' || p_brand || chr(10) || 'Data0=(' || printf('%.6f', cast(p_partkey % 80 as double) / 8) || ',' || printf('%.6f', cast(p_partkey % 170 as double) / 16) || ')' || chr(10)
  || 'EndLevel=' || (p_size % 4) || chr(10) || 'City=' || p_size || chr(10) || '[END]' || chr(10) as text from part""")
def mp_sections(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    attrs = F.create_map(F.lit("Type"), F.lit("0x2a"), F.lit("Label"), F.col("p_brand"), F.lit("EndLevel"), (F.col("p_size") % 4).cast("string"), F.lit("City"), F.col("p_size").cast("string"))
    shape = F.create_map(F.lit(0), F.array(F.struct(((k % 170).cast("double") / 16).alias("x"), ((k % 80).cast("double") / 8).alias("y"))))
    return p.select(k.alias("id"), mp.section_text(F.lit("Point"), attrs, shape).alias("text"))


@query("""select road_id % 16 || '.mp' as tile, 'R' || road_id as label, cast(count(*) as int) as points, round(sum(round(lon, 6)), 6) as sum_lon, round(sum(round(lat, 6)), 6) as sum_lat
  from v_vertices group by road_id having count(*) >= 2""", "v_vertices")
def mp_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Roads written as text tiles, one file each, and read back from the files."""
    g = lines(spark, sf).where(F.size("geometry") >= 2).withColumn("tile", F.col("road_id") % 16)
    attrs = F.create_map(F.lit("Type"), F.lit("0x06"), F.lit("Label"), F.concat(F.lit("R"), F.col("road_id").cast("string")))
    text = g.select("tile", "road_id", mp.section_text(F.lit("LineString"), attrs, F.create_map(F.lit(0), F.col("geometry"))).alias("text"))
    out = storage.shared_path(spark, "mp")
    mp.write_mp(mp.tile_texts(text, "tile", ["road_id"]), out)
    base = F.col("levels")[0]
    total = lambda c: F.round(F.aggregate(base, F.lit(0.0), lambda a, p: a + p[c]), 6)
    return mp.read_mp(spark, out).select("tile", "label", F.size(base).alias("points"), total("x").alias("sum_lon"), total("y").alias("sum_lat"))


@query("""select count(*) filter (where o_orderstatus = 'F') as written, count(*) filter (where o_orderstatus = 'O') as empty, cast(sum(case when o_orderstatus = 'F' then o_custkey % 10 else 0 end) as bigint) as features from orders""")
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("tile"), F.when(F.col("o_orderstatus") == "F", "written").when(F.col("o_orderstatus") == "O", "empty").otherwise("skipped").alias("outcome"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 10).otherwise(0).alias("features"), F.lit(None).cast("string").alias("error"))
    return mp.execution_report(o).select(F.from_json("report", "written long, empty long, features long").alias("r")).select("r.*")


from . import catalog_layers, catalog_sources  # noqa: E402, F401  (they register their queries)
