"""Geometric views of the driver's tables, the same text for Spark and for the SQL oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIEWS = {
    "v_points": """select c_custkey as id, cast((c_custkey * 7919) % 4000 as double) / 1000 - 1 as lon,
  cast((c_custkey * 104729) % 3000 as double) / 1000 + 43 as lat from {customer}""",
    "v_boxes": """select o_orderkey as id, cast((o_orderkey * 7919) % 4000 as double) / 1000 - 1 as minx,
  cast((o_orderkey * 104729) % 3000 as double) / 1000 + 43 as miny,
  cast((o_orderkey * 7919) % 4000 + o_custkey % 50 as double) / 1000 - 1 as maxx,
  cast((o_orderkey * 104729) % 3000 + o_custkey % 30 as double) / 1000 + 43 as maxy from {orders}""",
    "v_vertices": """select l_orderkey as road_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 as bigint) as pt_idx,
  cast(l_partkey % 200 as double) / 100 as lon, cast(l_suppkey % 100 as double) / 100 + 45 as lat, l_orderkey % 3 - 1 as level from {lineitem}""",
    "v_rings": """select p.p_partkey as id, v.k as pt_idx,
  cast((p.p_partkey * 7919) % 4000 + v.dx * (1 + p.p_size) as double) / 1000 - 1 as lon,
  cast((p.p_partkey * 104729) % 3000 + v.dy * (1 + p.p_size % 7) as double) / 1000 + 43 as lat
from {part} p cross join (values (0,0,0),(1,1,0),(2,1,1),(3,0,1),(4,0,0)) as v(k, dx, dy)""",
    "v_attrs": """select p_partkey as id, 'TRONCON_DE_ROUTE' as source_layer,
  case p_partkey % 6 when 0 then 'Autoroute' when 1 then 'Nationale' when 2 then 'Départementale' when 3 then 'Route intercommunale' when 4 then '' end as CL_ADMIN,
  case p_partkey % 5 when 0 then 'Rond-point' when 1 then 'Chemin' when 2 then 'Bretelle' when 3 then 'Type autoroutier' else 'Route à 1 chaussée' end as NATURE,
  p_brand as NUMERO, cast(p_size * 3 as varchar(8)) as VIT_MOY_VL,
  case p_partkey % 3 when 0 then 'Sens direct' when 1 then 'Sens inverse' else 'Double sens' end as SENS, p_size from {part}""",
    "v_levels": """select p.p_partkey as id, p.p_size % 7 as end_level, p.p_size as type_code, v.n as n
from {part} p cross join (values (0),(1),(2),(3),(4),(5),(6)) as v(n) where v.n = 0 or (p.p_partkey + v.n) % 3 = 0""",
    "v_raster": """select cast(floor(n_nationkey / 5) as int) as r, n_nationkey % 5 as c, cast((n_nationkey * n_nationkey * 31) % 997 as double) as h from {nation}""",
}


def tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The same rows in a form that Spark shuffles once: the key has one name on both sides of the window, places are reckoned after it,
#: and columns behind `l_suppkey` in the order are left out, as rows alike up to there have one place.
PLANNED = {
    "v_vertices": """select road_id, pt_idx, cast(l_partkey % 200 as double) / 100 as lon, cast(l_suppkey % 100 as double) / 100 + 45 as lat, road_id % 3 - 1 as level
from (select *, cast(row_number() over (partition by road_id order by l_linenumber, l_partkey, l_suppkey) - 1 as bigint) as pt_idx
  from (select l_orderkey as road_id, l_linenumber, l_partkey, l_suppkey from {lineitem}))""",
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = PLANNED.get(name, VIEWS[name])
    return spark.sql(text, **{t: table(spark, sf, t) for t in tables(text)})


def roads(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices with the last index of their road."""
    return view(spark, sf, "v_vertices").withColumn("last_idx", F.max("pt_idx").over(Window.partitionBy("road_id")))


def lines(spark: SparkSession, sf: str, keys: tuple[str, ...] = ("road_id",), source: str = "v_vertices") -> DataFrame:
    """Vertices gathered to one geometry a feature."""
    v = view(spark, sf, source).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pt_idx", "lon", "lat"))).alias("g"))
    return v.select(*keys, F.transform("g", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("geometry"))


def oracle(sql: str, *views: str) -> str:
    """SQL with the named views as leading CTEs; `sql` may open with its own `with`."""
    heads = [f"{v} as ({re.sub(r'[{}]', '', VIEWS[v])})" for v in views]
    for start in ("with recursive ", "with "):
        if sql.lstrip().startswith(start):
            return start + ", ".join([*heads, sql.lstrip()[len(start) :]])
    return ("with " + ", ".join(heads) + " " if heads else "") + sql
