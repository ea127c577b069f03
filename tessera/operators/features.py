"""Feature tables: geometry as array<struct<x,y>>, attributes as text, explicit order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import plain_number

KINDS = ("Point", "LineString", "Polygon")
FLAT = {f"{k}25D": k for k in KINDS} | {f"{k}Z": k for k in KINDS}


def stringified(df: DataFrame, columns: list[str]) -> Column:
    """Map of the columns as text; null is ''."""
    kinds = dict(df.dtypes)
    text = lambda c: plain_number(F.col(c)) if kinds[c] in ("double", "float") else F.to_json(F.col(c)) if kinds[c].startswith("array") else F.col(c).cast("string")
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.coalesce(text(c), F.lit("")) for c in columns]))


def dedup_first(df: DataFrame, key: str, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """The first row of each key within a scope; rows without a key (null or '') all stay.

    The first row is kept by a partial aggregate in every task, so a hot key costs one row a task; keyless rows are not
    grouped at all. Rows that agree in `order` must be equal.
    """
    empty = F.col(key).isNull() | (F.col(key).cast("string") == "")
    first = df.where(~empty).groupBy(*(scope or []), key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*").unionByName(df.where(empty))


def counted(df: DataFrame, kind: str = "geom_type") -> DataFrame:
    """Rows of every type."""
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def decomposed(df: DataFrame, kind: str = "geom_type") -> DataFrame:
    """A3: multi-geometries of every type, and over all in the row without a type."""
    return df.where(F.col(kind).startswith("Multi")).rollup(kind).agg(F.count("*").alias("n"))


def exploded(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One row a part (array<array<point>>), with its number; empty parts are skipped."""
    others = [c for c in df.columns if c != parts]
    return df.select(*others, F.posexplode(parts).alias("part", "geometry")).where(F.size("geometry") > 0)


def bounds(geometry: Column) -> list[Column]:
    """Minx, miny, maxx, maxy."""
    xs, ys = F.transform(geometry, lambda p: p["x"]), F.transform(geometry, lambda p: p["y"])
    return [F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")]


def finite(geometry: Column) -> Column:
    """F16."""
    ok = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.forall(geometry, lambda p: ok(p["x"]) & ok(p["y"]))


def supported(df: DataFrame, kind: str = "geom_type") -> tuple[DataFrame, DataFrame]:
    """rows of the three simple types (third dimension dropped), and the others."""
    flat = F.create_map(*[F.lit(x) for kv in FLAT.items() for x in kv])
    df = df.withColumn(kind, F.coalesce(flat[F.col(kind)], F.col(kind)))
    return df.where(F.col(kind).isin(*KINDS)), df.where(~F.coalesce(F.col(kind).isin(*KINDS), F.lit(False)))


def unsupported_stats(df: DataFrame, kind: str = "geom_type", source: str = "source") -> DataFrame:
    """A2: per type the count, the number of sources and the first ten of them."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.count_distinct(source).alias("total_sources"), F.slice(F.array_sort(F.collect_set(source)), 1, 10).alias("sources"))


def closed(ring: Column, eps: float = 1e-9) -> Column:
    """The ring with its first point repeated at the end unless it already is."""
    a, b = F.element_at(ring, 1), F.element_at(ring, -1)
    same = (F.abs(a["x"] - b["x"]) <= eps) & (F.abs(a["y"] - b["y"]) <= eps)
    return F.when(F.size(ring) == 0, ring).when(same, ring).otherwise(F.concat(ring, F.array(a)))


def wkt(kind: Column, geometry: Column) -> Column:
    """T11."""
    body = F.array_join(F.transform(geometry, lambda p: F.concat_ws(" ", plain_number(p["x"]), plain_number(p["y"]))), ", ")
    return F.when(kind == "Point", F.concat(F.lit("POINT ("), body, F.lit(")"))).when(kind == "LineString", F.concat(F.lit("LINESTRING ("), body, F.lit(")"))).otherwise(F.concat(F.lit("POLYGON (("), body, F.lit("))")))


def validation_stats(df: DataFrame, status: str = "validity") -> DataFrame:
    """A5: counts of valid, repaired and rejected rows and the recovery rate (1 if nothing was tried)."""
    n = lambda s: F.count_if(F.col(status) == s)
    tried = n("repaired") + n("rejected")
    return df.agg(n("valid").alias("valid"), n("repaired").alias("repaired"), n("rejected").alias("rejected"), F.when(tried == 0, 1.0).otherwise(n("repaired") / tried).alias("recovery_rate"))
