"""Route centres and level hierarchy."""

import numpy as np
from pyspark.sql import functions as F

from tessera import catalog
from tessera.fixtures import roads
from tessera.operators import levels
from tessera.operators import roads as R

from .conftest import DATA


def test_split_centers_keeps_limits():
    r = np.random.default_rng(3)
    lat, lon = r.integers(0, 200_000, 4000), r.integers(0, 90_000, 4000)
    roads_ = [[int(k) // 3] for k in range(4000)]
    dests = [[(int(lat[(k + 1) % 4000]), int(lon[(k + 1) % 4000]))] for k in range(4000)]
    found = R.split_centers(lat, lon, np.full(4000, 13), roads_, dests)
    assert sorted(np.concatenate([own for *_, own in found]).tolist()) == list(range(4000))
    for _, _, own in found:
        here = {(int(lat[k]), int(lon[k])) for k in own}
        assert np.ptp(lat[own]) + 1 < R.CENTER_SIDE and np.ptp(lon[own]) + 1 < R.CENTER_SIDE
        assert len({roads_[k][0] for k in own}) < R.CENTER_ROADS and len({d for k in own for d in dests[k]} - here) < R.CENTER_OUTSIDE
        assert 13 * len(own) < R.CENTER_BYTES
        assert [(int(lon[k]), int(lat[k])) for k in own] == sorted((int(lon[k]), int(lat[k])) for k in own)


def test_every_node_has_one_center(spark):
    a = R.arcs(roads(spark, DATA).withColumn("tile", F.col("level")), ["tile"], "road_id")
    want = {(r["tile"], *r["src"]) for r in a.select("tile", "src").distinct().collect()}
    got = [(r.tile, r.lat, r.lon) for r in catalog.route_centers(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nodes_without_arcs_come_first(spark):
    a = spark.createDataFrame([((5, 5), (6, 6), 1, 10)], "src struct<lat_u: int, lon_u: int>, dst struct<lat_u: int, lon_u: int>, road_id long, length_m long")
    n = spark.createDataFrame([((5, 5), 2), ((6, 6), 2)], "src struct<lat_u: int, lon_u: int>, node_group int")
    assert sorted((r.bucket, r.lat) for r in R.route_centers(n, a, [], "road_id").collect()) == [(-1, 6), (2, 5)]


def test_hierarchy(spark):
    r = np.random.default_rng(5)
    rows = [(lv, int(k), int(r.integers(0, 40_000)), int(r.integers(0, 30_000)), 20) for lv, n in ((0, 3000), (1, 300), (2, 10)) for k in range(n)]
    items = spark.createDataFrame(rows, "level int, item long, x int, y int, bytes int")
    cells, placed = levels.hierarchy(items, (0, 0, 40_000, 30_000), {2: 4, 1: 2, 0: 0})
    by = {c.cell: c for c in cells.collect()}
    assert sorted(by) == list(range(1, len(by) + 1)) and [c.level for c in by.values() if c.parent == 0] == [2]
    at = {(lv, k): (x, y) for lv, k, x, y, _ in rows}
    got = placed.collect()
    assert len(got) == len(rows) and len({(p.level, p.item) for p in got}) == len(rows)
    for p in got:
        c, (x, y) = by[p.cell], at[p.level, p.item]
        assert c.level == p.level and c.p_minx <= x <= c.p_maxx and c.p_miny <= y <= c.p_maxy
    for c in by.values():
        assert c.items <= 255 and (c.parent == 0 or by[c.parent].level == c.level + 1)
        brothers = [b.cell for b in by.values() if b.parent == c.parent]
        assert c.is_last == (c.cell == max(brothers))
    assert cells.agg(F.sum("items")).first()[0] == len(rows)


def test_hierarchy_query_has_every_point_on_every_level(spark):
    from tessera.fixtures import view

    n = view(spark, DATA, "v_points").count()
    got = {r["level"]: r["n"] for r in catalog.level_hierarchy(spark, DATA).groupBy("level").agg(F.sum("items").alias("n")).collect()}
    assert got == {0: n, 1: n, 2: n}


def test_hierarchy_of_nothing(spark):
    items = spark.createDataFrame([], "level int, item long, x int, y int, bytes int")
    cells, placed = levels.hierarchy(items, (0, 0, 100, 100), {1: 2, 0: 0})
    assert [(c.level, c.parent, c.items) for c in cells.orderBy("cell").collect()] == [(1, 0, 0), (0, 1, 0)] and placed.count() == 0
