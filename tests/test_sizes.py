"""What larger tables show: wide numbers, ties by the last bit, long texts, many rows a place."""

import time

import numpy as np
from pyspark.sql import functions as F

from tessera import catalog, fixtures
from tessera.operators import kernels
from tessera.operators import roads as R
from tessera.sources import mp, storage, vector

from .conftest import DATA


def test_level_bounds_of_long_lines(spark):
    """Products of numbers of points over 2^31."""
    n = 899_999
    rows = spark.range(1).select(F.explode(R.line_chunks(F.lit(n))).alias("c"))
    at = R.level_bounds(F.col("c.start"), F.col("c.end"), F.lit(n), F.lit(n // 3))
    got = [tuple(map(tuple, r)) for r in rows.select("c", at.alias("at")).collect()]
    place = lambda i: min((i * (n // 3 - 1) + (n - 1) // 2) // (n - 1), n // 3 - 1)
    assert len(got) > 3_600 and got == [((s, e), (place(s), min(place(e - 1) + 1, n // 3))) for (s, e), _ in got]


def test_douglas_peucker_ties(duck):
    """A road whose distances tie but for the last bit: SQL keeps 8 of its points."""
    line = np.array([[1.21, 45.76], [0.8, 45.97], [0.32, 45.9], [0.93, 45.24], [0.65, 45.87], [1.81, 45.67], [0.63, 45.83], [1.83, 45.59], [0.78, 45.37]])
    assert len(kernels.douglas_peucker(line, 0.2)) == 8
    values = np.random.default_rng(1).uniform(-2, 2, 20_000)
    assert kernels.squares(values).tolist() == [r[0] for r in duck.sql(f"select power(unnest({values.tolist()}), 2)").fetchall()]


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_roads_are_shuffled_once(spark):
    """Vertices come by their road already; lengths need no other shuffle."""
    assert _shuffles(fixtures.roads(spark, DATA)) == 1
    assert _shuffles(catalog.QUERIES["road_lengths"](spark, DATA)) == 1


def test_node_classes_hold_no_roads(spark):
    """Two roads of a class are told by the least and the greatest, so roads are no grouping key."""
    arcs = spark.createDataFrame([(1, 9, 3), (2, 9, 3), (2, 9, 3), (3, 9, 5), (4, 8, 2), (4, 8, 2), (5, 8, 1)], "road long, src int, road_class int")
    got = R.node_classes(arcs, [], "road")
    assert sorted(map(tuple, got.collect())) == [(8, 2, 1), (9, 4, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in plan.split("keys=[")[1:] if "road#" in k.split("]")[0]]


def test_texts_come_in_pieces(spark, tmp_path, monkeypatch):
    """Files over many pieces and frames, in both encodings, with letters and line ends across the borders."""
    monkeypatch.setattr(storage, "PIECE_BYTES", 7)
    monkeypatch.setattr(storage, "FRAME_ROWS", 3)
    text = "".join(f"[POI]\r\nType=0x{k}\r\nLabel=é{k}\r\nData0=(45.5,6.{k})\r\n[END]\r\n" for k in range(1, 20))
    for name, code in (("a", "utf-8"), ("b", "cp1252")):
        (tmp_path / f"{name}.mp").write_bytes(text.encode(code))
    got = sorted((r["tile"], r["seq"], r["label"], r["levels"][0][0]["x"]) for r in mp.read_mp(spark, str(tmp_path)).collect())
    assert got == sorted((f"{t}.mp", k, f"é{k}", float(f"6.{k}")) for t in "ab" for k in range(1, 20))
    lines = "\n".join(f'{{"type":"Feature","properties":{{"n":"é{k}"}},"geometry":{{"type":"Point","coordinates":[{k},1]}}}}' for k in range(10))
    (tmp_path / "l.geojson").write_text(f"\n{lines}\n")
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection",\n"features":[' + ",\n".join(lines.split("\n")) + "]}")
    for name in "lc":
        rows = vector.read_geojson(spark, str(tmp_path / f"{name}.geojson")).collect()
        assert sorted((r["fid"], r["source_layer"], r["attributes"]["n"], r["parts"][0][0]["x"]) for r in rows) == [(k, name, f"é{k}", float(k)) for k in range(10)]
    frames, files = [], spark.createDataFrame([("a", b"")], "path string, content binary")
    monkeypatch.setattr(mp.pd, "DataFrame", lambda rows, columns: frames.append(len(rows)))
    run = []
    monkeypatch.setattr(mp.storage, "pieced", lambda files, data: type("Files", (), {"mapInPandas": lambda self, f, kinds: run.append(f)})())
    mp.parsed(files, "path", "content")
    list(run[0](iter([{"path": ["a"], "utf8": [True], "content": [text.encode()]}])))
    assert sum(frames) == 19 and max(frames) == 3


def test_half_clips_take_no_step_a_point():
    """A large ring is clipped as a whole; crossings come ahead of the points they lead to."""
    ring = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]])
    assert kernels.clip_half(ring, 0, 1.0, True).tolist() == [[0, 0], [1, 0], [1, 2], [0, 2]]
    assert kernels.clip_half(ring, 1, 1.0, False).tolist() == [[0, 1], [4, 1], [4, 2], [0, 2]]
    wide = np.random.default_rng(1).uniform(-1, 1, (1_000_000, 2))
    began = time.perf_counter()
    kernels.clip_half(wide, 0, 0.0, True)
    assert time.perf_counter() - began < 1
