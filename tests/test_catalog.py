import pytest

from tessera import catalog

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, same, name):
    same(catalog.QUERIES[name](spark, DATA), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_roundtrip_keeps_points(spark):
    from pyspark.sql import functions as F

    from tessera.fixtures import lines

    want = lines(spark, DATA).where(F.size("geometry") >= 2).select(F.concat(F.lit("R"), "road_id"), F.size("geometry"))
    got = catalog.mp_roundtrip(spark, DATA).select("label", "points")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_entry():
    import __spark_entry__ as e

    assert "classified_roads" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
