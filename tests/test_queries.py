import pytest

from keyfold import catalogue
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    same(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_exact_route_is_xxh3(spark, sf):
    from xxhash import xxh3_64_intdigest

    rows = catalogue.kv_route_exact(spark, sf).limit(20).collect()
    assert all(r["shard"] == xxh3_64_intdigest(r["key"].encode()) % 8 + 1 for r in rows)
