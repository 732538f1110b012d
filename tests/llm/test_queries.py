"""The queries against their SQL, and all of them for shape."""

import pytest

from keyfold.llm import queries as llm
from tests.oracle import same

FAST = [n for n in sorted(llm.oracle_sql())]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf, name):
    same(spark, sf, llm.queries()[name], llm.oracle_sql()[name])


def test_one_row_for_each_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op6_language_id", "op7_license_scan", "op9_token_counts"):
        assert llm.queries()[name](spark, sf).count() == n
