"""Every registered query of the package's own operators against its oracle."""

import pytest

from pagetrail.plans.oracles import ORACLES
from pagetrail.plans.queries import QUERIES
from tests.oracle import duck, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, name):
    same(QUERIES[name](spark, small), duck(small).sql(ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "score", "title", "description", "timestamp", "url"]
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


def test_rows_only(spark, small):
    hits = QUERIES["search_json"](spark, small).collect()
    assert hits and all(r.result.startswith('{"search_results":[') for r in hits)
    assert QUERIES["annotate_hook"](spark, small).count() == spark.read.parquet(f"{small}/pages.parquet").count()
