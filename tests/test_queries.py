import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry
from curbwait.plans import oracle, queries

FOLDER = "/root/testdata/sf0.01"
QUERIES = {query.__name__: query for query in queries.ALL}
ORACLE = oracle.ALL


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, name):
    columns, found = spark_rows(QUERIES[name](spark, FOLDER))
    wanted_columns, wanted = duck_rows(duck(FOLDER), ORACLE[name])
    assert columns == wanted_columns
    assert len(found) == len(wanted) > 0
    assert found == wanted


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_published_values(spark):
    report = {r.dropoff_borough: r for r in QUERIES["idle_by_region"](spark, FOLDER).collect()}
    assert report["AMERICA"].average_duration == 661.823888
    assert report["AFRICA"].average_duration == 715.087882
    assert report["MIDDLE EAST"].deviation_duration == 712.6933
