import __spark_entry__ as E
from tamis.plans import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"doc_id", "flagged", "action", "n_hits", "decided_by"}
    assert df.count() > 0


def test_every_query_has_an_oracle_except_rows_only():
    assert set(E.oracle_sql()) >= set(catalog.queries())
    assert set(E.queries()) >= set(E.oracle_sql())


def test_queries_run_on_tiny_data(spark):
    for name, fn in catalog.queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        df.limit(1).collect()
