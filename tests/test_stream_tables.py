"""The stream queries over a table that is one file and over the same table as a folder of parts."""

import pytest

from tamis.plans import large_bank, queries

SF = "/root/testdata/sf0.001"
CASES = {"stream_moderate": queries.stream_moderate, "stream_reload": queries.stream_reload, "quota_audit_stream": queries.quota_audit_stream_q,
         "stream_moderate_1000": large_bank.stream_moderate_1000, "stream_reload_1000": large_bank.stream_reload_1000}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables as folders; the parts of events are in no order of time."""
    d = tmp_path_factory.mktemp("parts")
    for name, n, by in (("documents", 3, "doc_id"), ("events", 4, "event_id"), ("benchmark", 2, "doc_id")):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.repartition(n, by if by in t.columns else t.columns[0]).write.parquet(str(d / f"{name}.parquet"))
    (d / "documents.parquet.old").write_bytes(b"not a part of the table")
    return str(d)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", CASES)
def test_a_folder_of_parts_is_read_whole(spark, parts, name):
    table = "events" if "quota" in name else "documents"
    one = rows(CASES[name](spark, SF))
    assert len(one) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows(CASES[name](spark, parts)) == one


def test_the_quota_stream_over_parts_equals_the_batch(spark, parts):
    assert rows(queries.quota_audit_stream_q(spark, parts)) == rows(queries.quota_audit_q(spark, SF))
