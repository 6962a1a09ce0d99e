"""Plan shapes that matter at scale."""

import pytest

import __spark_entry__ as contract
from sitemetrics.plans.all import QUERIES

FOLDER = "/root/testdata/sf0.01"
BATCH = [n for n in QUERIES if not n.startswith("stream_") and n != "append_events"]


def plan(spark, name):
    return contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_products_or_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, bad


@pytest.mark.parametrize("name", ["activity_feed", "live_snapshot", "stratified_sample", "tiered_sample"])
def test_top_n_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_samples_use_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "random_sample")


@pytest.mark.parametrize("name, columns", [
    ("bench_q5", {"o_custkey", "o_totalprice", "o_orderdate", "c_custkey", "c_nationkey"}),
    ("hourly_stats", {"ts", "user_id", "event_type"})])
def test_only_needed_columns_are_read(spark, name, columns):
    import re
    read = set()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)):
        read |= {c.split(":")[0] for c in schema.split(",")}
    assert read == columns
