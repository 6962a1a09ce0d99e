"""Versions: atomic, counted, refused when short or stale."""

import os

import pytest
from pyspark.sql import functions as F

from sitemetrics.sources.store import ShortLoad, StaleVersion, Versions


@pytest.fixture
def versions(spark, tmp_path):
    return Versions(spark, str(tmp_path / "table"), "id bigint")


def ids(versions):
    return sorted(r.id for r in versions.read().collect())


def test_versions_follow_each_other(spark, versions):
    assert versions.current().number == 0 and versions.read().count() == 0
    one = versions.write(spark.range(3), versions.current(), {"note": "first"})
    before = versions.read()
    two = versions.write(versions.read().filter("id > 0"), one)
    assert (two.number, two.rows, versions.current()) == (2, 2, two)
    assert before.count() == 3 and ids(versions) == [1, 2]
    assert one.info == {"note": "first"} and one.rows == 3


def test_a_writer_that_fails_half_way_leaves_the_old_version(spark, versions, tmp_path):
    one = versions.write(spark.range(5), versions.current())
    broken = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("disk gone")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="disk gone"):
        versions.write(broken, one)
    assert versions.current() == one and ids(versions) == [0, 1, 2, 3, 4]
    again = versions.write(spark.range(7), one)   # the retry is not disturbed by what the first attempt left
    assert again.number == 2 and ids(versions) == list(range(7))


def test_a_commit_that_is_interrupted_is_not_seen(spark, versions, monkeypatch):
    one = versions.write(spark.range(2), versions.current())
    monkeypatch.setattr(Versions, "_commit", lambda self, version: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        versions.write(spark.range(9), one)
    monkeypatch.undo()
    assert ids(versions) == [0, 1]


def test_the_second_of_two_writers_is_refused(spark, versions):
    start = versions.write(spark.range(1), versions.current())
    versions.write(spark.range(2), start)
    with pytest.raises(StaleVersion):
        versions.write(spark.range(3), start)
    assert ids(versions) == [0, 1]


@pytest.mark.parametrize("rows", [0, 3])
def test_short_loads_are_refused(spark, versions, rows):
    first = versions.write(spark.range(10), versions.current(), least=10)
    with pytest.raises(ShortLoad, match=f"{rows} rows"):
        versions.write(spark.range(rows), first, least=4)
    assert ids(versions) == list(range(10))
    assert versions.write(spark.range(0), first).rows == 0   # nothing asked for


def test_old_data_can_be_forgotten(spark, versions):
    at = versions.current()
    for n in range(1, 5):
        at = versions.write(spark.range(n), at)
    versions.forget(keep=2)
    assert ids(versions) == [0, 1, 2, 3] and len(os.listdir(f"{versions.root}/data")) == 2
