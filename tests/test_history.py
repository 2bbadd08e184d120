"""Commits of the history: repeated, interrupted, at the same time, and read as of a version."""

import threading

import pytest
from pyspark.sql import functions as F

from pagelake.sources import history as Hi


def rows(spark, ids, day="2024-01-01"):
    return spark.createDataFrame([(i, f"m{i}") for i in ids], "id long, markdown string").withColumn("created_on", F.lit(day).cast("date"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_repeated_commits_leave_one_set_and_versions_stay_readable(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    schema = rows(spark, []).schema
    assert Hi.read(spark, path, schema).count() == 0
    assert Hi.commit(rows(spark, [1, 2]), path, "a") == 1
    assert Hi.commit(rows(spark, [3], "2024-01-02"), path, "b") == 2
    assert Hi.commit(rows(spark, [1, 2]), path, "a") == 1
    assert Hi.commit(rows(spark, []), path, "empty") == 3
    assert ids(Hi.read(spark, path, schema)) == [1, 2, 3] and ids(Hi.read(spark, path, schema, 1)) == [1, 2] and Hi.read(spark, path, schema, 0).count() == 0
    got = Hi.read(spark, path, schema)
    assert got.schema.names == schema.names and got.where("created_on = '2024-01-02'").first().markdown == "m3"
    assert [(r.version, r.token, r["rows"]) for r in Hi.versions(spark, path).orderBy("version").collect()] == [(1, "a", 2), (2, "b", 1), (3, "empty", 0)]


def test_reader_during_a_commit_sees_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    Hi.commit(rows(spark, [1]), path, "a")
    old = Hi.read(spark, path, rows(spark, []).schema)
    rows(spark, [9]).write.partitionBy("created_on").parquet(f"{path}/data/commit=unfinished")
    assert ids(Hi.read(spark, path, old.schema)) == [1] and Hi.orphans(spark, path) == ["commit=unfinished"]
    Hi.commit(rows(spark, [2]), path, "b")
    assert ids(old) == [1] and ids(Hi.read(spark, path, old.schema)) == [1, 2]
    with pytest.raises(Exception):
        Hi.commit(rows(spark, [5]).withColumn("markdown", F.raise_error(F.lit("stop"))), path, "c")
    assert ids(Hi.read(spark, path, old.schema)) == [1, 2] and Hi.commit(rows(spark, [5]), path, "c") == 3


def test_commits_at_the_same_time(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    jobs = [threading.Thread(target=Hi.commit, args=(rows(spark, [k]), path, f"t{k % 3}")) for k in range(6)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    got = ids(Hi.read(spark, path, rows(spark, []).schema))
    assert len(got) == 3 and {k % 3 for k in got} == {0, 1, 2}


def test_an_entry_is_never_overwritten(spark, tmp_path):
    f = Hi._Folder(spark, f"file://{tmp_path}/h")
    assert f.put("log/1.json", "x") and not f.put("log/1.json", "y")
    assert (tmp_path / "h/log/1.json").read_text() == "x" and f.names("staged") == []
