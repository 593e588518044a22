"""Staging folders."""

from types import SimpleNamespace

import pytest

from parcelspark import session


def fake(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: configured or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_configured_folder_comes_first():
    assert session.work_dir(fake("yarn", "hdfs://shared/dir/")) == "hdfs://shared/dir"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(fake("yarn"))


def test_local_mode_keeps_one_folder():
    assert session.work_dir(fake("local[2]")) == session.work_dir(fake("local[2]"))


def test_staged_tables_keep_their_rows(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) AS name")
    staged = session.stage(df, "rows")
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, df.collect())) and staged.dtypes == df.dtypes
