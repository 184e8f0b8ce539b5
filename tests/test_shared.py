"""The shared folder."""

from types import SimpleNamespace

import pytest

from corpusmix import shared


def session(master, setting, app="a"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting or d), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_the_setting_is_read():
    assert shared.shared_dir(session("yarn", "hdfs:///x/")) == "hdfs:///x"


def test_a_local_session_gets_its_own():
    one = shared.shared_dir(session("local[2]", None, "one"))
    assert one.startswith("file://") and one == shared.shared_dir(session("local[2]", None, "one"))
    assert one != shared.shared_dir(session("local[2]", None, "two"))


def test_a_cluster_needs_one():
    with pytest.raises(RuntimeError):
        shared.shared_dir(session("spark://x", None, "three"))


def test_tables_are_read_back(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    got = shared.materialize(df, "t")
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == [(1, None), (2, "b")]
    assert shared.materialize(df.where("false"), "t").count() == 0
