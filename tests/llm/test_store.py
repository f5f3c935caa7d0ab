"""The shared folder: taken from the session, qualified, or an error."""

from types import SimpleNamespace

import pytest

from trawl.llm import _store


def _session(spark, folder, master="local[4]"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: folder if k == "spark.checkpoint.dir" else d),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{folder}-{master}", getCheckpointDir=lambda: None),
        _jvm=spark._jvm, _jsc=spark._jsc,
    )


def test_without_a_folder(spark):
    one = _session(spark, None)
    folder = _store.shared_dir(one)
    assert folder.startswith("file:///") and _store.shared_dir(one) == folder
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            _store.shared_dir(_session(spark, None, master))


def test_a_folder_without_a_scheme(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert _store.shared_dir(_session(spark, "/user/ck/", "yarn")) == "file:///user/ck"
    try:
        conf.set("fs.defaultFS", "hdfs://localhost:9")
        assert _store.shared_dir(_session(spark, "/user/ck", "yarn")) == "hdfs://localhost:9/user/ck"
        assert _store.shared_dir(_session(spark, "file:///x", "yarn")) == "file:///x"
    finally:
        conf.set("fs.defaultFS", before)


def test_tables_are_dropped_once_used(spark, tmp_path):
    first = _store.written(spark.range(5), "first")
    second = _store.written(first.selectExpr("id * 2 AS id"), "second", first)
    assert sorted(r.id for r in second.collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(Exception, match="(?i)not.*exist|not_found|no such"):
        first.collect()
