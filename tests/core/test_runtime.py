from types import SimpleNamespace

import pytest

from loomery import runtime


class Context:
    def __init__(self, master):
        self.master, self.at = master, None

    def getCheckpointDir(self):
        return self.at

    def setCheckpointDir(self, at):
        self.at = at


def plain(master, **conf):
    return SimpleNamespace(conf=conf, sparkContext=Context(master))


def test_shared_dir():
    assert runtime.shared_dir(plain("spark://a:1", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    own = plain("local[4]")
    assert runtime.shared_dir(own) == runtime.shared_dir(own) == own.sparkContext.at
    for master in ("spark://a:1", "local-cluster[2,1,512]", "yarn"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(plain(master))


def test_broadcasts_are_checked_by_bytes(spark):
    scratch = runtime.Scratch(spark, "test")
    df = spark.createDataFrame([(1, "a" * 1000, [1, 2, 3], [["x"] * 50], None)], "a bigint, b string, c array<int>, d array<array<string>>, e struct<f:string,g:int>")
    t = scratch.keep(df, "t")
    assert 1000 + 50 * 16 < runtime.broadcast_bytes(t) < 3000
    assert runtime.small_enough(t, 3000) and not runtime.small_enough(t, 1000)
    assert runtime.broadcast_bytes(t.limit(0)) == 0


def test_scratch_tables_go(spark):
    scratch = runtime.Scratch(spark, "test")
    a, b, c = (scratch.keep(spark.range(k), "t") for k in (1, 2, 3))
    scratch.keep_only(b)
    assert b.count() == 2 and len(scratch.paths) == 1
    for gone in (a, c):
        assert not runtime._exists(spark, gone._loomery_path)
    scratch.drop(b)
    assert not runtime._exists(spark, b._loomery_path)


def test_unused_names(spark):
    assert runtime.unused(spark.createDataFrame([(1, 2)], "a int, _KEY int"), "key", "n") == ["__key", "__n"]
