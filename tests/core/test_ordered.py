import pytest
from pyspark.sql import functions as F

from loomery.operators import metadata, ordered

IDS = ["DRS000003", "DRS000004", "DRS000005", "DRS000006", "DRS000007", "DRS000008", "DRS000011", "SRS002116", "SRS002117", "SRS002118"]
RANGES = ["DRS000003-DRS000008", "DRS000011", "SRS002116-SRS002118"]


def test_ranges(spark):
    ids = spark.createDataFrame([(i,) for i in IDS], "id string")
    ranges = ordered.compress_ranges(ids)
    assert sorted(r[0] for r in ranges.collect()) == RANGES
    assert sorted(r[0] for r in ordered.expand_ranges(ranges).collect()) == IDS


def test_unnest(spark):
    cols = "run string, fastq_ftp string, fastq_md5 string, fastq_bytes string, submitted_ftp string, submitted_md5 string, submitted_bytes string"
    rows = [("r1", "", "", "", "a;b", "x;y", "1;2"), ("r2", None, None, None, "c;d", "z;w", "3;4"), ("r3", "e;f", "u;v", "5;6", "", "", "")]
    lists = {n: (f"fastq_{n}", f"submitted_{n}") for n in ("ftp", "md5", "bytes")}
    got = metadata.unnest_lockstep(spark.createDataFrame(rows, cols), ["run"], lists).collect()
    assert len(got) == 6
    assert all(r[c] and ";" not in r[c] for r in got for c in lists)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_batches(spark, size):
    from loomery.operators.dedup import batches

    for n in (16, 1, 3):
        got = batches(spark.range(n), "id", size).orderBy("id").collect()
        assert [r.batch for r in got] == [k // size for k in range(n)]


def test_conflicts_fail(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(metadata.coalesced(F.col("x"), F.col("y"))).collect()] == ["a", "a", "b", None]
    with pytest.raises(Exception, match="conflicting"):
        spark.createDataFrame([("a", "b")], df.schema).select(metadata.coalesced(F.col("x"), F.col("y"))).collect()
    with pytest.raises(Exception, match="conflicting"):
        metadata.unique_or_fail(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k").collect()


def test_coordinates(spark):
    df = spark.createDataFrame([("12.5 N",), ("12.5 S",), ("-3",), ("10°30'0\"W",), ("missing",)], "c string")
    assert [r[0] for r in df.select(metadata.coordinate(F.col("c"))).collect()] == [12.5, -12.5, -3.0, -10.5, None]
    assert [r[0] for r in df.limit(2).select(metadata.hemisphere(metadata.coordinate(F.col("c")), "N", "S")).collect()] == ["12.5000 N", "12.5000 S"]


def test_trim_keeps_small_groups(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(40)] + [("b", float(k)) for k in range(5)], "g string, v double")
    got = ordered.trim_extremes(df, "g", "v")
    assert got.where("g = 'a'").agg(F.min("v"), F.max("v")).first() == (2.0, 37.0)
    assert got.where("g = 'b'").count() == 5
