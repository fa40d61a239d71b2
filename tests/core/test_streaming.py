from pyspark.sql import functions as F

from loomery.runtime import table
from loomery.streaming import incremental

SF = "/root/testdata/sf0.001"


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_running_counts_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    got = drain(incremental.running_counts(stream, "event_type"), "running", "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in events.groupBy("event_type").count().collect()}


def test_windows(spark, tmp_path):
    events = table(spark, SF, "events").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    got = drain(incremental.windowed_prevalence(stream, "ts", "event_type", "user_id", "1 day", "0 seconds"), "windows", "update")
    assert got.agg(F.sum("n_rows")).first()[0] == events.count()
