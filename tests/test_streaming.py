"""Streams end in the same results as the batch forms of their operators."""

from pyspark.sql import functions as F

from intervale.operators import lifecycle as lc
from intervale.shipping import ship
from intervale.sources.substrate import derived
from intervale.streaming import alerts, tasks, uploads

SMALL = "/root/testdata/sf0.001"


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).toPandas()
    finally:
        q.stop()


def test_alert_stream_equals_batch(spark, tmp_path):
    ship(spark)
    probes = alerts.probes_of(spark.read.parquet(f"{SMALL}/events.parquet"))
    want = alerts.batch_alerts(probes).toPandas()
    # Files by time, one a batch, so that state is carried over.
    for k in range(3):
        probes.where(F.floor(F.col("at_s") / 30_000) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    covered = want[want.at_s < 90_000]
    stream = spark.readStream.schema(probes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(alerts.stream_alerts(stream), "append", "alerts_out")
    key = lambda d: sorted(map(tuple, d[["service", "at_s", "key", "level"]].to_numpy().tolist()))
    assert key(got) == key(covered) and len(got)


def test_task_states_equal_the_fold(spark, tmp_path):
    ship(spark)
    events = derived(spark, SMALL, "task_events").select("task_id", "event_id", "ts", "status", "message")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drain(tasks.stream_states(stream), "update", "states_out").set_index("task_id")["status"].to_dict()
    assert got == lc.fold_states(events).toPandas().set_index("task_id")["status"].to_dict()


def test_chunks_are_taken_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "2024-01-01 00:00:00"), (1, 0, "2024-01-01 00:01:00"), (1, 1, "2024-01-01 00:02:00")], "session int, chunk_index int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert len(drain(uploads.distinct_chunks(stream), "append", "chunks_out")) == 2
