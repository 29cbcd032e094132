from __future__ import annotations

import time

from pyspark.sql import functions as F
from quarry.operators import sketches
from quarry.streaming import events as ev


def test_stream_agrees_with_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    stream = ev.tumbling(ev.read_events(spark, f"{tmp_path}/in"), late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("tumbled"), ev.tumbling(source.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_first_seen_drops_repeats(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.union(source).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ev.first_seen(ev.read_events(spark, f"{tmp_path}/in"), ["event_id"], "60 days")
    q = stream.writeStream.outputMode("append").format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == source.count()


def test_counters_of_batches_add_up(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    keep = ev.keep_counts(f"{tmp_path}/counts", "user_id", 16, 3)
    q = ev.read_events(spark, f"{tmp_path}/in").writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    keep(spark.read.parquet(f"{tmp_path}/in").limit(0), 99)
    got, want = ev.kept_counts(spark, f"{tmp_path}/counts"), sketches.cms_build(source, "user_id", 16, 3)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_window_counts_keep_their_state_by_key(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("bit", F.col("event_type") == "error")
    days = [r["d"] for r in source.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for part in (days[: len(days) // 2], days[len(days) // 2 :]):
        source.filter(F.to_date("ts").isin(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times
    stream = ev.dgim_stream(ev.read_events(spark, f"{tmp_path}/in"), "user_id", ["ts", "event_id"], "bit", 50)
    q = stream.writeStream.outputMode("update").format("memory").queryName("ones").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r["user_id"]: (r["seen"], r["estimate"]) for r in spark.table("ones").orderBy("seen").collect()}
    want = {r["user_id"]: r["estimate"] for r in sketches.dgim_by_key(source, "user_id", ["ts", "event_id"], "bit", 50).collect()}
    seen = {r["user_id"]: r["count"] for r in source.groupBy("user_id").count().collect()}
    assert spark.table("ones").count() > len(want) and got == {u: (seen[u], n) for u, n in want.items()}


def test_late_events_are_dropped(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double"
    for i, times in enumerate((["2024-01-01 10:00", "2024-01-03 10:00"], ["2024-01-01 11:00", "2024-01-03 11:00"], ["2024-01-09 00:00"])):
        spark.createDataFrame([(10 * i + j, 1, None, "a", 1.0) for j in range(len(times))], schema).withColumn("ts", F.element_at(F.array(*[F.lit(x).cast("timestamp") for x in times]), (F.col("event_id") % 10 + 1).cast("int"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ev.tumbling(ev.read_events(spark, f"{tmp_path}/in"), "1 day", "1 hour")
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    got = {str(r["start"])[:10]: r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"2024-01-01": 1, "2024-01-03": 2}
