"""Windowed counts, sessions and first-seen keys: one expression for streams and for batches."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quarry.operators import sketches as sk


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """events as a stream of Parquet files."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n, value by window; late events beyond `late` are dropped on a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n by session."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event of each key: exact deduplication within the watermark on a stream, the earliest event in a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    first = F.min(F.struct("ts", "event_id"))
    return events.groupBy(*keys).agg(first.alias("f")).select(*keys, F.col("f.event_id").alias("event_id"), F.col("f.ts").alias("ts"))


def keep_counts(path: str, key: str, width: int, depth: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's count-min counters under path/batch=N. A repeated batch overwrites its own, so every event counts once."""
    return lambda batch, n: sk.cms_build(batch, key, width, depth).write.mode("overwrite").parquet(f"{path}/batch={n}")


def kept_counts(spark: SparkSession, path: str) -> DataFrame:
    """row, cell, n: the counters of all batches added up, as sketches merge."""
    return spark.read.parquet(path).groupBy("row", "cell").agg(F.sum("n").alias("n"))


def dgim_stream(events: DataFrame, key: str, order: list[str], bit: str, size: int, most: int = 2) -> DataFrame:
    """key, seen, estimate: ones among the last `size` events of each key, updated with each batch.

    The state of a key is its few buckets. Events are ordered within a batch only; later batches count as later.
    """

    def run(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary = sk.Dgim(size, most)
        if state.exists:
            (levels,) = state.get
            saved = json.loads(levels)
            summary.now, summary.total = saved["now"], saved["total"]
            summary.levels = [deque(x) for x in saved["levels"]]
        for one in pd.concat(list(frames)).sort_values(order)[bit]:
            summary.add(bool(one))
        state.update((json.dumps({"now": summary.now, "total": summary.total, "levels": [list(x) for x in summary.levels]}),))
        yield pd.DataFrame({key: [names[0]], "seen": [summary.now], "estimate": [summary.estimate()]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, bit, *order).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seen long, estimate long", "levels string", "update", "NoTimeout")
