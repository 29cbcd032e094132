"""Sharding by sampled splitters (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, utf8
from quarry.llm.ordering import with_global_order


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int = 256, sample: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows into `shards` shards of near-equal bytes, in the order of (text hash, id).

    Size-weighted key samples choose quantile boundaries and rows are partitioned into `ranges` ranges between them.
    A range that comes out overfull, by rows or bytes, is subdivided by a sample of its own, copies of one text by their
    ids, so that no task sorts more than a few of the mean. Exact totals of the ranges then place every row on one byte
    line, and a shard's bytes differ from the mean by less than one document.

    Equal texts are neighbours in that order, so a group of copies stays in one shard unless an end falls inside it.
    Returns one row per input row: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (null).
    Null or empty text: size 1, crc 0. Null ids come first among equal texts. Repeated rows get a slot each.
    Empty input: no rows. Further columns of docs aren't read.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.length(utf8(F.col(text_col))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(utf8(F.col(text_col))).alias("text_crc32"),
        F.substring(F.md5(utf8(F.col(text_col))), 1, 16).alias("_key"),
    )
    ordered, _, total = with_global_order(slim, ["_key", "doc_id"], "size", ranges, sample)
    placed = ordered.withColumn("shard", F.expr(f"int(((2 * before + size) * {shards}) div {max(1, 2 * total)})"))
    placed = materialize(placed.drop("_key", "before"), "shards")
    first = placed.groupBy("shard").agg(F.min("rank").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, **named: object) -> DataFrame:
    """Write whole records under path/part=N (N: the shard) and return the assignment.

    A record goes to the shard of its (id, crc, size); of repeated rows that a shard's end parts, each shard gets its number.
    """
    given = shard_documents(docs, shards, **named)
    alike = Window.partitionBy("id", "crc", "size").orderBy
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.crc32(utf8(F.col("text"))).alias("crc"), (F.length(utf8(F.col("text"))) + F.lit(1)).cast("long").alias("size"))
    keyed = keyed.withColumn("nth", F.row_number().over(alike("doc.text")))
    place = given.select(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc"), "size", "shard").withColumn("nth", F.row_number().over(alike("shard")))
    same = keyed["id"].eqNullSafe(place["id"])
    for c in ("crc", "size", "nth"):
        same &= keyed[c] == place[c]
    joined = keyed.join(place, same).select(keyed["doc"], place["shard"].alias("_part"))
    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    for n in range(shards):
        joined.filter(F.col("_part") == n).select(*columns).write.parquet(f"{path}/part={n}")
    return given
