"""Exact deduplication by content-defined chunk recipes (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize, utf8

SPACES = r"[\x20\x09-\x0D]+"

#: A chunk runs to the first anchor that ends at its 256th character or later, or to 2048 characters. An anchor is a
#: coincidence 17 places apart: of one character that is a rarer Latin letter, a digit, a capital or of a large script (1
#: place in some 250 of a text), or of two neighbours in any other script. Ends depend on the chunk's own characters only.
CHUNK = r"(?s).{237,2029}?(?:([bcfgmpwy0-9A-Z\x{2E80}-\x{10FFFF}]).{16}\1.|([\x{80}-\x{2E7F}])(.).{15}\2\3)|.{1,2048}"


def normalized(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """Content-defined chunks of a text, in order; joined they give the text again. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def recipes(docs: DataFrame, bits: int = 64, pattern: str = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 (binary) and recipe: the ordered list of verified chunk identifiers.

    The distinct chunks are gathered once, by hash and content, each map task sending a chunk only once. Hashes that
    stand for one content only are identifiers as they are; contents that share a hash get numbers, and only the texts
    that hold such a hash are resolved by content.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalized(F.col(text_col)).alias("text"))
    listed = text.select(F.explode(chunks(F.col("text"), pattern)).alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("hash"), "chunk")
    distinct = listed.groupBy("hash", "chunk").agg(F.lit(1).alias("one"))
    shared = distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    sha = F.unhex(F.sha2(utf8(F.col("text")), 256))
    plain = text.select("doc_id", sha.alias("text_sha256"), F.transform(chunks(F.col("text"), pattern), lambda c: chunk_hash(c, bits)).alias("recipe"))
    shared = materialize(shared, "chunk-collisions")
    if shared.isEmpty():
        discard(shared)
        return plain
    number = F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))
    numbered = distinct.join(shared, "hash", "left_semi").select("hash", "chunk", number.alias("number"))
    held = plain.select("text_sha256", F.explode("recipe").alias("hash")).join(shared, "hash", "left_semi").select("text_sha256").distinct()
    # any row of a text gives the recipe of that text
    once = text.select(sha.alias("text_sha256"), "text").join(held, "text_sha256", "left_semi").dropDuplicates(["text_sha256"])
    each = once.select("text_sha256", F.posexplode(chunks(F.col("text"), pattern)).alias("place", "chunk")).withColumn("hash", chunk_hash(F.col("chunk"), bits))
    found = each.join(numbered, ["hash", "chunk"], "left").select("text_sha256", F.struct("place", "hash", F.coalesce("number", F.lit(0)).alias("number")).alias("step"))
    step = lambda h, n: F.struct(h.alias("hash"), n.alias("number"))
    exact = found.groupBy("text_sha256").agg(F.transform(F.sort_array(F.collect_list("step")), lambda s: step(s["hash"], s["number"])).alias("_recipe"))
    return plain.join(exact, "text_sha256", "left").select("doc_id", "text_sha256", F.coalesce("_recipe", F.transform("recipe", lambda h: step(h, F.lit(0)))).alias("recipe"))


def exact_duplicates(docs: DataFrame, bits: int = 64, pattern: str = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; equal texts (see normalized) form a group.

    Documents move as lists of 8-byte identifiers, some 1/100 of their text. Groups are counted map-side first, and
    joined back on the list, where adaptive execution splits a hot one.

    Null text: as empty; all empty texts are one group. Null ids: never the smallest unless a group has no other; of
    repeated rows with the smallest id one stays. Empty input: no rows. Further columns aren't read.
    """
    listed = materialize(recipes(docs, bits, pattern, id_col, text_col), "recipes")  # read twice below
    groups = listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id"))
    return (
        listed.join(groups, "recipe")
        .drop("recipe")
        .withColumn("_copy", copy)
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: the first of each group of equal texts; of repeated rows one stays."""
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))  # without nulls one exchange serves window and join
    kept = exact_duplicates(docs).filter("kept").select(name.alias("_id"), F.unhex("text_sha256").alias("_sha"))
    keyed = docs.select(F.struct("*").alias("doc"), name.alias("_id"), F.unhex(F.sha2(utf8(normalized(F.col("text"))), 256)).alias("_sha"))
    copy = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("doc.text"))
    return keyed.withColumn("_copy", copy).filter("_copy = 1").join(kept, ["_id", "_sha"], "left_semi").select("doc.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS txt FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY txt) AS keep_id, count(*) OVER (PARTITION BY txt) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY txt) AS kept, sha256(txt) AS text_sha256
FROM t
"""
