"""Entity resolution: exact keys, rivals, fuzzy pairs, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import id_kind, legal_name
from quarry.operators.relational import mode_per_key
from quarry.operators.similarity import char_shingles, jaccard


def exact_keys(records: DataFrame, code: str, name: str, place: str) -> DataFrame:
    """code, key, normal: one canonical key for each code, by its kind: the number, or name and modal place, or the code itself."""
    names = mode_per_key(records.withColumn("_normal", legal_name(F.col(name))), code, "_normal").select(code, F.col("_normal").alias("normal"))
    places = mode_per_key(records.filter(F.col(place).isNotNull()), code, place).select(code, F.col(place).alias("_place"))
    kind = id_kind(F.col(code))
    key = F.when(kind == "company", F.concat(F.lit("TAX-"), code)).when(kind == "local", F.concat(F.lit("CON-"), "normal", F.lit("|"), F.coalesce(F.col("_place").cast("string"), F.lit("")))).when((kind == "foreign") & (F.col("normal") != ""), F.concat(F.lit("EXT-"), "normal")).otherwise(F.concat(F.lit("ID-"), code))
    return names.join(places, code, "left").select(code, key.alias("key"), "normal")


def rivals(participation: DataFrame, group: str, code: str, keys: DataFrame) -> DataFrame:
    """key: keys that stand for two codes or more in one group, and so can't be one entity."""
    return participation.join(keys, code).groupBy(group, "key").agg(F.count_distinct(code).alias("n")).filter("n > 1").select("key").distinct()


def roll_back(keys: DataFrame, rival: DataFrame, code: str) -> DataFrame:
    """Rival keys become ID-<code> again."""
    marked = keys.join(rival.withColumn("_rival", F.lit(True)), "key", "left")
    return marked.select(code, F.when(F.col("_rival"), F.concat(F.lit("ID-"), F.col(code))).otherwise(F.col("key")).alias("key"))


def fuzzy_pairs(names: DataFrame, key: str, name: str, block: str, similarity: float = 0.85) -> DataFrame:
    """a, b, jaccard: names alike in a block, by trigrams of their sorted tokens; names with different numerals never match.

    Exact: two sets of that similarity share a trigram among the rarest size - ceil(similarity * size) + 1 of each, so
    only these are joined, within a block and its numerals.
    """
    tokens = F.array_join(F.array_sort(F.split(F.col(name), " ")), " ")
    mark = F.array_join(F.array_sort(F.regexp_extract_all(F.col(name), F.lit(r"[0-9]+|\b[IVX]+\b"), F.lit(0))), ",")
    made = names.select(F.col(key).alias("k"), F.struct(F.col(block).alias("block"), mark.alias("mark")).alias("at"), char_shingles(tokens, 3).alias("sh"))
    single = made.select("k", "at", F.explode("sh").alias("s"))
    rarity = single.groupBy(F.struct("s").alias("_s")).agg(F.count("*").alias("n"))
    listed = single.join(rarity, F.struct("s") == F.col("_s")).groupBy("k", "at").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("l"))
    length = F.size("l") - F.ceil(F.size("l") * similarity - 1e-9).cast("int") + 1
    rare = listed.select("k", F.explode(F.slice("l", 1, length)).alias("x"), "at").select("k", F.struct("at", "x.s").alias("in"))
    pairs = rare.withColumnRenamed("k", "a").join(rare.withColumnRenamed("k", "b"), "in").filter("a < b").select("a", "b").distinct()
    side = lambda n: made.select(F.col("k").alias(n), F.col("sh").alias(f"sh_{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", jaccard(F.col("sh_a"), F.col("sh_b")).alias("jaccard")).filter(F.col("jaccard") >= similarity)
