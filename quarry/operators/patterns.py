"""Frequent itemsets and association rules over baskets in long form (basket, item), distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def basket_stats(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """baskets, mean_size, max_size, share of baskets with two items or more."""
    sizes = baskets.groupBy(basket).agg(F.count_distinct(item).alias("s"))
    return sizes.agg(F.count("*").alias("baskets"), F.round(F.avg("s"), 6).alias("mean_size"), F.max("s").alias("max_size"), F.round(F.avg((F.col("s") >= 2).cast("double")), 6).alias("share_2"))


def apriori(baskets: DataFrame, basket: str, item: str, min_support: float, max_size: int = 3) -> DataFrame:
    """items (sorted array), n, support: itemsets in a share of min_support or more of all baskets, level by level.

    A basket's frequent sets of one size are extended by its frequent items beyond their last one; extensions with an
    infrequent subset are dropped by semi-joins before they are counted.
    """
    pairs = baskets.select(F.col(basket).alias("k"), F.col(item).alias("i")).distinct()
    total = pairs.select("k").distinct().count()
    least = min_support * total
    single = pairs.groupBy("i").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    known = pairs.join(single.select("i"), "i", "left_semi")
    held = known.select("k", F.array("i").alias("items"))
    level = single.select(F.array("i").alias("items"), "n")
    out = level
    for size in range(2, max_size + 1):
        grown = held.join(known, "k").filter(F.col("i") > F.element_at("items", -1)).select("k", F.concat("items", F.array("i")).alias("items"))
        if size > 2:
            for drop in range(size - 1):  # without the last item it is frequent by construction
                rest = F.concat(F.slice("items", 1, drop), F.slice("items", drop + 2, size))
                grown = grown.withColumn("_rest", rest).join(level.select(F.col("items").alias("_rest")), "_rest", "left_semi").drop("_rest")
        level = grown.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        held = grown.join(level.select("items"), "items", "left_semi")
        out = out.unionByName(level)
    return out.withColumn("support", F.col("n") / F.lit(float(total)))


def rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """antecedent, consequent, support, confidence, lift (rounded to 5, 4, 3) of all splits of the itemsets."""
    sets = itemsets.filter(F.size("items") > 1)
    masks = F.sequence(F.lit(1), F.expr("cast(pow(2, size(items)) as int) - 2"))
    picked = lambda m, want: F.filter("items", lambda x, i: F.getbit(m, i) == want)
    split = sets.select("items", "support", F.explode(masks).alias("m")).select("support", picked(F.col("m"), 1).alias("antecedent"), picked(F.col("m"), 0).alias("consequent"))
    side = lambda n: itemsets.select(F.col("items").alias(n), F.col("support").alias(f"_{n}"))
    joined = split.join(side("antecedent"), "antecedent").join(side("consequent"), "consequent")
    confidence = F.col("support") / F.col("_antecedent")
    return joined.filter(confidence >= min_confidence).select(
        "antecedent", "consequent", F.round("support", 5).alias("support"), F.round(confidence, 4).alias("confidence"), F.round(confidence / F.col("_consequent"), 3).alias("lift")
    )


def relevance(found: DataFrame, min_support: float, min_lift: float, k: int) -> DataFrame:
    """The k rules with the largest norm of scaled support and lift, above both floors."""
    kept = found.filter((F.col("support") >= min_support) & (F.col("lift") >= min_lift))
    everything = Window.partitionBy()
    scaled = lambda c: (F.col(c) - F.min(c).over(everything)) / F.greatest(F.max(c).over(everything) - F.min(c).over(everything), F.lit(1e-12))
    scored = kept.withColumn("score", F.round(F.hypot(scaled("support"), scaled("lift")), 6))
    return scored.orderBy(F.desc("score"), "antecedent", "consequent").limit(k)
