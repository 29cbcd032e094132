"""Cleaning, profiling, concentration and feature operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; `order` must end in a unique key. Spark limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n, share: the most frequent value of each key (ties: the smaller) and its share of the key's rows."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value))).alias("b"), F.sum("n").alias("t"))
    return best.select(key, F.col(f"b.{value}").alias(value), (-F.col("b.n")).alias("n"), (-F.col("b.n") / F.col("t")).alias("share"))


def impute_group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Missing values get their group's median (an element of it), or the overall one; `imputed` tells. Null groups get the overall one."""
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")
    by_group = df.filter(F.col(group).isNotNull()).groupBy(group).agg(median.alias("_median"))
    overall = df.agg(median.alias("_overall"))
    out = df.join(by_group, group, "left").crossJoin(F.broadcast(overall))  # one row
    return out.withColumns({"imputed": F.col(value).isNull(), value: F.coalesce(value, "_median", "_overall")}).drop("_median", "_overall")


def tukey_flag(df: DataFrame, value: str, factor: float = 3.0) -> DataFrame:
    """`outlier`: beyond the quartiles of log1p(value) by more than `factor` times their distance."""
    logged = F.log1p(value)
    bounds = df.agg(F.percentile(logged, F.lit(0.25)).alias("q1"), F.percentile(logged, F.lit(0.75)).alias("q3"))
    low, high = F.col("q1") - factor * (F.col("q3") - F.col("q1")), F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("outlier", (logged < low) | (logged > high)).drop("q1", "q3")


def winsorize(df: DataFrame, value: str, quantile: float = 0.999) -> DataFrame:
    """Cap value at an element of it, the quantile."""
    cap = df.agg(F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY {value})").alias("_cap"))
    return df.crossJoin(F.broadcast(cap)).withColumn(value, F.least(value, "_cap")).drop("_cap")


def cleaning_log(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, rows_in, rows_out of filters applied one after another, in one pass over df."""
    passed = [reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for _, c in steps[: i + 1]]) for i in range(len(steps))]
    counted = df.agg(F.count("*").alias("n0"), *[F.count_if(p).alias(f"n{i + 1}") for i, p in enumerate(passed)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{i}").alias("rows_in"), F.col(f"n{i + 1}").alias("rows_out")) for i, (name, _) in enumerate(steps)])
    return counted.select(F.inline(rows))


def profile_nulls(df: DataFrame) -> DataFrame:
    """column_name, nulls, null_pct, from one aggregate turned on its side."""
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"), F.round(100.0 * F.col(c) / F.col("_n"), 4).alias("null_pct")) for c in df.columns])
    return counted.select(F.inline(rows))


def profile_cardinality(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """column_name, approx_distinct of all columns but arrays."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() != "array"]
    counted = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in names])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("approx_distinct")) for c in names])))


def gini(df: DataFrame, groups: list[str], value: str, least: int = 1) -> DataFrame:
    """Gini coefficient of positive values by group (of `least` values or more): (2 sum(i x_i)) / (n sum x) - (n + 1) / n."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(value))
    ranked = df.filter(F.col(value) > 0).select(*groups, value).withColumn("_i", place)
    sums = ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(value).alias("_s"), F.sum(F.col("_i") * F.col(value)).alias("_w"))
    return sums.filter(F.col("n") >= least).select(*groups, "n", (2 * F.col("_w") / (F.col("n") * F.col("_s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def range_ranks(df: DataFrame, value: str, tie: str, descending: bool = False, ranges: int = 64) -> DataFrame:
    """Add rank (from 1) and running (sum of value up to here) in the order of (value, tie), with no single-task sort.

    Rows go to ranges between approximate quantiles of value; ranks and sums within a range are offset by the totals
    of the ranges before.
    """
    cuts = sorted(set(df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    part = -part if descending else part
    placed = df.withColumn("_part", part)
    order = [F.col(value).desc() if descending else F.col(value), F.col(tie)]
    inside = Window.partitionBy("_part").orderBy(*order)
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s"))
    out = placed.join(F.broadcast(totals), "_part")
    return out.withColumns(
        {"rank": F.col("_n") + F.row_number().over(inside), "running": F.col("_s") + F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))}
    ).drop("_part", "_n", "_s")


def numbered(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """column, number: its distinct values with numbers from 0 without gaps, counted within `parts` hash ranges and offset by their totals."""
    one = df.select(column).distinct().withColumn("_part", F.pmod(F.xxhash64(column), F.lit(parts)))
    totals = one.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return one.join(F.broadcast(totals), "_part").select(column, (F.col("_n") + inside - 1).alias("number"))


def hhi(df: DataFrame, key: str, partner: str, amount: str) -> DataFrame:
    """key, hhi, top_share: concentration of a key's amount over its partners."""
    pairs = df.groupBy(key, partner).agg(F.sum(amount).alias("_m"))
    sums = pairs.groupBy(key).agg(F.sum("_m").alias("_t"), F.sum(F.col("_m") * F.col("_m")).alias("_q"), F.max("_m").alias("_x"))
    return sums.select(key, (F.col("_q") / (F.col("_t") * F.col("_t"))).alias("hhi"), (F.col("_x") / F.col("_t")).alias("top_share"))


def count_log_bins(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1 to bins), n: positive values in log-spaced bins; the last holds its upper edge."""
    at = F.least(F.floor((F.log10(value) - low) / ((high - low) / bins)) + 1, F.lit(bins))
    return df.filter((F.col(value) > 0) & F.log10(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
