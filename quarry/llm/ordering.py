"""A total order over all rows without one big sort: sampled splitters, ranges, and prefix sums over the ranges.

Size-weighted key samples give quantile boundaries; rows go to the range between two boundaries, overfull ranges are
subdivided, and each range is ordered by itself. Only boundaries and one total for each range (both bounded) reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_RANGES, ROWS, STEP = 4096, 2_000_000, 64
LEAST = 1000  # rows that a range may hold whatever the mean


def arrivals(df: DataFrame, keys: list[str], rate: Column, sample: int) -> list[tuple]:
    """A sample of rows in the order of their keys: those with the smallest exponential arrival at their rate; the columns after the keys come along."""
    unit = (F.shiftrightunsigned(F.xxhash64(*keys), 11) + 0.5) / float(1 << 53)
    drawn = df.withColumn("_arrival", -F.log(unit) / rate).orderBy("_arrival", *keys).limit(sample).drop("_arrival")
    return [tuple(r) for r in drawn.select(F.sort_array(F.collect_list(F.struct(*keys, *[c for c in df.columns if c not in keys]))).alias("k")).first()["k"]]


def quantiles(rows: list[tuple], parts: int) -> list[tuple]:
    """Boundaries of `parts` runs of sorted rows, each once."""
    return list(dict.fromkeys(rows[len(rows) * i // parts] for i in range(1, parts) if len(rows) * i // parts > len(rows) * (i - 1) // parts))


def range_of(df: DataFrame, keys: list[str], cuts: list[tuple]) -> Column:
    """Index of the range: how many boundaries are at or below the key (nulls come first). Every STEP-th boundary is tried first."""
    if not cuts:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    listed = lambda some: F.array(*[F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, cut, strict=True)]) for cut in some])
    made, every = listed(cuts), listed(cuts[STEP - 1 :: STEP]) if len(cuts) >= STEP else None
    below = lambda some, key: F.size(F.filter(some, lambda cut: cut <= key))
    if every is None:
        find = lambda key: below(made, key)
    else:
        find = lambda key: F.transform(F.array(below(every, key) * STEP), lambda base: base + below(F.slice(made, base + 1, STEP), key))[0]
    # the key is bound once: as a free column of the lambda its expression would be evaluated for each boundary
    return F.transform(F.array(F.struct(*keys)), find)[0]


def boundaries(df: DataFrame, keys: list[str], weight: str, ranges: int, sample: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Quantile boundaries of a size-weighted key sample, and (rows, weight) of each range between them.

    A range with over twice the mean of rows or of weight is subdivided by a sample of its own, until none is left or
    its rows have one key.
    """
    cuts = quantiles(arrivals(df.select(*keys, weight), keys, F.col(weight), sample), ranges)
    cuts = list(dict.fromkeys(c[: len(keys)] for c in cuts))
    while True:
        ranged = df.select(*keys, weight, range_of(df, keys, cuts).alias("_range"))
        totals = {r["_range"]: (r["n"], r["w"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()}  # one row for each range
        rows, mass = sum(t[0] for t in totals.values()), sum(t[1] for t in totals.values())
        share = {i: max(n * ranges / rows, w * ranges / mass) for i, (n, w) in totals.items() if n > LEAST}
        over = {i: x for i, x in share.items() if x > 2}
        if not over or len(cuts) > 2 * MOST_RANGES:
            return cuts, totals
        rate = F.col(weight) / float(mass) + 1.0 / rows
        drawn = arrivals(ranged.filter(F.col("_range").isin(*over)).select(*keys, "_range", weight), keys, rate, sample)
        finer: list[tuple] = []
        for i in range(len(cuts) + 1):
            if i in over:
                finer += quantiles([r[: len(keys)] for r in drawn if r[len(keys)] == i], 1 + round(over[i]))
            finer += cuts[i : i + 1]
        finer = list(dict.fromkeys(finer))
        if len(finer) == len(cuts):
            return cuts, totals
        cuts = finer


def with_global_order(df: DataFrame, keys: list[str], weight: str, ranges: int = 256, sample: int = 8192) -> tuple[DataFrame, int, int]:
    """Add `rank` (0-based place in the order of keys) and `before` (sum of weight over all earlier rows).

    Returns the frame, the number of rows and the total weight. Rows that tie on all keys must be alike in weight. There
    are `ranges` ranges, or more for over ROWS rows in each, MOST_RANGES at most, and overfull ones are subdivided.
    """
    wanted = min(MOST_RANGES, max(ranges, df.count() // ROWS))
    cuts, totals = boundaries(df, keys, weight, wanted, max(sample, 16 * wanted))
    ranged = df.withColumn("_range", range_of(df, keys, cuts))
    rows_before, weight_before, n, w = [], [], 0, 0
    for i in range(max(totals, default=0) + 1):
        rows_before.append(n)
        weight_before.append(w)
        n, w = n + totals.get(i, (0, 0))[0], w + totals.get(i, (0, 0))[1]
    inside = Window.partitionBy("_range").orderBy(*keys)
    base = lambda values: F.element_at(F.lit(values).cast("array<bigint>"), F.col("_range") + 1)
    ordered = ranged.withColumns(
        {
            "rank": base(rows_before) + F.row_number().over(inside) - 1,
            "before": base(weight_before) + F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight),
        }
    )
    return ordered.drop("_range"), n, w
