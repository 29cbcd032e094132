"""Sampling and stream summaries as mergeable tables: Bloom filters, count-min, DGIM, bottom-k and keyed samples."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import portable_hash, unit_hash


def key_sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """All rows of a share of the keys; null keys, which would be one large key, are left out."""
    return df.filter(F.col(key).isNotNull() & (unit_hash(F.col(key), seed) < share))


def row_sample(df: DataFrame, unique: str, share: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample of rows by hash of a unique column."""
    return df.filter(unit_hash(F.col(unique), seed) < share)


def bottom_k(df: DataFrame, unique: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows: those with the smallest hashes. Mergeable, unlike a reservoir."""
    return df.orderBy(portable_hash(F.col(unique), seed), unique).limit(k)


def bloom_size(expected: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for a false positive rate; no keys count as one."""
    expected = max(expected, 1)
    bits = math.ceil(-expected * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / expected * math.log(2)))


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """Double hashing: h1 + i * h2, with h2 at least 1."""
    first, second = portable_hash(key, 1) % bits, portable_hash(key, 2) % bits
    step = F.when(second == 0, F.lit(1)).otherwise(second)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (first + i * step) % bits)


def bloom_build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The set bits, as rows of `bit`."""
    return keys.select(F.explode(bloom_positions(F.col(key), bits, hashes)).alias("bit")).distinct()


def bloom_probe(keys: DataFrame, key: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """key, maybe: whether all bits of a key are set. No false negatives."""
    probes = keys.select(key).distinct().select(key, F.explode(F.array_distinct(bloom_positions(F.col(key), bits, hashes))).alias("bit"))
    hit = probes.join(filter_bits.withColumn("_set", F.lit(1)), "bit", "left")
    return hit.groupBy(key).agg((F.count("*") == F.count("_set")).alias("maybe"))


def cms_width(expected: int, rate: float, depth: int) -> int:
    """Cells of each row for so many keys: one that isn't held shares all its cells with a probability of `rate`; no keys count as one."""
    return math.ceil(max(expected, 1) / -math.log(1 - rate ** (1.0 / depth)))


def cms_cells(key: Column, width: int, depth: int) -> Column:
    """(row, cell) of a key in each row of a count-min sketch."""
    return F.array(*[F.struct(F.lit(d).alias("row"), (portable_hash(key, 100 + d) % width).alias("cell")) for d in range(depth)])


def cms_build(df: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """row, cell, n: the counters that aren't 0. Counters of two sketches add up."""
    counted = df.groupBy(key).agg(F.count("*").alias("_n"))
    return counted.select("_n", F.inline(cms_cells(F.col(key), width, depth))).groupBy("row", "cell").agg(F.sum("_n").alias("n"))


def cms_estimate(keys: DataFrame, key: str, sketch: DataFrame, width: int, depth: int) -> DataFrame:
    """key, estimate: the least of a key's counters; never below its true count."""
    cells = keys.select(key).distinct().select(key, F.inline(cms_cells(F.col(key), width, depth)))
    return cells.join(sketch, ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


class Dgim:
    """Ones among the last `size` bits of a stream, in buckets of powers of two, at most `most` of a size.

    levels[i] holds the time of the newest one in each bucket of 2**i ones, oldest bucket first, so the oldest of all
    leads the last level. A bit costs one step, and one more for each level that a merge reaches.
    """

    def __init__(self, size: int, most: int = 2) -> None:
        self.size, self.most, self.now, self.total = size, most, 0, 0
        self.levels: list[deque[int]] = []

    def add(self, bit: bool) -> None:
        self.now += 1
        if self.levels and self.levels[-1][0] <= self.now - self.size:
            self.levels[-1].popleft()
            self.total -= 1 << len(self.levels) - 1
            while self.levels and not self.levels[-1]:
                self.levels.pop()
        if bit:
            self.total += 1
            self._put(self.now, 0)

    def _put(self, newest: int, i: int) -> None:
        """A bucket of 2**i ones joins its level; one too many, and the two oldest there become one of the next level."""
        if i == len(self.levels):
            self.levels.append(deque())
        level = self.levels[i]
        level.append(newest)
        if len(level) > self.most:
            level.popleft()
            self._put(level.popleft(), i + 1)

    def estimate(self) -> int:
        """All ones, less half of the oldest bucket."""
        return self.total - (1 << len(self.levels) - 1) // 2 if self.levels else 0


def dgim_by_key(df: DataFrame, key: str, order: list[str], bit: str, size: int, most: int = 2) -> DataFrame:
    """key, estimate at the end of each key's stream. Tasks read keys in order and hold one key's buckets at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            done = []
            for k, b in zip(frame[key], frame[bit], strict=True):
                if state is None or k != current:
                    if state is not None:
                        done.append((current, state.estimate()))
                    current, state = k, Dgim(size, most)
                state.add(bool(b))
            yield pd.DataFrame(done, columns=[key, "estimate"])
        if state is not None:
            yield pd.DataFrame([(current, state.estimate())], columns=[key, "estimate"])

    kind = df.schema[key].dataType.simpleString()
    ordered = df.select(key, bit, *order).repartition(key).sortWithinPartitions(key, *order).select(key, bit)
    return ordered.mapInPandas(run, f"{key} {kind}, estimate long")
