"""Comparing all rows of a table with all of another, in pairs of blocks of bounded size.

Rows are dealt to blocks by the hash of their key, and a row is sent once for each block of the other side: n rows in b
blocks move n * b rows, whatever the rows hold, and no pair becomes a row but those that the comparison returns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, TILE = 8192, 512  # of a block, and of its rows that are compared at once


def blocks_for(rows: int, size: int = ROWS, least: int = 256, spread: int = 8) -> int:
    """Blocks of `size` rows; small tables get up to `spread` blocks of `least` rows, so that all cores work."""
    return max(1, math.ceil(rows / size), min(spread, rows // least))


def _block(df: DataFrame, key: str, blocks: int) -> DataFrame:
    return df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def with_itself(rows: DataFrame, key: str, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, blocks: int) -> DataFrame:
    """run(left, right, same) for each unordered pair of blocks; same tells that both are one block."""
    pair = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(F.least("_own", i).alias("_left"), F.greatest("_own", i).alias("_right")))
    dealt = _block(rows, key, blocks).select("*", F.inline(pair))

    def both(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f["_left"].iloc[0], f["_right"].iloc[0]
        one = f[f["_own"] == left].reset_index(drop=True)
        return run(one, one if left == right else f[f["_own"] == right].reset_index(drop=True), left == right)

    return dealt.groupBy("_left", "_right").applyInPandas(both, schema)


def against(queries: DataFrame, rows: DataFrame, key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, query_blocks: int, row_blocks: int) -> DataFrame:
    """run(queries, rows) for each pair of a block of queries and one of rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _block(queries, key, query_blocks).withColumnRenamed("_own", "_q").withColumn("_r", every(row_blocks))
    right = _block(rows, key, row_blocks).withColumnRenamed("_own", "_r").withColumn("_q", every(query_blocks))
    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInPandas(run, schema)


def best(scores: np.ndarray, tie: np.ndarray, k: int, places: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k largest finite scores of each row, rounded to `places`; ties go to the smaller `tie`.

    `least`, if given, holds for each row a rounded score that k others reach already: smaller ones are left out.
    """
    floor = np.full(len(scores), -np.inf) if least is None else least - 2 * 10.0**-places
    if scores.shape[1] > k and not np.isfinite(floor).all():
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 2 * 10.0**-places)
    row, column = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
    found = np.round(scores[row, column], places) + 0.0
    order = np.lexsort((tie[column], -found, row))
    row, column, found = row[order], column[order], found[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], column[kept], found[kept]


class Best:
    """The k best columns of each row, of scores that come in tiles; `tie` numbers the columns."""

    def __init__(self, rows: int, k: int, places: int) -> None:
        self.k, self.places = k, places
        self.score, self.tie = np.full((rows, k), -np.inf), np.full((rows, k), -1)

    def add(self, at: int, scores: np.ndarray, tie: np.ndarray) -> None:
        """Scores of the rows from `at` on."""
        i, j, found = best(scores, tie, self.k, self.places, self.score[at : at + len(scores), -1])
        rows = np.unique(i)
        row = np.concatenate([np.repeat(rows, self.k), i])
        score = np.concatenate([self.score[at + rows].ravel(), found])
        ties = np.concatenate([self.tie[at + rows].ravel(), tie[j]])
        order = np.lexsort((ties, -score, row))
        first = order[np.searchsorted(row[order], rows)[:, None] + np.arange(self.k)]
        self.score[at + rows], self.tie[at + rows] = score[first], ties[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tie, score)"""
        row, place = np.nonzero(np.isfinite(self.score))
        return row, self.tie[row, place], self.score[row, place]


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `nodes` links that join the same nodes as the links (a, b): as they are if few, else each node to its part's smallest."""
    if len(a) <= nodes:
        return a, b
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(nodes))
    return moved, label[moved]
