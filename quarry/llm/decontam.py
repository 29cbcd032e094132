"""Benchmark decontamination by pigeonhole edit matching (operator 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pieces

KEY = 8  # bytes of a piece that are looked up at once
MIX = np.uint64(0x9E3779B97F4A7C15)
MIN_BYTES = 24
RATE = 0.1
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4_000_000


def matchable(text: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one space."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def budget(size: int, rate: float = RATE) -> int:
    """Edits allowed in an item of `size` bytes: a share of it, and so few that every piece has KEY bytes."""
    return max(0, min(int(size * rate), size // KEY - 1))


def cut(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """errors + 1 pieces with their offsets; within that many edits one piece at least stays as it is."""
    ends = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def myers(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of item to any part of text, and where the first such part ends; (most + 1, -1) if it is over most.

    Myers' bit-parallel columns: bit i of up and down tells whether row i + 1 is one more or less than row i.
    """
    size = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance, best, end = full, 0, size, most + 1, -1
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right, left = right << 1, (left << 1) & full
        up = left | (full & ~(diagonal | right))
        down = right & diagonal & full
        if distance < best:
            best, end = distance, at + 1
    return best, end


class Pieces:
    """The pieces of a block of items, by their first bytes."""

    def __init__(self, items: list[tuple[list, bytes]], rate: float) -> None:
        self.items = items
        self.errors = [budget(len(text), rate) for _, text in items]
        rows = []
        for i, (_, text) in enumerate(items):
            rows += [(int.from_bytes(p[:KEY], "little"), int.from_bytes(p[-KEY:], "little"), i, at, len(p)) for at, p in cut(text, self.errors[i])]
        rows.sort()
        self.first = np.array([r[0] for r in rows], np.uint64)
        self.last = np.array([r[1] for r in rows], np.uint64)
        self.item, self.at, self.size = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.first * MIX) >> np.uint64(44)] = True
        grams = [np.unique(self._grams(np.frombuffer(t, np.uint8))) for _, t in items]
        self.grams = grams
        self.need = [len(t) - 3 - 4 * k for (_, t), k in zip(items, self.errors, strict=True)]

    @staticmethod
    def _grams(raw: np.ndarray) -> np.ndarray:
        w = raw.astype(np.uint32)
        return w[:-3] | w[1:-2] << 8 | w[2:-1] << 16 | w[3:] << 24

    def hits(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where a piece occurs: its place in raw, and the piece."""
        if len(raw) < KEY:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.ndarray(len(raw) - KEY + 1, "<u8", raw, strides=(1,)).copy()
        spots = np.flatnonzero(self.table[(keys * MIX) >> np.uint64(44)])
        a, b = np.searchsorted(self.first, keys[spots]), np.searchsorted(self.first, keys[spots], "right")
        count = b - a
        spots = np.repeat(spots, count)
        piece = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        tail = spots + self.size[piece] - KEY
        good = tail < len(keys)
        spots, piece, tail = spots[good], piece[good], tail[good]
        good = keys[tail] == self.last[piece]
        spots, piece = spots[good], piece[good]
        long = np.flatnonzero(self.size[piece] > 2 * KEY)  # of others the two ends are the whole
        if len(long):
            same = np.ones(len(spots), bool)
            for i in long:
                p = piece[i]
                text = self.items[self.item[p]][1]
                same[i] = raw[spots[i] : spots[i] + self.size[p]] == text[self.at[p] : self.at[p] + self.size[p]]
            spots, piece = spots[same], piece[same]
        return spots, piece

    def verify(self, item: int, text: bytes, starts: np.ndarray) -> tuple[int, int] | None:
        """(distance, end) of the best match of an item near any of the sorted starts, if it is within the errors."""
        size, most = len(self.items[item][1]), self.errors[item]
        best = None
        cuts = np.flatnonzero(np.diff(starts) > size + 2 * most) + 1
        for near in np.split(starts, cuts):
            low, high = max(0, int(near[0]) - most), min(len(text), int(near[-1]) + size + most)
            window = text[low:high]
            if self.need[item] > 0:  # each edit spoils four 4-grams at most
                grams = self._grams(np.frombuffer(window, np.uint8)) if len(window) > 3 else np.zeros(0, np.uint32)
                spots = np.searchsorted(self.grams[item], grams)
                spots[spots == len(self.grams[item])] = 0
                if np.count_nonzero(self.grams[item][spots] == grams) < self.need[item]:
                    continue
            distance, end = myers(self.items[item][1], window, most)
            if distance <= most and (best is None or distance < best[0]):
                best = distance, low + end
        return best


class Short:
    """Items too short for an edit, by size: they match whole, between word boundaries of the normalised text."""

    def __init__(self, items: list[tuple[list, bytes]]) -> None:
        self.ids = {text: ids for ids, text in items}
        self.by_size = {n: np.array(sorted(t for t in self.ids if len(t) == n), f"S{n}") for n in {len(t) for t in self.ids}}

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
        """(text, item, end) of each item's first place in a text."""
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        edge = (raw == 32) | (raw == 10)
        begins = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
        starts = np.flatnonzero(edge[:-1] & ~edge[1:]) + 1
        for n, known in self.by_size.items():
            at = starts[starts + n < len(raw)]
            at = at[edge[at + n]]
            if not len(at):
                continue
            words = np.lib.stride_tricks.sliding_window_view(raw, n)[at].view(f"S{n}").ravel()
            place = np.minimum(np.searchsorted(known, words), len(known) - 1)
            good = known[place] == words
            at, place = at[good], place[good]
            if not len(at):
                continue
            doc = np.searchsorted(begins, at, "right") - 1
            _, first = np.unique(np.stack([doc, place]), axis=1, return_index=True)
            for i in first:
                yield int(doc[i]), bytes(known[place[i]]), int(at[i] - begins[doc[i]] + n)


def short_matcher(items: list[tuple[list, bytes]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Short(items)
        for part in pieces(frames, "text", 2_000_000):
            doc_id = part["doc_id"]
            found = known.find(part["text"].tolist())
            rows = [(None if pd.isna(doc_id.iloc[d]) else int(doc_id.iloc[d]), i, 0, len(item), end) for d, item, end in found for i in known.ids[item]]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "item_bytes", "end_byte"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return match


def matcher(items: list[tuple[list, bytes]], rate: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pieces(items, rate)
        for part in pieces(frames, "text", 2_000_000):
            texts = part["text"].tolist()
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            spots, piece = known.hits(b"\n".join(texts) + b"\n")
            doc = np.searchsorted(ends, spots, "right")
            item, start = known.item[piece], spots - begins[doc] - known.at[piece]
            order = np.lexsort((start, item, doc))
            doc, item, start = doc[order], item[order], start[order]
            heads = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)]) if len(doc) else []
            rows = []
            for a, b in zip(heads, np.r_[heads[1:], len(doc)] if len(doc) else [], strict=True):
                if found := known.verify(int(item[a]), texts[doc[a]], np.unique(start[a:b])):
                    ids, text = items[item[a]]
                    doc_id = part["doc_id"].iloc[doc[a]]
                    rows += [(None if pd.isna(doc_id) else int(doc_id), i, found[0], len(text), found[1]) for i in ids]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "item_bytes", "end_byte"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return match


def blocks_of_items(benchmark: DataFrame, min_bytes: int) -> Iterator[tuple[bool, list[tuple[list, bytes]]]]:
    """Distinct normalised items with their ids, in blocks of bounded size: first those under min_bytes (True), then the others."""
    table = benchmark.select(F.col("item_id").cast("long").alias("item_id"), matchable(F.col("text")).alias("text")).filter("text <> ''")
    table = table.groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    for short in (True, False):
        block, size = [], 0
        for row in table.filter((F.octet_length("text") < min_bytes) == short).orderBy("text").toLocalIterator():
            raw = row["text"].encode()
            block.append((list(row["ids"]), raw))
            size += len(raw)
            if len(block) == BLOCK_ITEMS or size > BLOCK_BYTES:
                yield short, block
                block, size = [], 0
        if block:
            yield short, block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Documents that hold a benchmark item within an edit budget; one row per (doc_id, item_id) with its best match.

    Texts are compared as UTF-8 of `matchable` text. An item of n bytes may differ by budget(n) edits. It is cut into
    one more piece than that; where a document holds a piece as it is, the place is verified by Myers' distance.
    Items go out in blocks of at most BLOCK_ITEMS items, each against all rows in one pass; documents never shuffle.

    Returns doc_id, item_id, distance, item_bytes, end_byte (of the match in the normalised text). Null or empty text:
    no match. Items under min_bytes once normalised have no edits: they match whole, between spaces or ends of the
    normalised text, at their first place. Items that are null or without letters and digits are skipped. Null ids are
    kept. Repeated rows match each. Long texts are searched whole. Empty tables: no rows. Further columns aren't read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), matchable(F.col("text")).cast("binary").alias("text"))
    schema = "doc_id long, item_id long, distance long, item_bytes long, end_byte long"
    out = None
    for short, block in blocks_of_items(benchmark, min_bytes):
        found = slim.mapInPandas(short_matcher(block) if short else matcher(block, rate), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows that share a doc_id with one go too."""
    bad = materialize(contaminated(docs, benchmark, rate, min_bytes).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
