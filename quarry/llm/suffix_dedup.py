"""Removal of repeated passages by suffix arrays (operator 7).

Every 50-byte string goes to the shard of its minimizer, the least hash of its 16-byte grams, so equal strings meet.
Minimizers go first, as 32-bit hashes; neighbouring strings whose minimizer occurs in several documents then follow as
one fragment. A group of documents first drops fragments that it has seen in a smaller document, so a passage that many
documents share leaves each group once. A shard sorts the suffixes of its fragments (Larsson-Sadakane doubling), takes
common prefixes of neighbours (Kasai), and merges with the next shards of the same minimizer by binary search. Fragments
of a minimizer that fills more than one suffix array are cut again by further minimizers, so that few have to be merged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, utf8
from quarry.llm.near_dup import STEPS, mix
from quarry.llm.tokenize import spread

DEPTH, GRAM = 50, 16
SLOT = 21  # bits of a position within a suffix array
SHARD = 1 << 18  # bytes of a suffix array: its ranks stay in the processor's cache
PIECE = 1 << 19  # bytes whose minimizers are computed at once
LEVELS = 4  # further minimizers at most, one for each further step of STEPS
NONE = np.iinfo(np.int64).max
COMPRESSOR, DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, little end first; raw ends 7 bytes later."""
    return np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)).copy()


def larsson_sadakane(raw: np.ndarray, wanted: np.ndarray | None = None, depth: int = DEPTH) -> np.ndarray:
    """The wanted suffixes of raw (uint8, at most 2**SLOT - 2 of them) in the order of their first `depth` bytes or more.

    Ranks double the length they look at in each round, and only groups of equal rank are sorted again: a rank, the rank
    `done` bytes further and the place are packed into one 64-bit number. Suffixes that aren't wanted serve as the
    further ranks of wanted ones. From depth / 3 bytes on these are known as far as they are asked for, so only wanted
    suffixes go on; their ranks stay within the slots of their group, so they compare with the others as before.
    """
    n = len(raw)
    wide = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(5):
        key = key << np.uint64(8) | wide[j : n + j]
    mask, shift = np.uint64((1 << SLOT) - 1), np.uint64(SLOT)
    packed = np.sort(key << shift | np.arange(n, dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    rank = np.zeros(n + 2 * depth, np.int64)  # 0 beyond the end, slots count from 1
    slots, lift = np.arange(n), np.ones(n, np.int64)
    done, whole = 5, wanted is not None
    while True:
        same = packed >> shift
        heads, size = runs_of(same)
        rank[order[slots]] = np.repeat(slots[heads] + lift[slots[heads]], size)
        slots = slots[np.repeat(size > 1, size)]
        if whole and (3 * done >= depth or not len(slots)):
            whole, order = False, order[wanted[order]]
            level = rank[order]
            heads, size = runs_of(level)
            lift = np.repeat(level[heads] - heads, size)
            slots = np.flatnonzero(np.repeat(size > 1, size))
        if done >= depth or not len(slots):
            return order
        place = order[slots]
        packed = np.sort(rank[place].astype(np.uint64) << np.uint64(2 * SLOT) | rank[place + done].astype(np.uint64) << shift | place.astype(np.uint64))
        order[slots] = (packed & mask).astype(np.int64)
        done *= 2


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return heads, np.diff(heads, append=len(values))


def kasai(raw: np.ndarray, order: np.ndarray, wanted: np.ndarray, depth: int = DEPTH, stride: int = 32) -> np.ndarray:
    """Common prefix, up to depth, of each suffix in order (the wanted ones) with the one before it (0 for the first).

    The text is read in many lanes at once. Within a lane the prefix of the next place is at most one byte shorter than
    that of this place, so it is only extended.
    """
    n = len(raw)
    word = words(np.concatenate([raw, np.zeros(depth + 16, np.uint8)]))
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    follows = np.append(wanted[1:], False)
    common = np.zeros(n, np.int64)
    lanes = np.arange(0, n, stride)
    height = np.zeros(len(lanes), np.int64)
    for t in range(stride):
        here = lanes[: np.searchsorted(lanes, n - t)] + t
        height, other = height[: len(here)], before[here]
        live = np.flatnonzero(other >= 0)
        while len(live):
            differ = word[here[live] + height[live]] ^ word[other[live] + height[live]]
            whole = differ == 0
            part = differ[~whole]
            height[live[whole]] += 8
            height[live[~whole]] += (part.view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            live = live[whole]
            live = live[height[live] < depth]
        common[here] = np.minimum(height, depth)
        # suffixes that agree to depth may be in any order, and then, or if the other one's next isn't in order, say nothing
        height = np.where((height < depth) & (other >= 0) & follows[other], np.maximum(height - 1, 0), 0)
        height[~follows[here]] = 0
    return common[order]


class Shard:
    """A suffix array over fragments; starts and sizes place them in raw, docs names their documents."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> None:
        self.ends = np.cumsum(sizes)
        opens = np.zeros(len(raw), bool)
        opens[spread(self.ends - sizes, sizes - DEPTH + 1)] = True  # places with a whole string after them
        self.place = larsson_sadakane(raw, opens)
        heads, self.size = runs_of(np.cumsum(kasai(raw, self.place, opens) < DEPTH))
        self.doc = docs[np.searchsorted(self.ends, self.place, "right")]
        self.least = np.minimum.reduceat(self.doc, heads) if len(heads) else np.zeros(0, np.int64)
        self.own = self.least.copy()
        self.raw, self.heads = raw, heads

    def strings(self) -> np.ndarray:
        """Its distinct strings, in order."""
        return self.raw[self.place[self.heads][:, None] + np.arange(DEPTH)].view(f"S{DEPTH}").ravel()

    def merge(self, other: Shard) -> None:
        """Take over smaller documents of the same strings in another shard."""
        mine, theirs = self.strings(), other.strings()
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        self.least = np.where(theirs[at] == mine, np.minimum(self.least, other.own[at]), self.least)

    def repeated(self) -> np.ndarray:
        """Places of strings that start in a smaller document."""
        return np.sort(self.place[self.doc > np.repeat(self.least, self.size)])


def packed(*columns: np.ndarray) -> bytes:
    head = np.array([len(c) * c.itemsize for c in columns], "<u8").tobytes()
    return COMPRESSOR.compress(head + b"".join(c.tobytes() for c in columns))


def unpacked(payload: bytes, *types: str) -> list[np.ndarray]:
    raw = DECOMPRESSOR.decompress(payload)
    at, out = 8 * len(types), []
    for size, kind in zip(np.frombuffer(raw, "<u8", len(types)), types, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def minimizer_runs(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of raw (ends 64 bytes after the last one) as runs of strings that share a minimizer: start, size, part, and the minimizer's hash.

    Each level has another order of the grams.
    """
    word = words(raw)
    least = mix(word[:-8] * STEPS[0] ^ mix(word[8:] + STEPS[1]))
    del word
    if level:
        least = mix(least + STEPS[level])
    span, grams = 1, DEPTH - GRAM + 1
    while span < grams:
        step = min(span, grams - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    opens = spread(begins, np.maximum(sizes - DEPTH + 1, 0))
    least = least[opens]
    heads = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (opens[1:] != opens[:-1] + 1)]) if len(opens) else np.zeros(0, np.int64)
    start = opens[heads]
    return start, np.diff(heads, append=len(opens)) + DEPTH - 1, np.searchsorted(begins + sizes, start, "right"), least[heads]


def by_bytes(sizes: np.ndarray, most: int) -> list[slice]:
    """Neighbours in slices of about `most` bytes, one of them at least."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True) if b > a]


FRAGMENTS, SPANS = ("<u4", "<i8", "<i4", "<i4", "u1"), ("<i8", "<u4", "<u4")


class Runs:
    """The documents of one owner group, in ascending order of id, as runs of strings that share a minimizer."""

    def __init__(self, docs: list[bytes], ids: np.ndarray, shards: int) -> None:
        sizes = np.array([len(d) for d in docs], np.int64)
        self.raw = raw = np.frombuffer(b"".join(docs) + bytes(64), np.uint8)
        self.ids, self.begins = ids, np.cumsum(sizes) - sizes
        found = []
        for part in by_bytes(sizes, PIECE):
            base = self.begins[part][0]
            start, size, owner, least = minimizer_runs(raw[base : base + sizes[part].sum() + 64], self.begins[part] - base, sizes[part])
            found.append((start + base, size, owner + part.start, least))
        if not found:
            found = [minimizer_runs(raw, self.begins, sizes)]
        self.start, self.size, self.owner, least = (np.concatenate(c) for c in zip(*found, strict=True))
        # a minimizer is known by its shard and 32 bits; two that share these only cost work
        hashed = mix(least + STEPS[2])
        self.key = (hashed % np.uint64(shards)) << np.uint64(32) | hashed >> np.uint64(32)
        self.keys, self.of_run = np.unique(self.key, return_inverse=True)
        self.shard = (self.keys >> np.uint64(32)).astype(np.int64)
        self.cuts = np.flatnonzero(np.diff(self.shard)) + 1

    def several(self) -> np.ndarray:
        """For each of keys: whether it occurs in more than one document here."""
        low, high = np.full(len(self.keys), NONE), np.full(len(self.keys), -NONE)
        doc = self.ids[self.owner]
        np.minimum.at(low, self.of_run, doc)
        np.maximum.at(high, self.of_run, doc)
        return low != high

    def first(self, chosen: np.ndarray) -> np.ndarray:
        """For each of the chosen runs: its first equal among them, which has the smallest id."""
        return first_equal(self.raw, self.start[chosen], self.size[chosen])


def first_equal(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each part of raw: the first that holds the same bytes."""
    flat, seen = raw.tobytes(), {}
    return np.fromiter((seen.setdefault(flat[a:b], i) for i, (a, b) in enumerate(zip(start.tolist(), (start + size).tolist(), strict=True))), np.int64, len(start))


def group_runs(frame: pd.DataFrame, shards: int) -> Runs:
    frame = frame[frame["doc_id"].notna()].sort_values("doc_id", kind="stable")
    return Runs(frame["text"].tolist(), frame["doc_id"].to_numpy(np.int64), shards)


def lister(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Minimizers of an owner group for each shard, as sorted differences, and which occur in several of its documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs, owner = group_runs(frame, shards), int(frame["owner"].iloc[0])
        several, rows = runs.several(), []
        for at in np.split(np.arange(len(runs.keys)), runs.cuts) if len(runs.keys) else []:
            low = (runs.keys[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            rows.append((int(runs.shard[at[0]]), owner, packed(np.diff(low, prepend=0).astype("<u4"), np.packbits(several[at]))))
        return pd.DataFrame(rows, columns=["shard", "owner", "payload"])

    return run


def find_shared(frame: pd.DataFrame) -> pd.DataFrame:
    """For each owner's minimizers of a shard, in order: whether they occur in several documents of all."""
    lists, several = [], []
    for payload in frame["payload"]:
        steps, bits = unpacked(payload, "<u4", "u1")
        lists.append(np.cumsum(steps.astype(np.int64)))
        several.append(np.unpackbits(bits)[: len(steps)].astype(bool))
    every = np.concatenate(lists)
    keys, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = (count > 1) | (np.bincount(inverse, np.concatenate(several), len(keys)) > 0)
    ends = np.cumsum([len(x) for x in lists])
    found = np.split(shared[inverse], ends[:-1])
    return pd.DataFrame({"owner": frame["owner"], "shard": frame["shard"], "bits": [packed(np.packbits(x)) for x in found]})


def sender(shards: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Fragments of an owner group that hold shared minimizers, by shard (kind 0), and spans that are plain here (kind 1)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "owner", "kind", "payload"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        runs, owner = group_runs(left, shards), int(left["owner"].iloc[0])
        bits = dict(zip(right["shard"], right["bits"], strict=True))
        shared = np.zeros(len(runs.keys), bool)
        for at in np.split(np.arange(len(runs.keys)), runs.cuts):
            shared[at] = np.unpackbits(unpacked(bits[int(runs.shard[at[0]])], "u1")[0])[: len(at)]
        chosen = np.flatnonzero(shared[runs.of_run])
        first = runs.first(chosen)
        doc = runs.ids[runs.owner[chosen]]
        again = doc > doc[first]
        local, size = runs.start[chosen] - runs.begins[runs.owner[chosen]], runs.size[chosen]
        rows = []
        if again.any():
            rows.append((owner % shards, owner, 1, packed(doc[again].astype("<i8"), local[again].astype("<u4"), size[again].astype("<u4"))))
        sent = np.flatnonzero(~again)
        key = runs.key[chosen[sent]]
        order = np.argsort(key >> np.uint64(32), kind="stable")
        sent, key = sent[order], key[order]
        shard = (key >> np.uint64(32)).astype(np.int64)
        for at in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(shard)) + 1):
            if len(at):
                s = sent[at]
                payload = packed(key[at].astype("<u4"), np.diff(doc[s], prepend=0).astype("<i8"), np.diff(local[s], prepend=0).astype("<i4"), size[s].astype("<i4"), runs.raw[spread(runs.start[chosen[s]], size[s])])
                rows.append((int(shard[at[0]]), owner, 0, payload))
        return pd.DataFrame(rows, columns=columns)

    return run


def again_by_minimizer(raw: np.ndarray, begin: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, owner: np.ndarray, key: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Fragments cut by a further minimizer, with keys by the former and this one; two that share a key only cost work."""
    found = []
    for part in by_bytes(size, PIECE):
        ends = np.cumsum(size[part])
        text = np.concatenate([raw[spread(begin[part], size[part])], np.zeros(64, np.uint8)])
        at, length, of, least = minimizer_runs(text, ends - size[part], size[part], level)
        offset, of = at - (ends - size[part])[of], of + part.start
        found.append((begin[of] + offset, start[of] + offset, length, doc[of], owner[of], mix(least + mix(key[of] + STEPS[2]))))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def repeats(payloads: list[bytes], owners: list[int]) -> list[np.ndarray]:
    """Spans (document, start, length, owner) of strings that start in a smaller document, among the fragments of a shard."""
    tables = []
    for payload, owner in zip(payloads, owners, strict=True):
        minimizer, doc, start, size, raw = unpacked(payload, *FRAGMENTS)
        tables.append((minimizer, np.cumsum(doc), np.cumsum(start.astype(np.int64)), size.astype(np.int64), raw, np.full(len(doc), owner)))
    minimizer, doc, start, size, raw, owner = (np.concatenate(c) for c in zip(*tables, strict=True))
    begin = np.cumsum(size) - size
    out: list[list[np.ndarray]] = []
    parts, key = [], minimizer.astype(np.uint64)
    for level in range(1, LEVELS + 2):
        order = np.lexsort((doc, key))
        heads, count = runs_of(key[order])
        shared = doc[order[heads]] != doc[order[heads + count - 1]]
        chosen = order[np.repeat(shared, count)]
        # of equal fragments the one of the smallest document stands for all in the arrays; those of larger ones are repeats
        first = first_equal(raw, begin[chosen], size[chosen])
        again = doc[chosen] > doc[chosen][first]
        gone, chosen = chosen[again], chosen[~again]
        out.append([doc[gone], start[gone], size[gone], owner[gone]])
        heads, count = runs_of(key[chosen])
        large = np.repeat(np.add.reduceat(size[chosen], heads) > SHARD, count) if len(heads) else np.zeros(0, bool)
        if level > LEVELS:
            large[:] = False
        rest = chosen[~large]
        parts.append((key[rest], doc[rest], start[rest].astype(np.int64), size[rest], begin[rest], owner[rest], np.full(len(rest), level)))
        if not large.any():
            break
        begin, start, size, doc, owner, key = again_by_minimizer(raw, *(c[chosen[large]] for c in (begin, start, size, doc, owner, key)), level)
    key, doc, start, size, begin, owner, level = (np.concatenate(c) for c in zip(*parts, strict=True))
    minimizer = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (level[1:] != level[:-1])]) if len(key) else np.zeros(0, np.int64)
    chosen = np.arange(len(size))
    # fragments longer than a suffix array are cut so that the parts overlap in all but one byte of a string
    long = size[chosen] > SHARD // 2
    if long.any():
        step = SHARD // 2 - DEPTH + 1
        parts = np.where(long, -(-(size[chosen] - DEPTH + 1) // step), 1)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        chosen = np.repeat(chosen, parts)
        begin_c, start_c = begin[chosen] + nth * step, start[chosen] + nth * step
        size_c = np.minimum(size[chosen] - nth * step, np.where(np.repeat(long, parts), SHARD // 2, size[chosen]))
    else:
        begin_c, start_c, size_c = begin[chosen], start[chosen].astype(np.int64), size[chosen]
    minimizer, doc, owner = minimizer[chosen], doc[chosen], owner[chosen]
    heads, count = runs_of(minimizer)
    whole = np.zeros(len(size_c), np.int64)
    whole[heads] = np.add.reduceat(size_c, heads) if len(heads) else 0
    bounds, total = [0], 0
    for i, (n, group) in enumerate(zip(size_c.tolist(), whole.tolist(), strict=True)):
        if total + max(n, group) > SHARD and total:  # an array opens with a minimizer, if all its fragments don't fit
            bounds.append(i)
            total = 0
        total += n
    bounds.append(len(size_c))
    waiting: list[tuple[Shard, slice]] = []

    def finish() -> None:
        for a, _ in waiting:
            for b, _ in waiting:
                if a is not b:
                    a.merge(b)
        for one, rows in waiting:
            place = one.repeated()
            if not len(place):
                continue
            fragment = np.searchsorted(one.ends, place, "right")
            first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (fragment[1:] != fragment[:-1])])
            length = np.diff(first, append=len(place)) + DEPTH - 1
            fragment, offset = fragment[first], place[first]
            offset = offset - (one.ends - size_c[rows])[fragment]
            out.append([doc[rows][fragment], start_c[rows][fragment] + offset, length, owner[rows][fragment]])
        waiting.clear()

    for a, b in zip(bounds, bounds[1:], strict=False):
        if a == b:
            continue
        rows = slice(a, b)
        if waiting and minimizer[a] != minimizer[a - 1]:  # nothing in common with the shards before
            finish()
        waiting.append((Shard(raw[spread(begin_c[rows], size_c[rows])], size_c[rows], doc[rows]), rows))
    finish()
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def search(frame: pd.DataFrame) -> pd.DataFrame:
    """Spans of a shard, by the owner group of their documents."""
    fragments = frame["kind"] == 0
    rows = [(int(o), p) for o, p in zip(frame["owner"][~fragments], frame["payload"][~fragments], strict=True)]
    if fragments.any():
        doc, start, size, owner = repeats(frame["payload"][fragments].tolist(), frame["owner"][fragments].tolist())
        order = np.argsort(owner, kind="stable")
        for chosen in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            if len(chosen):
                rows.append((int(owner[chosen[0]]), packed(doc[chosen].astype("<i8"), start[chosen].astype("<u4"), size[chosen].astype("<u4"))))
    return pd.DataFrame(rows, columns=["owner", "payload"])


def joined_spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that spans cover; spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), (start[order].astype(np.int64) + size[order])
    reach = np.maximum.accumulate(end)
    head = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[head], reach[np.r_[head[1:] - 1, len(reach) - 1]]


def remover(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Documents of one owner shard and the spans for them."""
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(right):
        doc, start, size = (np.concatenate(c) for c in zip(*(unpacked(p, *SPANS) for p in right["payload"]), strict=True))
        order = np.argsort(doc, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(doc[order]) != 0]) if len(doc) else []
        for a, b in zip(heads, np.r_[heads[1:], len(doc)] if len(doc) else [], strict=True):
            spans[int(doc[order[a]])] = joined_spans(start[order[a:b]], size[order[a:b]])
    rows = []
    for doc_id, raw in zip(left["doc_id"], left["text"], strict=True):
        doc_id = None if pd.isna(doc_id) else int(doc_id)
        starts, ends = spans.get(doc_id, ((), ()))
        kept, at = [], 0
        for a, b in zip(starts, ends, strict=True):
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        rest = b"".join(kept)
        rows.append((doc_id, len(raw), len(raw) - len(rest), len(starts), hashlib.sha256(rest).hexdigest(), rest))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})


def shards_for(total: int, bytes_per_shard: int) -> int:
    """Shards of bytes_per_shard, up to 250; then their bytes grow like the root of the input, to 4 times as many."""
    return int(total / (bytes_per_shard * min(4.0, max(1.0, math.sqrt(total / (250 * bytes_per_shard))))))


def remove_repeats(docs: DataFrame, with_text: bool = False, bytes_per_shard: int = 4_000_000, least_shards: int = 64) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes; strings never cross documents and are judged on the input. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, and `kept`, the remaining bytes, if with_text is set.

    The number of shards follows the bytes of the input, so a task's memory doesn't. Each owner group sends each shard a
    row, so beyond 250 shards these get up to 4 times as many bytes. Null text: empty. Rows with null
    id stay whole and never count as the smaller document. Rows that share an id are one document: neither is smaller,
    and what is removed from one is removed at the same place of the other. Texts under 50 bytes stay. Empty input:
    no rows. Further columns aren't read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(least_shards, shards_for(int(total), bytes_per_shard))
    # the same exchange of the texts by owner group serves all three steps that need them
    owned = slim.withColumn("owner", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("owner")
    listed = owned.applyInPandas(lean(lister(shards)), "shard long, owner long, payload binary")
    shared = listed.groupBy("shard").applyInPandas(lean(find_shared), "owner long, shard long, bits binary")
    sent = owned.cogroup(shared.groupBy("owner")).applyInPandas(lean(sender(shards)), "shard long, owner long, kind int, payload binary")
    spans = sent.groupBy("shard").applyInPandas(lean(search), "owner long, payload binary")
    return owned.cogroup(spans.groupBy("owner")).applyInPandas(
        lean(remover_of(with_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    )


def remover_of(with_text: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = remover(left, right)
        return out if with_text else out.drop(columns="kept")

    return run
