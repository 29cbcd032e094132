"""Near-duplicate classes by ProbMinHash over weighted word shingles (operator 2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, lean, materialize, pieces

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5  # a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**24 > 0.9999
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (lower case, between white space), and the number of words of each text."""
    column = pc.utf8_trim_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    lists = pc.utf8_split_whitespace(column)
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(flat.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64) + np.uint64(1)
    powers = np.multiply.accumulate(np.full(len(raw) + 1, BASE, np.uint64))
    inverses = np.multiply.accumulate(np.full(len(raw) + 1, INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(raw * powers[:-1])])
    ends = np.cumsum(size)
    begins = ends - size
    hashes = mix((sums[ends] - sums[begins]) * inverses[begins] ^ size.astype(np.uint64))
    full = size > 0
    if not full.all():
        doc = np.repeat(np.arange(len(count)), count)[full]
        hashes, count = hashes[full], np.bincount(doc, minlength=len(count))
    return hashes, count


def shingles(hashes: np.ndarray, count: np.ndarray, words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text and how often they occur; a text of fewer words is one shingle, one without words none."""
    out, at = [], 0
    for n in count.tolist():
        own = hashes[at : at + n]
        at += n
        if n == 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        width = min(n, words)
        made = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            made += own[j : n - width + 1 + j] * STEPS[j % len(STEPS)]
        out.append(np.unique(mix(made), return_counts=True))
    return out


def weight(counts: np.ndarray) -> np.ndarray:
    """Of a shingle: repeats count, but less each time, so that one repeated line doesn't outweigh a text."""
    return 1.0 + np.log(counts)


def prob_minhash(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, owners: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (owners x size) whose places agree with probability Jaccard of the weighted sets.

    Each element is a Poisson process of rate `weight`: its arrivals fall on random places, and the earliest arrival on a
    place signs it. An element ends as soon as it is later than all of its owner's places; the arrivals of all elements
    go on in step, so that each round is a few array operations.
    """
    earliest = np.full(owners * size, np.inf)
    signed = np.zeros(owners * size, np.uint64)
    latest = np.full(owners, np.inf)
    live, time, turn = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(live):
        turn += 1
        drawn = mix(elements[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        now = time[live] - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights[live]
        time[live] = now
        early = now < latest[owner[live]]
        live, now, drawn = live[early], now[early], drawn[early]
        place = owner[live] * size + (mix(drawn) % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, place, now)
        first = earliest[place] == now
        signed[place[first]] = elements[live[first]]
        touched = np.unique(owner[live])
        latest[touched] = earliest.reshape(owners, size)[touched].max(axis=1)
    return signed.reshape(owners, size)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two signatures' sets, estimated."""
    return float((a == b).mean())


def similarities(ids_a: np.ndarray, counts_a: np.ndarray, ids_b: np.ndarray, counts_b: np.ndarray) -> tuple[float, float]:
    """Jaccard of two sorted shingle sets, and probability Jaccard of their weights, both exact."""
    if not len(ids_a) or not len(ids_b):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(ids_a, ids_b), len(ids_a) - 1)
    both = ids_a[at] == ids_b
    common = int(both.sum())
    plain = common / (len(ids_a) + len(ids_b) - common)
    if common == 0 or (counts_a.max() == 1 and counts_b.max() == 1):
        return plain, plain
    # sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i), with all j in order of y_j / x_j
    x, y = weight(counts_a), weight(counts_b)
    paired = at[both]
    only_a, only_b = np.ones(len(x), bool), ~both
    only_a[paired] = False
    xs = np.concatenate([x[only_a], x[paired], np.zeros(only_b.sum())])
    ys = np.concatenate([np.zeros(only_a.sum()), y[both], y[only_b]])
    ratio = y[both] / x[paired]
    order = np.argsort(ratio, kind="stable")
    low = only_a.sum()
    xs[low : low + common], ys[low : low + common] = x[paired][order], y[both][order]
    ratio = ratio[order]
    up_to, after = np.cumsum(xs), ys[::-1].cumsum()[::-1]
    after = np.append(after, 0.0)
    last = low + np.searchsorted(ratio, ratio, "right")  # of all j whose ratio is no larger
    total = (up_to[last - 1] + after[last] / ratio) / x[paired][order]
    return plain, float((1.0 / total).sum())


def banded(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    table = np.zeros((len(signed), bands), np.uint64)
    for j in range(rows):
        table = mix(table * np.uint64(BASE) + signed.reshape(len(signed), bands, rows)[:, :, j])
    return mix(table + np.arange(bands, dtype=np.uint64) * STEPS[0]).astype(np.int64)


def signer(bands: int, rows: int, words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames, "text"):
            texts = part["text"].tolist()
            hashes, count = word_hashes(texts)
            sets = shingles(hashes, count, words)
            sizes = np.array([len(s[0]) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            ids, counts = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
            table = banded(prob_minhash(ids, owner, weight(counts), len(sets), bands * rows), bands, rows).tolist()
            table = [t if n else [] for t, n in zip(table, sizes, strict=True)]
            # where no shingle repeats both signatures are one; elsewhere the plain one's bands join the weighted one's
            uneven = np.zeros(len(sets), bool)
            uneven[owner[counts > 1]] = True
            if uneven.any():
                again = uneven[owner]
                plain = prob_minhash(ids[again], (np.cumsum(uneven) - 1)[owner[again]], np.ones(again.sum()), int(uneven.sum()), bands * rows)
                for i, more in zip(np.flatnonzero(uneven).tolist(), banded(plain, bands, rows).tolist(), strict=True):
                    table[i] = list({*table[i], *more})
            ends = np.cumsum(count)
            place = np.arange(len(hashes), dtype=np.uint64)
            first = np.add.accumulate(hashes * mix(place - np.repeat((ends - count).astype(np.uint64), count) + STEPS[1]))
            second = np.add.accumulate(mix(hashes ^ STEPS[2]) * mix(place - np.repeat((ends - count).astype(np.uint64), count) + STEPS[3]))
            prints = []
            for sums in (first, second):
                sums = np.concatenate([np.zeros(1, np.uint64), sums])
                prints.append(mix(sums[ends] - sums[ends - count] + count.astype(np.uint64)).astype(np.int64))
            yield pd.DataFrame({"doc_id": part["doc_id"], "print_1": prints[0], "print_2": prints[1], "bands": table})

    return sign


def setter(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames, "text"):
            rows = []
            for ids, counts in shingles(*word_hashes(part["text"].tolist()), words):
                rows.append((ids.astype("<u8").tobytes(), counts.astype("<u4").tobytes()))
            yield pd.DataFrame({"node": part["doc_id"], "ids": [r[0] for r in rows], "counts": [r[1] for r in rows]})

    return make


BLOCK = 256  # nodes of a bucket that are compared with as many others at once


def blocks_of(bucket: Column, node: Column, size: Column) -> Column:
    """(left, right) of the block pairs that a node takes part in: its own block with each block of the bucket."""
    count = F.ceil(size / F.lit(float(BLOCK))).cast("int")
    own = F.pmod(F.xxhash64(node), count).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.least(own, i).alias("left"), F.greatest(own, i).alias("right"), own.alias("own")))


def block_links(similarity: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between nodes of different classes in two blocks (or one) of a bucket; only links become rows.

    Shingles and weights that pairs have in common come from matrix products. Pairs that the distances to the bucket's
    smallest node exclude aren't looked at, and exact similarities are computed where bounds leave them open.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node").reset_index(drop=True)
        left, right = int(f["left"].iloc[0]), int(f["right"].iloc[0])
        rows, cols = np.flatnonzero(f["own"] == left), np.flatnonzero(f["own"] == right)
        label, node = f["class_id"].to_numpy(), f["node"].to_numpy()
        slack = 1 - similarity + 1e-6
        near = np.zeros((len(rows), len(cols)), bool)
        for kind in ("plain", "weighted"):
            d = f[kind].to_numpy()
            near |= np.abs(d[rows][:, None] - d[cols][None]) <= slack
        near &= label[rows][:, None] != label[cols][None]
        if left == right:
            near &= node[rows][:, None] < node[cols][None]
        if not near.any():
            return pd.DataFrame([], columns=["a", "b", "plain", "weighted"])
        ids = [np.frombuffer(x, "<u8") for x in f["ids"]]
        counts = [np.frombuffer(x, "<u4") for x in f["counts"]]
        sizes = np.array([len(x) for x in ids])
        every, place = np.unique(np.concatenate(ids), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        weights = [weight(c) for c in counts]
        common, mass_a, mass_b = (np.zeros((len(rows), len(cols)), np.float32) for _ in range(3))
        flat_weights = np.concatenate(weights)
        for low in range(0, len(every), 4096):  # the matrices stay small whatever the texts' lengths
            part = (place >= low) & (place < low + 4096)
            table = np.zeros((len(ids), min(4096, len(every) - low)), np.float32)
            table[owner[part], place[part] - low] = 1
            common += table[rows] @ table[cols].T
            heavy = np.zeros_like(table)
            heavy[owner[part], place[part] - low] = flat_weights[part]
            mass_a += heavy[rows] @ table[cols].T
            mass_b += table[rows] @ heavy[cols].T
        plain = common / np.maximum(sizes[rows][:, None] + sizes[cols][None] - common, 1)
        total = np.maximum(np.array([w.sum() for w in weights]), 1e-12)
        in_a, in_b = np.minimum(mass_a / total[rows][:, None], 1), np.minimum(mass_b / total[cols][None], 1)
        # probability Jaccard is at most this, by Jensen's inequality, for shares in_a and in_b of the weights in common
        at_most = in_a * in_b / np.maximum(1 - (1 - in_a) * (1 - in_b), 1e-12)
        open_ = near & ((plain >= similarity - 1e-4) | (at_most >= similarity - 1e-4))
        out = []
        for i, j in zip(*np.nonzero(open_), strict=True):
            x, y = rows[i], cols[j]
            found = similarities(ids[x], counts[x], ids[y], counts[y])
            if max(found) >= similarity:
                out.append((min(node[x], node[y]), max(node[x], node[y]), *found))
        return pd.DataFrame(out, columns=["a", "b", "plain", "weighted"])

    return run


def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [
            similarities(np.frombuffer(a, "<u8"), np.frombuffer(ca, "<u4"), np.frombuffer(b, "<u8"), np.frombuffer(cb, "<u4"))
            for a, ca, b, cb in zip(f["ids_a"], f["counts_a"], f["ids_b"], f["counts_b"], strict=True)
        ]
        yield pd.DataFrame({"a": f["a"], "b": f["b"], "plain": [x[0] for x in found], "weighted": [x[1] for x in found]})


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact similarities: a, b, plain, weighted."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("ids").alias(f"ids_{n}"), F.col("counts").alias(f"counts_{n}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(compare, "a long, b long, plain double, weighted double")


def components(edges: DataFrame) -> DataFrame:
    """node, class_id: the smallest node that edges (a, b) lead to. Labels and edges stay distributed; each round is written."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class_id").alias("near"))
        low = labels.join(near, "node").select("node", F.col("class_id").alias("old"), F.least("class_id", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("class_id").alias("further"))
        new = materialize(low.join(jump, "low", "left").select("node", "old", F.least("low", F.coalesce("further", "low")).alias("class_id")), "labels")
        discard(labels)
        changed = new.filter("old <> class_id").limit(1).count()
        labels = new
        if not changed:
            discard(both)
            out = labels.select("node", "class_id")
            out._quarry_path = labels._quarry_path
            return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id: classes of documents connected by links; the id of a class is its smallest doc_id.

    Two texts are linked if the Jaccard of their word shingles, or the probability Jaccard of these weighted by
    1 + ln(count), is `similarity` or more. Texts with the same words are one node. Nodes that share a band of the
    weighted or of the plain signature are candidates, so each kind of link has its own bands, and every class decision
    rests on exact similarities (of 64-bit shingle hashes):

    1. each bucket's smallest node against the others (a star),
    2. nodes that it didn't take in against three more nodes that it did,
    3. what is still apart in a bucket, in blocks of BLOCK nodes against BLOCK, but for pairs in one class already and
       pairs that the triangle inequality of both distances to the bucket's smallest node excludes. Only links found
       become rows.

    So a group of near copies costs a few pairs for each member, and no link between classes is lost.

    Texts without words link to each other only if they are equal after trimming (as all null or blank texts). Rows
    with null id get a null class and take no part; rows that share an id share a class. Long texts are read whole.
    Empty input: no rows. Further columns aren't read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = slim.filter(F.col("doc_id").isNotNull())
    signed = materialize(known.mapInPandas(signer(bands, rows, words), "doc_id long, print_1 long, print_2 long, bands array<bigint>"), "signatures")
    prints = ["print_1", "print_2"]
    nodes = materialize(signed.groupBy(*prints).agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")
    listed = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = listed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("_top")).filter("pivot < _top").drop("_top")
    members = materialize(listed.join(buckets, "bucket"), "buckets")

    star = materialize(members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "star")
    wanted = materialize(star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    sets = materialize(known.join(wanted, "doc_id", "left_semi").mapInPandas(setter(words), "node long, ids binary, counts binary"), "sets")
    linked = (F.col("plain") >= similarity) | (F.col("weighted") >= similarity)
    first = materialize(verify(star, sets), "verified")
    labels = components(first.filter(linked))

    def labelled(found: DataFrame) -> DataFrame:
        own = found.withColumnRenamed("class_id", "_class")
        out = members.join(own.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        return out.select("bucket", "node", "pivot", F.coalesce("_class", "node").alias("class_id"))

    placed = materialize(labelled(labels), "placed")
    home = placed.filter("node = pivot").select("bucket", F.col("class_id").alias("home"))
    mine = placed.join(home, "bucket")
    salted = lambda n: F.min(F.struct(F.xxhash64("node", F.lit(n)), "node"))["node"]
    taken = mine.filter("class_id = home").groupBy("bucket").agg(F.array(F.max("node"), salted(1), salted(2)).alias("others"))
    second_pairs = mine.filter("class_id <> home").join(taken, "bucket").select("node", "pivot", F.explode("others").alias("other")).filter("other <> pivot")
    second_pairs = second_pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    second = materialize(verify(second_pairs, sets), "verified")
    edges = first.filter(linked).unionByName(second.filter(linked))
    labels_2 = components(edges)

    discard(placed)
    placed = labelled(labels_2)
    apart = placed.groupBy("bucket").agg(F.min("class_id").alias("_low"), F.max("class_id").alias("_high")).filter("_low < _high").select("bucket")
    far = placed.join(apart, "bucket", "left_semi").join(first.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "plain", "weighted"), ["pivot", "node"], "left")
    far = materialize(far.select("bucket", "node", "class_id", F.coalesce(1 - F.col("plain"), F.lit(0.0)).alias("plain"), F.coalesce(1 - F.col("weighted"), F.lit(0.0)).alias("weighted")), "apart")
    sized = far.join(far.groupBy("bucket").agg(F.count("*").alias("size")), "bucket")
    dealt = sized.select("*", F.inline(blocks_of(F.col("bucket"), F.col("node"), F.col("size")))).drop("size")
    grouped = dealt.join(sets, "node").groupBy("bucket", "left", "right")
    third = materialize(grouped.applyInPandas(lean(block_links(similarity)), "a long, b long, plain double, weighted double").select("a", "b").distinct(), "verified")
    if not third.isEmpty():
        discard(labels_2)
        labels_2 = components(edges.select("a", "b").unionByName(third))
    discard(members, star, wanted, sets, first, labels, second, far, third)

    of_node = labels_2.withColumnRenamed("class_id", "_class")
    owned = signed.select("doc_id", *prints).join(nodes.select(*prints, "node"), prints).join(of_node, "node", "left")
    classed = owned.select("doc_id", F.coalesce("_class", "node").alias("class_id"))
    return classed.unionByName(slim.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, its first; documents without an id stay."""
    classed = near_duplicates(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.filter(F.col("doc_id").isNull()).unionByName(docs.join(classed, docs["doc_id"] == classed["_keep"], "left_semi"))
