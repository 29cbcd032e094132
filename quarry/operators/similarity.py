"""Set and text similarity: shingles, Jaccard, MinHash with banding, SimHash, TF-IDF."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import portable_hash
from quarry.functions.text import squeeze
from quarry.operators.graphs import connected_components, cut

PRIME = (1 << 31) - 1


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row: within a lambda its expression would be evaluated for each element."""
    return F.transform(F.array(value), use)[0]


def char_shingles(text: Column, k: int) -> Column:
    """Distinct k-character substrings of the squeezed text; a shorter text is one shingle."""
    return bound(squeeze(text), lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - k + 1)), lambda i: t.substr(i, F.lit(k)))))


def word_shingles(text: Column, k: int) -> Column:
    """Distinct runs of k words of the lower-case text; a shorter text is one shingle."""
    words = F.split(F.lower(squeeze(text)), " ")
    return bound(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - k + 1)), lambda i: F.array_join(F.slice(w, i, k), " "))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def overlap_pairs(sets: DataFrame, key: str, element: str) -> DataFrame:
    """a, b (a < b), common, jaccard of all pairs that share an element, through the inverted index. sets: key and element, distinct."""
    sized = sets.groupBy(key).agg(F.count("*").alias("_n"))
    left, right = sets.select(F.col(key).alias("a"), element), sets.select(F.col(key).alias("b"), element)
    common = left.join(right, element).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    size = lambda n: sized.select(F.col(key).alias(n), F.col("_n").alias(f"_{n}"))
    return common.join(size("a"), "a").join(size("b"), "b").select("a", "b", "common", (F.col("common") / (F.col("_a") + F.col("_b") - F.col("common"))).alias("jaccard"))


def minhash_numbers(n: int) -> list[tuple[int, int]]:
    """(a, b) of the linear hashes a x + b mod PRIME, from a fixed sequence."""
    return [((i * 2654435761 + 1) % PRIME, (i * 40503 + 12345) % PRIME) for i in range(1, n + 1)]


def minhash(shingles: Column, n: int, first: int = 0) -> Column:
    """Array of n minima; PRIME for an empty set. Each shingle is hashed once, the linear hashes fold over that array."""
    base = F.transform(shingles, lambda s: portable_hash(s, 9) % PRIME)
    numbers = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in minhash_numbers(first + n)[first:]])
    return bound(base, lambda hs: F.transform(numbers, lambda p: F.coalesce(F.array_min(F.transform(hs, lambda h: (p["a"] * h + p["b"]) % PRIME)), F.lit(PRIME).cast("long"))))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def bands(signature: Column, count: int, rows: int) -> Column:
    """(band, bucket) of each band of a signature."""
    bucket = lambda s, i: F.md5(F.array_join(F.transform(F.slice(s, i * rows + 1, rows), lambda x: x.cast("string")), ","))
    return bound(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.alias("band"), bucket(s, i).alias("bucket"))))


def word_sets(text: str, k: int) -> set[str]:
    """word_shingles of one text that is lower case and squeezed already."""
    words = text.split(" ")
    return set(map(" ".join, zip(*(words[i:] for i in range(k)), strict=False))) or {text}


def digests(shingles: set[str], seed: str) -> np.ndarray:
    """The first 8 bytes of the MD5 of `shingle#seed`, of which portable_hash is the upper 60 bits."""
    made = b"".join(hashlib.md5((s + seed).encode()).digest()[:8] for s in shingles)
    return np.frombuffer(made, ">u8")


def word_minhash(text: Column, k: int, n: int) -> Column:
    """minhash(word_shingles(text, k), n) in Arrow batches: the hashes of a text are an array, not an expression for each shingle."""
    numbers = np.array(minhash_numbers(n), np.int64)
    by, plus = numbers[:, :1], numbers[:, 1:]

    @F.pandas_udf("array<long>")
    def sign(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            least = np.full(n, PRIME)
            if t is not None:
                base = (digests(word_sets(t, k), "#9") >> np.uint64(4)).astype(np.int64) % PRIME
                for at in range(0, len(base), 1 << 16):  # so that a long text's table stays small
                    least = np.minimum(least, ((by * base[at : at + (1 << 16)] + plus) % PRIME).min(axis=1))
            out.append(least)
        return pd.Series(out)

    return sign(F.lower(squeeze(text)))


COPIES, SETS = 512, 128  # copies of a text in one array, and sets that are compared with as many at once


def classed(signed: DataFrame, key: str, same: str) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in `same` as one: rep (the smallest key), copies and signature; and rep, part, keys (arrays of its rows' keys)."""
    held = cut(signed)
    reps = cut(held.groupBy(same).agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.any_value("signature").alias("signature")))
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("copies") / COPIES))
    members = held.join(reps.select(same, "rep", "copies"), same).groupBy("rep", part.alias("part")).agg(F.collect_list(key).alias("keys"))
    return reps.select("rep", "copies", "signature"), members


def rep_pairs(reps: DataFrame, count: int, rows: int) -> DataFrame:
    """a, b (a < b): representatives that share a bucket in some band."""
    exploded = cut(reps.select("rep", F.inline(bands(F.col("signature"), count, rows))))
    full = exploded.groupBy("band", "bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("band", "bucket")
    kept = exploded.join(full, ["band", "bucket"], "left_semi")
    return kept.withColumnRenamed("rep", "a").join(kept.withColumnRenamed("rep", "b"), ["band", "bucket"]).filter("a < b").select("a", "b").distinct()


def copied(pairs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """pairs (a, b of representatives, a = b for a text with itself, and further columns) as pairs a < b of all their rows.

    Arrays of at most some COPIES keys meet, so that the pairs of a large group of copies leave from many tasks.
    """
    parts = reps.select("rep", F.ceil(F.col("copies") / COPIES).alias("n"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = pairs.join(parts.select(F.col("rep").alias("a"), F.col("n").alias("_na")), "a").join(parts.select(F.col("rep").alias("b"), F.col("n").alias("_nb")), "b")
    placed = placed.withColumn("_pa", every("_na")).withColumn("_pb", every("_nb")).filter("a <> b or _pa <= _pb")
    side = lambda x: members.select(F.col("rep").alias(x), F.col("part").alias(f"_p{x}"), F.col("keys").alias(f"_k{x}"))
    met = placed.join(side("a"), ["a", "_pa"]).join(side("b"), ["b", "_pb"])
    out = met.withColumn("_x", F.explode("_ka")).drop("_ka").withColumn("_y", F.explode("_kb")).filter("a <> b or _pa < _pb or _x < _y")
    more = [c for c in pairs.columns if c not in ("a", "b")]
    return out.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), *more)


def lsh_candidates(signed: DataFrame, key: str, signature: str, count: int, rows: int) -> DataFrame:
    """a, b (a < b): pairs of the unique keys that share a bucket in some band. Equal signatures are paired once and copied."""
    reps, members = classed(signed.select(key, F.col(signature).alias("signature"), F.col(signature).alias("_same")), key, "_same")
    return copied(rep_pairs(reps, count, rows).unionByName(with_itself(reps)), reps, members)


def with_itself(reps: DataFrame) -> DataFrame:
    return reps.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))


def candidate_count(signed: DataFrame, key: str, signature: str, count: int, rows: int) -> DataFrame:
    """One row: the number of lsh_candidates, which aren't made for it."""
    reps, _ = classed(signed.select(key, F.col(signature).alias("signature"), F.col(signature).alias("_same")), key, "_same")
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("copies").cast("long").alias(f"_{x}"))
    apart = rep_pairs(reps, count, rows).join(side("a"), "a").join(side("b"), "b").select((F.col("_a") * F.col("_b")).alias("n"))
    within = reps.select(F.expr("copies * (copies - 1) div 2").alias("n"))
    return apart.unionByName(within).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """pairs (a, b) whose word shingles (as 64-bit hashes) have a Jaccard of `similarity` or more: a, b, jaccard. texts: rep, text.

    A set goes to its connected group of candidates, not to each of its pairs: once for each block of SETS sets there.
    """
    pairs = cut(pairs)
    named = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    blocks = named.groupBy("component").agg(F.ceil(F.count("*") / SETS).cast("int").alias("n"))
    placed = cut(named.join(blocks, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("own"), "n"))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["rep"], "ids": [np.sort(digests(word_sets(t, k), "")).tobytes() for t in f["text"]]})

    wanted = texts.join(placed.select(F.col("node").alias("rep")), "rep", "left_semi").select("rep", F.lower(squeeze(F.col("text"))).alias("text"))
    ways = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least("own", i).alias("left"), F.greatest("own", i).alias("right")))
    sets = wanted.mapInPandas(hashed, "node long, ids binary").join(placed, "node").select("node", "ids", "component", F.inline(ways))
    side = lambda x: placed.select(F.col("node").alias(x), "component", F.col("own").alias(f"_{x}"))
    asked = pairs.join(side("a"), "a").join(side("b").drop("component"), "b").select("a", "b", "component", F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"))

    def check(f: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids = {n: np.frombuffer(x, ">u8").astype(np.uint64) for n, x in zip(held["node"], held["ids"], strict=True)} if len(f) else {}
        out = []
        for a, b in zip(f["a"], f["b"], strict=True):
            x, y = ids[a], ids[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if (jaccard := common / (len(x) + len(y) - common)) >= similarity:
                    out.append((a, b, jaccard))
        return pd.DataFrame(out, columns=["a", "b", "jaccard"])

    at = ("component", "left", "right")
    return asked.groupBy(*at).cogroup(sets.groupBy(*at)).applyInPandas(check, "a long, b long, jaccard double")


def simhash(tokens: DataFrame, key: str, token: str, weight: str, bits: int = 60) -> DataFrame:
    """key, simhash: bit i is set if the weights of tokens whose hash has it outweigh the others."""
    hashed = tokens.select(key, weight, portable_hash(F.col(token), 4).alias("_h"))
    sums = [F.sum(F.when(F.getbit("_h", F.lit(i)) == 1, F.col(weight)).otherwise(-F.col(weight))).alias(f"_b{i}") for i in range(bits)]
    wide = hashed.groupBy(key).agg(*sums)
    value = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"_b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(bits)])
    return wide.select(key, value.alias("simhash"))


def tfidf(tokens: DataFrame, key: str, token: str, min_df: int = 2, sublinear: bool = False) -> DataFrame:
    """key, token, weight: tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length; tokens in fewer than min_df documents are left out."""
    tf = tokens.groupBy(key, token).agg(F.count("*").alias("tf"))
    df = tf.groupBy(token).agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    n = tokens.select(key).distinct().agg(F.count("*").alias("n"))
    counted = (1 + F.log("tf")) if sublinear else F.col("tf")
    raw = tf.join(df, token).crossJoin(F.broadcast(n)).select(key, token, (counted * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("_w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, key).select(key, token, (F.col("_w") / F.col("_norm")).alias("weight"))


def dot_pairs(weights: DataFrame, key: str, token: str) -> DataFrame:
    """a, b (a < b), dot: scalar products of rows that share a token."""
    a, b = weights.select(F.col(key).alias("a"), token, F.col("weight").alias("wa")), weights.select(F.col(key).alias("b"), token, F.col("weight").alias("wb"))
    return a.join(b, token).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
