"""Exact and inverted-file vector search, k-means, silhouettes and density clusters over array columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import blocks as bl
from quarry.operators import graphs as gr

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def matrix(frame: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack(frame[vector].to_numpy()).astype(np.float64)


def unit(table: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays, and so has cosine 0 with all."""
    return table / np.maximum(np.sqrt((table * table).sum(axis=1)), 1e-300)[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


def nearest_in(key: str, vector: str, k: int, metric: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best of a block of rows for each of a block of queries: query, neighbour, score."""

    def run(asked: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "neighbour": [], "score": []}).astype({"query": "int64", "neighbour": "int64"})]
        if len(asked) and len(f):
            queries, rows = matrix(asked, vector), matrix(f, vector)
            if metric == "cosine":
                queries, rows = unit(queries), unit(rows)
            names, other = asked[key].to_numpy(), f[key].to_numpy()
            for at in range(0, len(queries), bl.TILE):
                part = slice(at, at + bl.TILE)
                scores = queries[part] @ rows.T if metric == "cosine" else -distances(queries[part], rows)
                scores[names[part, None] == other[None]] = -np.inf
                i, j, found = bl.best(scores, other, k, 6)
                out.append(pd.DataFrame({"query": names[part][i], "neighbour": other[j], "score": found if metric == "cosine" else -found + 0.0}))
        return pd.concat(out, ignore_index=True)

    return run


FOUND = "query long, neighbour long, score double"


def ranked(found: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k best of all blocks, with their place."""
    best = F.desc("score") if metric == "cosine" else F.asc("score")
    place = F.row_number().over(Window.partitionBy("query").orderBy(best, "neighbour"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """query, neighbour, score, place: the k best rows of each query, itself left out; cosine (largest) or l2 (smallest).

    Blocks of queries meet blocks of rows as matrix products, and k rows for each query and block leave them. Scores are
    rounded to 6 places before ranking, ties go to the smaller key.
    """
    asked, held = (df.select(F.col(key).cast("long").alias(key), vector) for df in (queries, rows))
    found = bl.against(asked, held, key, nearest_in(key, vector, k, metric), FOUND, bl.blocks_for(queries.count()), bl.blocks_for(rows.count()))
    return ranked(found, k, metric)


def probe_cells(queries: DataFrame, rows: DataFrame, key: str, vector: str, centroids: list[tuple[int, list[float]]], probes: int, k: int) -> DataFrame:
    """nearest by an inverted file: each row is in the cell of its centroid, and a query sees its `probes` nearest cells.

    A cell is dealt to blocks of bounded size by hash, so a large one is no single task; a query goes to all its blocks.
    """
    indexed = assign(rows.select(F.col(key).cast("long").alias(key), vector), vector, centroids).select(key, vector, "cell")
    size = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each centroid
    parts = F.array(*[F.lit(bl.blocks_for(size.get(c, 0), spread=1)) for c, _ in centroids])
    table = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(i).alias("at"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for i, (c, v) in enumerate(centroids)])
    at_cell = F.array(*[F.lit(c) for c, _ in centroids])
    order = F.transform(F.array(F.col(vector)), lambda own: F.slice(F.array_sort(F.transform(table, lambda c: F.struct(F.round(squared_distance(own, c["v"]), 9).alias("d"), c["cell"].alias("cell"), c["at"].alias("at")))), 1, probes))[0]
    asked = queries.select(F.col(key).cast("long").alias(key), vector, F.explode(order).alias("p")).select(key, vector, F.col("p.cell").alias("cell"), F.explode(F.sequence(F.lit(0), parts[F.col("p.at")] - 1)).alias("_part"))
    held = indexed.withColumn("_part", F.pmod(F.xxhash64(key), parts[F.array_position(at_cell, F.col("cell")).cast("int") - 1]).cast("int"))
    found = asked.groupBy("cell", "_part").cogroup(held.groupBy("cell", "_part")).applyInPandas(nearest_in(key, vector, k, "cosine"), FOUND)
    return ranked(found, k)


def fit_cells(rows: DataFrame, key: str, vector: str, k: int, recall: float = 0.95, sample: int = 8192, rounds: int = 8) -> tuple[np.ndarray, int]:
    """(centroids, probes) of an inverted file for cosine, fitted on the `sample` rows with the smallest hashes of their key.

    Lloyd's rounds on unit vectors give as many cells as the square root of the rows, an eighth of the sample at most.
    The probes are the fewest cells that hold the share `recall` of the k exact neighbours, within the sample, of up to
    512 of its rows; a sample's neighbours are further apart than those of all rows, so all rows need no more.
    """
    held = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
    cells = max(1, min(math.isqrt(held.count()), sample // 8))
    drawn = held.orderBy(F.xxhash64(key), key).limit(sample).toPandas()
    if drawn.empty:
        return np.zeros((1, 1)), 1
    points = unit(matrix(drawn, vector))
    centres = points[:cells].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = np.bincount(own, minlength=cells) > 0
        centres[filled] = unit(sums[filled])
    asked = points[-512:]
    scores, near = asked @ points.T, asked @ centres.T
    scores[np.arange(len(asked)), np.arange(len(points) - len(asked), len(points))] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
    if not best.size:
        return centres, cells
    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, (points @ centres.T).argmax(axis=1)[best], axis=1), axis=None)
    return centres, int(needed[math.ceil(recall * needed.size) - 1]) + 1


def probe_fitted(queries: DataFrame, rows: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int, k: int) -> DataFrame:
    """nearest by cosine among the rows of the `probes` cells nearest to each query. Rows without a vector aren't found.

    Cells are named by matrix products of batches; a large cell is dealt to blocks of bounded size, and a query goes to
    all blocks of its cells.
    """

    def place(count: int, parts: list[int] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), bl.TILE):
                    part = f.iloc[at : at + bl.TILE]
                    near = np.argsort(-(unit(matrix(part, vector)) @ centres.T), axis=1, kind="stable")[:, :count]
                    out = part.loc[part.index.repeat(near.shape[1])].assign(cell=near.ravel())
                    if parts is not None:  # a query for each block of each cell
                        times = np.array(parts)[out["cell"]]
                        first = np.repeat(np.cumsum(times) - times, times)
                        out = out.iloc[np.repeat(np.arange(len(out)), times)].assign(_part=np.arange(times.sum()) - first)
                    yield out

        return run

    asked, held = (df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector) for df in (queries, rows))
    schema = f"{key} long, {vector} {rows.schema[vector].dataType.simpleString()}, cell long"
    indexed = held.mapInPandas(place(1), schema)
    size = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
    parts = [bl.blocks_for(size.get(c, 0), spread=1) for c in range(len(centres))]
    dealt = indexed.withColumn("_part", F.pmod(F.xxhash64(key), F.element_at(F.lit(parts), (F.col("cell") + 1).cast("int"))))
    sent = asked.mapInPandas(place(probes, parts), f"{schema}, _part long")
    return ranked(sent.groupBy("cell", "_part").cogroup(dealt.groupBy("cell", "_part")).applyInPandas(nearest_in(key, vector, k, "cosine"), FOUND), k)


def density_clusters(rows: DataFrame, key: str, vector: str, eps: float, least: int) -> DataFrame:
    """key, cluster: density clusters by cosine of eps or more (rounded to 6 places); -1 for noise.

    A row is a core if `least` rows, itself included, are so near. The id of a cluster is its smallest core, and a border
    row joins the smallest one near it. Equal vectors are one node that counts as often as it occurs. Nodes meet in pairs
    of blocks, twice: once for the counts, once for links between cores, of which each pair of blocks returns a spanning
    forest at most. A border row has fewer than `least` links by definition.
    """
    slim = rows.select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("_vector"))
    nodes = gr.cut(slim.groupBy("_vector").agg(F.min("_key").alias("node"), F.count("*").alias("copies")))
    blocks = bl.blocks_for(nodes.count())

    def near(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        a = unit(matrix(left, "_vector"))
        b = a if same else unit(matrix(right, "_vector"))
        for at in range(0, len(a), bl.TILE):
            scores = a[at : at + bl.TILE] @ b.T
            found = scores >= eps - 1e-6
            i, j = np.nonzero(found & (scores < eps + 1e-6))
            found[i, j] = np.round(scores[i, j], 6) >= eps
            if same:
                here = np.arange(at, min(at + bl.TILE, len(a)))
                found[here - at, here] = False
            yield at, found

    def count(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        mine, theirs = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        here, there = left["copies"].to_numpy(), right["copies"].to_numpy()
        for at, found in near(left, right, same):
            mine[at : at + bl.TILE] = found @ there
            theirs += here[at : at + bl.TILE] @ found
        out = pd.DataFrame({"node": left["node"], "n": mine})
        return out if same else pd.concat([out, pd.DataFrame({"node": right["node"], "n": theirs})], ignore_index=True)

    def link(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        names = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
        cores, others = left["core"].to_numpy(), right["core"].to_numpy()
        within, border = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for at, found in near(left, right, same):
            mine = cores[at : at + bl.TILE]
            i, j = np.nonzero(found & mine[:, None] & others[None])
            within.append(np.stack(bl.forest(i + at, j + len(left), len(names)), axis=1))
            for one, two, flip in ((~mine, others, False), (mine, ~others, True)):
                i, j = np.nonzero(found & one[:, None] & two[None])
                border.append(np.stack([j + len(left), i + at] if flip else [i + at, j + len(left)], axis=1))
        a, b = np.concatenate(within).T
        if same:  # both halves are the same nodes
            a, b = a % len(left), b % len(left)
        a, b = bl.forest(a, b, len(names))
        links, edge = pd.DataFrame({"a": names[a], "b": names[b], "inner": True}), names[np.concatenate(border)]
        return pd.concat([links, pd.DataFrame({"a": edge[:, 0], "b": edge[:, 1], "inner": False})], ignore_index=True)

    around = bl.with_itself(nodes, "node", count, "node long, n long", blocks).groupBy("node").agg(F.sum("n").alias("n"))
    zero = F.forall("_vector", lambda x: x == 0)
    total = F.col("n") + F.when(zero, F.lit(1)).otherwise(F.col("copies"))
    marked = gr.cut(nodes.join(around, "node").withColumn("core", total >= least))
    links = gr.cut(bl.with_itself(marked.select("node", "_vector", "core"), "node", link, "a long, b long, inner boolean", blocks))
    found = gr.connected_components(links.filter("inner").select(F.col("a").alias("src"), F.col("b").alias("dst")), marked.filter("core").select("node"))
    border = links.filter("not inner").join(found.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
    named = marked.select("node", "_vector").join(found, "node", "left").join(border, "node", "left").select("_vector", F.coalesce("component", "near", F.lit(-1)).alias("cluster"))
    return slim.join(named, "_vector").select(F.col("_key").alias(key), "cluster")


def noise(rows: DataFrame, key: str, vector: str, nears: tuple[float, ...], least: int) -> DataFrame:
    """key, n0, n1, ...: whether the row is noise of density_clusters at each eps of `nears`.

    Noise is no core and near none, which needs no clusters and no links: nodes meet twice for all settings together, once
    for the counts and once for whether a core is near, and each pair of blocks returns a row for each of its nodes.
    """
    slim = rows.select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("_vector"))
    nodes = gr.cut(slim.groupBy("_vector").agg(F.min("_key").alias("node"), F.count("*").alias("copies")))
    blocks, some = bl.blocks_for(nodes.count()), range(len(nears))

    def sums(column: str) -> Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]:
        """For each node and eps, the sum of a column of arrays (one value for each eps) over the other nodes that are near."""

        def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
            a, here = unit(matrix(left, "_vector")), np.stack(left[column].tolist()).astype(np.float64)
            b, there = (a, here) if same else (unit(matrix(right, "_vector")), np.stack(right[column].tolist()).astype(np.float64))
            mine, theirs = np.zeros((len(a), len(nears))), np.zeros((len(b), len(nears)))
            for at in range(0, len(a), bl.TILE):
                scores = a[at : at + bl.TILE] @ b.T
                for e, eps in enumerate(nears):
                    found = scores >= eps - 1e-6
                    i, j = np.nonzero(found & (scores < eps + 1e-6))
                    found[i, j] = np.round(scores[i, j], 6) >= eps
                    if same:
                        inside = np.arange(at, min(at + bl.TILE, len(a)))
                        found[inside - at, inside] = False
                    found = found.astype(np.float64)
                    mine[at : at + bl.TILE, e] = found @ there[:, e]
                    if not same:
                        theirs[:, e] += here[at : at + bl.TILE, e] @ found
            out = [(left, mine)] if same else [(left, mine), (right, theirs)]
            return pd.concat([pd.DataFrame({"node": f["node"], "n": list(n.astype(np.int64))}) for f, n in out], ignore_index=True)

        return run

    def met(table: DataFrame, column: str) -> DataFrame:
        found = bl.with_itself(table.select("node", "_vector", column), "node", sums(column), "node long, n array<long>", blocks)
        return found.groupBy("node").agg(*[F.sum(F.col("n")[e]).alias(f"n{e}") for e in some])

    own = F.when(F.forall("_vector", lambda x: x == 0), F.lit(1)).otherwise(F.col("copies"))
    around = met(nodes.withColumn("weight", F.array(*[F.col("copies")] * len(nears))), "weight")
    marked = gr.cut(nodes.join(around, "node").select("node", "_vector", F.array(*[(F.col(f"n{e}") + own >= least).cast("long") for e in some]).alias("core")))
    named = marked.join(met(marked, "core"), "node").select("_vector", *[((F.col("core")[e] == 0) & (F.col(f"n{e}") == 0)).alias(f"n{e}") for e in some])
    return slim.join(named, "_vector").select(F.col("_key").alias(key), *[f"n{e}" for e in some])


def assign(rows: DataFrame, vector: str, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """Add `cell` and `distance2`: the nearest of a bounded list of centroids (ties: the smaller cell)."""
    table = F.array(*[F.struct(F.lit(c).alias("cell"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for c, v in centroids])
    v = F.col(vector)
    scored = F.transform(F.array(v), lambda own: F.array_min(F.transform(table, lambda c: F.struct(F.round(squared_distance(own, c["v"]), 9).alias("d"), c["cell"].alias("cell")))))[0]
    return rows.withColumn("_best", scored).withColumns({"cell": F.col("_best.cell"), "distance2": F.col("_best.d")}).drop("_best")


def kmeans(rows: DataFrame, vector: str, start: list[tuple[int, list[float]]], rounds: int) -> list[tuple[int, list[float]]]:
    """Lloyd's centroids after `rounds` rounds from given ones; an empty cell keeps its centroid."""
    centroids = start
    size = len(start[0][1])
    for _ in range(rounds):
        means = [F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(size)]
        found = {r["cell"]: [r[f"m{i}"] for i in range(size)] for r in assign(rows, vector, centroids).groupBy("cell").agg(*means).collect()}  # one row for each centroid
        centroids = [(c, found.get(c, v)) for c, v in centroids]
    return centroids


def silhouette(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label, silhouette by Euclidean distance; 0 for a cluster of one. Distances are summed by label within pairs of blocks."""
    slim = rows.select(F.col(key).cast("long").alias(key), vector, label)
    kind, names = rows.schema[label].dataType.simpleString(), [key, label, "other", "s"]

    def run(asked: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(f):
            return pd.DataFrame([], columns=names)
        a, b, out = matrix(asked, vector), matrix(f, vector), []
        codes, labels = pd.factorize(f[label])
        member = np.zeros((len(f), len(labels)))
        member[np.arange(len(f)), codes] = 1
        for at in range(0, len(a), bl.TILE):
            part = asked.iloc[at : at + bl.TILE]
            d = distances(a[at : at + bl.TILE], b)
            d[part[key].to_numpy()[:, None] == f[key].to_numpy()[None]] = 0
            for i, s in enumerate((d @ member).T):
                out.append(pd.DataFrame({key: part[key], label: part[label], "other": labels[i], "s": s}))
        return pd.concat(out, ignore_index=True)

    blocks = bl.blocks_for(rows.count())
    out = bl.against(slim, slim, key, run, f"{key} long, {label} {kind}, other {kind}, s double", blocks, blocks)
    counts = rows.groupBy(F.col(label).alias("other")).agg(F.count("*").alias("n"))
    sums = out.groupBy(key, label, "other").agg(F.sum("s").alias("s")).join(counts, "other")
    inner = F.max(F.when(F.col("other") == F.col(label), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))))
    outer = F.min(F.when(F.col("other") != F.col(label), F.col("s") / F.col("n")))
    both = sums.groupBy(key, label).agg(inner.alias("a"), outer.alias("b"), F.max(F.when(F.col("other") == F.col(label), F.col("n"))).alias("n"))
    return both.select(key, label, F.when(F.col("n") == 1, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))
