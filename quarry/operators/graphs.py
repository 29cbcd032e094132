"""Graphs as edge tables: projection, degree, PageRank, HITS, components, label propagation, modularity, partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut an iteration's lineage by a checkpoint in the folder that spark.checkpoint.dir names.

    In local mode an unset folder is made; a cluster without one is an error.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", "") or context._jsc.sc().getCheckpointDir().isDefined()):
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut a lineage like `cut`, by Parquet: repeated values take little room. Shuffle files of the plan that made it may go."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # the cleaner deletes the shuffles of plans that are no longer held
    return spark.read.schema(df.schema).parquet(path)


def project(participation: DataFrame, group: str, node: str, cap: int = 50, least: int = 2) -> DataFrame:
    """src, dst (src < dst), shared, weight: nodes that share groups of 2 to cap members; weight sums 1 / (members - 1)."""
    pairs = participation.select(group, node).distinct()
    sizes = pairs.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n").between(2, cap))
    kept = pairs.join(sizes, group)
    left, right = kept.select(group, F.col(node).alias("src"), "_n"), kept.select(group, F.col(node).alias("dst"))
    found = left.join(right, group).filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"), F.sum(1.0 / (F.col("_n") - 1)).alias("weight"))
    return found.filter(F.col("shared") >= least)


def both_ways(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Each undirected edge as two rows, from one scan."""
    two = F.array(F.struct("src", "dst", F.col(weight).alias("weight")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(weight).alias("weight")))
    return edges.select(F.inline(two))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, strength of an undirected graph."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def pagerank(edges: DataFrame, nodes: DataFrame, beta: float = 0.85, rounds: int = 20, start: DataFrame | None = None, tolerance: float | None = None, history: list[float] | None = None) -> DataFrame:
    """node, rank; nodes without out-edges give their rank to all. start: node, v of a personalised walk.

    It ends after `rounds` rounds, or with a tolerance once the ranks of a round differ by less than it from the last
    ones, summed over all nodes; `history` receives these sums.
    """
    n = nodes.count()
    shares = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("_t")), "src").select("src", "dst", (F.col("weight") / F.col("_t")).alias("p"))
    base = nodes.join(start, "node", "left").na.fill(0.0, ["v"]) if start is not None else nodes.withColumn("v", F.lit(1.0 / n))
    base = base.join(edges.select(F.col("src").alias("node")).distinct().withColumn("_out", F.lit(True)), "node", "left").select("node", "v", F.col("_out").isNull().alias("_dead"))
    shares, base = cut(shares), cut(base)
    rank = base.select("node", "v", "_dead", F.col("v").alias("rank"))
    for _ in range(rounds):
        before = rank
        got = shares.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("_in"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("_dead"), F.col("rank"))), F.lit(0.0)).alias("_lost"))
        rank = base.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "v", "_dead", (beta * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") * F.col("v")) + (1 - beta) * F.col("v")).alias("rank"))
        rank = cut(rank)
        if tolerance is not None:
            moved = rank.join(before.select("node", F.col("rank").alias("_last")), "node").agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("_last"))), F.lit(0.0))).first()[0]
            if history is not None:
                history.append(moved)
            if moved < tolerance:
                break
    return rank.select("node", "rank")


def hits(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, hub, authority: scores of unit length after a fixed number of rounds."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    hub = nodes.withColumn("hub", F.lit(1.0))

    def scaled(df: DataFrame, name: str) -> DataFrame:
        norm = df.agg(F.greatest(F.sqrt(F.sum(F.col(name) * F.col(name))), F.lit(1e-300)).alias("_z"))
        return df.crossJoin(F.broadcast(norm)).select("node", (F.col(name) / F.col("_z")).alias(name))

    authority = None
    for _ in range(rounds):
        authority = cut(scaled(edges.join(hub.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("hub")).alias("authority")), "authority"))
        hub = cut(scaled(edges.join(authority.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("authority")).alias("hub")), "hub"))
    return nodes.join(hub, "node", "left").join(authority, "node", "left").na.fill(0.0)


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (its smallest node), by minimum labels with pointer jumping until nothing changes."""
    pairs = cut(edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct())
    label = nodes.select("node", F.col("node").alias("component"))
    while True:
        near = pairs.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        far = label.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = cut(low.join(far, "low", "left").select("node", "old", F.least("low", "far").alias("component")))
        changed = new.filter("old <> component").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """node, label: synchronous votes by weight, ties to the smaller label; weights are summed in millionths, so order doesn't matter."""
    two = cut(both_ways(edges))
    label = nodes.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        votes = two.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum(F.round(F.col("weight") * 1e6).cast("long")).alias("w"))
        won = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("new"))
        label = cut(label.join(won, "node", "left").select("node", F.coalesce("new", "label").alias("label")))
    return label


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition (node, label)."""
    side = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"l_{n}"))
    placed = edges.join(side("src"), "src").join(side("dst"), "dst")
    total = edges.agg(F.sum("weight").alias("m"))
    inside = placed.filter("l_src = l_dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    by_label = degrees(edges).join(labels, "node").groupBy("label").agg(F.sum("strength").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return total.crossJoin(inside).crossJoin(by_label).select((F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def partition_agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari and nmi (arithmetic mean of entropies) of two labelings in the columns a and b."""
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = cells.agg(F.sum("n").alias("t"), pairs("n").alias("both"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    joint = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("t")
    info = joint.agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    ha = rows.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col("na") / F.col("t")) * F.log(F.col("na") / F.col("t"))).alias("ha"), pairs("na").alias("pa"))
    hb = cols.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col("nb") / F.col("t")) * F.log(F.col("nb") / F.col("t"))).alias("hb"), pairs("nb").alias("pb"))
    one = total.crossJoin(info).crossJoin(ha).crossJoin(hb)
    all_pairs = F.col("t") * (F.col("t") - 1) / 2
    expected, top = F.col("pa") * F.col("pb") / all_pairs, (F.col("pa") + F.col("pb")) / 2
    return one.select(F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"), F.when(F.col("ha") + F.col("hb") == 0, F.lit(1.0)).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """src, dst (src < dst), betweenness: shortest paths through each edge, every pair of nodes counted once; weights aren't read.

    Breadth-first levels from all sources at once count the paths, then dependencies go back level by level. Rows grow
    with the square of the nodes by definition, so the operator is for graphs that were cut to their strong links; they
    stay keyed by (source, node), and no task holds a whole graph. Rounds: twice the diameter.
    """
    two = cut(both_ways(edges.withColumn("weight", F.lit(1.0))).filter("src <> dst").select("src", "dst").distinct())
    levels = [cut(two.select(F.col("src").alias("source"), F.col("src").alias("node"), F.lit(1.0).alias("paths")).distinct())]
    seen = levels[0].select("source", "node")
    while True:
        step = levels[-1].join(two.withColumnRenamed("src", "node"), "node").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut(step.join(seen, ["source", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))
    given = levels[0].select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("c")).filter("false")
    owed = levels[0].select("source", "node", F.lit(0.0).alias("owed")).filter("false")
    for below, above in zip(levels[:0:-1], levels[-2::-1], strict=True):
        low = below.join(owed, ["source", "node"], "left").select("source", F.col("node").alias("src"), ((1 + F.coalesce("owed", F.lit(0.0))) / F.col("paths")).alias("share"))
        back = low.join(two, "src").join(above.withColumnRenamed("node", "dst"), ["source", "dst"])
        passed = cut(back.select("source", "src", "dst", (F.col("paths") * F.col("share")).alias("c")))
        owed = passed.groupBy("source", F.col("dst").alias("node")).agg(F.sum("c").alias("owed"))
        given = given.unionByName(passed.groupBy("src", "dst").agg(F.sum("c").alias("c")))
    return given.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.sum("c") / 2).alias("betweenness"))


def betweenness_of(near: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Edge betweenness of one graph in memory, by the same levels."""
    out = {(a, b): 0.0 for a in near for b in near[a] if a < b}
    for source in near:
        paths, levels, depth = {source: 1.0}, [[source]], {source: 0}
        while levels[-1]:
            level: dict[int, float] = {}
            for v in levels[-1]:
                for w in near[v]:
                    if w not in depth:
                        level[w] = level.get(w, 0.0) + paths[v]
            depth |= dict.fromkeys(level, len(levels))
            paths |= level
            levels.append(list(level))
        owed = dict.fromkeys(paths, 0.0)
        for level in levels[:0:-1]:
            for w in level:
                for v in near[w]:
                    if depth[v] == depth[w] - 1:
                        c = paths[v] / paths[w] * (1 + owed[w])
                        owed[v] += c
                        out[min(v, w), max(v, w)] += c / 2
    return out


def parts_of(near: dict[int, set[int]]) -> dict[int, int]:
    """Component (its smallest node) of each node."""
    label: dict[int, int] = {}
    for first in sorted(near):
        if first in label:
            continue
        label[first], stack = first, [first]
        while stack:
            for w in near[stack.pop()] - label.keys():
                label[w] = first
                stack.append(w)
    return label


def splitter(most_edges: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def split(f: pd.DataFrame) -> pd.DataFrame:
        whole = {(min(a, b), max(a, b)) for a, b in zip(f["src"].tolist(), f["dst"].tolist(), strict=True) if a != b}
        if len(whole) > most_edges:
            raise ValueError(f"a graph of {len(whole)} edges is over most_edges = {most_edges}; cut it to its strong links first")
        near: dict[int, set[int]] = {}
        for a, b in whole:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        degree, m, rows, count = {v: len(n) for v, n in near.items()}, len(whole), [], 0
        while True:
            label = parts_of(near)
            parts = set(label.values())
            if len(parts) > count:
                count, mass = len(parts), dict.fromkeys(parts, 0)
                for v, d in degree.items():
                    mass[label[v]] += d
                inside = sum(label[a] == label[b] for a, b in whole)
                q = inside / m - sum(x * x for x in mass.values()) / (4 * m * m) if m else 0.0
                rows += [(f["graph"].iloc[0], count, q, v, label[v]) for v in sorted(near)]
            score = betweenness_of(near)
            if not score:
                break
            a, b = min(score, key=lambda e: (-round(score[e], 9), e))
            near[a].discard(b)
            near[b].discard(a)
        return pd.DataFrame(rows, columns=["graph", "parts", "modularity", "node", "label"])

    return split


def girvan_newman(edges: DataFrame, most_edges: int = 20_000) -> DataFrame:
    """graph, parts, modularity, node, label: every partition met while the edge of most betweenness goes, ties to the smallest.

    edges: graph, src, dst (integers). Each graph is one group, sequential by nature; graphs run side by side. One of
    more than most_edges edges is an error, none is cut. Modularity is that of the unweighted graph.
    """
    return edges.select("graph", "src", "dst").groupBy("graph").applyInPandas(splitter(most_edges), "graph long, parts int, modularity double, node long, label long")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links between nodes of a set (node), with all their columns."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def link_scores(edges: DataFrame) -> DataFrame:
    """src, dst, common, adamic_adar of pairs with a common neighbour, which counts 1 / ln(max(degree, 2))."""
    two = both_ways(edges.withColumn("weight", F.lit(1.0))).select("src", "dst")
    degree = two.groupBy("src").agg(F.count("*").alias("d"))
    spokes = two.join(degree, "src").select(F.col("src").alias("mid"), F.col("dst").alias("end"), (1 / F.log(F.greatest("d", F.lit(2)))).alias("w"))
    wedge = spokes.select("mid", F.col("end").alias("src"), "w").join(spokes.select("mid", F.col("end").alias("dst")), "mid").filter("src < dst")
    return wedge.groupBy("src", "dst").agg(F.count("*").alias("common"), F.sum("w").alias("adamic_adar"))


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the rank statistic with ties averaged, from one row for each distinct score; null if a class is empty."""
    by = scored.groupBy(score).agg(F.count_if(positive).alias("p"), F.count("*").alias("n"))
    below = F.sum("n").over(Window.orderBy(score)) - F.col("n")
    ranked = by.withColumn("r", below + (F.col("n") + 1) / 2)
    none = F.lit(0)
    sums = ranked.agg(F.sum(F.col("p") * F.col("r")).alias("s"), F.coalesce(F.sum("p"), none).alias("pos"), F.coalesce(F.sum(F.col("n") - F.col("p")), none).alias("neg"))
    return sums.select("pos", "neg", F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc"))
