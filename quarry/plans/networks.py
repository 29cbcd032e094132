"""Supplier graphs: co-participation, losers and winners, link analysis, communities, walks."""

from __future__ import annotations

from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import portable_hash, sql_hash
from quarry.operators import graphs as gr
from quarry.operators import spectral as sp
from quarry.operators.relational import first_per_group, mode_per_key, range_ranks
from quarry.plans.registry import Tables, query

#: Orders shared by two suppliers, at least, and members of an order that counts, at most.
LEAST, MOST = 2, 50

PART = "pt AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS n FROM lineitem), sz AS (SELECT g, count(*) AS c FROM pt GROUP BY 1)"
COPART = f"{PART}, ed AS (SELECT x.n AS src, y.n AS dst, count(*) AS shared, sum(1.0 / (c - 1)) AS weight FROM pt x JOIN pt y ON x.g = y.g AND x.n < y.n JOIN sz ON sz.g = x.g AND c BETWEEN 2 AND {MOST} GROUP BY ALL HAVING count(*) >= {LEAST})"


def participation(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("n")).distinct()


def shared_orders(t: Tables) -> DataFrame:
    return gr.project(participation(t), "g", "n", MOST, LEAST)


@query(f"WITH {COPART} SELECT src, dst, shared, round(weight, 6) AS weight FROM ed")
def coparticipation_edges(t: Tables) -> DataFrame:
    """Suppliers by shared orders, Newman's weights."""
    return shared_orders(t).withColumn("weight", F.round("weight", 6))


TWO = "tw AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed)"


@query(f"WITH {COPART}, {TWO} SELECT src AS node, count(*) AS degree, round(sum(weight), 6) AS strength FROM tw GROUP BY 1")
def degree_strength(t: Tables) -> DataFrame:
    """Degree and strength."""
    return gr.degrees(shared_orders(t)).withColumn("strength", F.round("strength", 6))


GRID = [(5, 1), (5, 12), (50, 1), (50, 12)]


@query(f"WITH {PART}, pr AS (SELECT x.n AS a, y.n AS b, count(*) FILTER (WHERE c <= 5) AS n5, count(*) AS n50 FROM pt x JOIN pt y ON x.g = y.g AND x.n < y.n JOIN sz ON sz.g = x.g AND c BETWEEN 2 AND 50 GROUP BY ALL) SELECT * FROM (" + " UNION ALL ".join(f"SELECT {c} AS cap, {m} AS least, count(*) FILTER (WHERE n{c} >= {m}) AS edges FROM pr" for c, m in GRID) + ")")
def cap_min_grid(t: Tables) -> DataFrame:
    """Edges by cap and least shared orders, from one pass over the pairs."""
    p = participation(t)
    sizes = p.groupBy("g").agg(F.count("*").alias("c")).filter("c between 2 and 50")
    kept = p.join(sizes, "g")
    pairs = kept.select("g", "c", F.col("n").alias("a")).join(kept.select("g", F.col("n").alias("b")), "g").filter("a < b").groupBy("a", "b").agg(F.count_if(F.col("c") <= 5).alias("n5"), F.count("*").alias("n50"))
    counted = pairs.agg(*[F.count_if(F.col(f"n{c}") >= m).alias(f"e{c}_{m}") for c, m in GRID])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("cap"), F.lit(m).alias("least"), F.col(f"e{c}_{m}").alias("edges")) for c, m in GRID])))


@query(f"WITH {COPART}, tot AS (SELECT n, count(*) AS c FROM pt GROUP BY 1) SELECT src, dst, shared, round(shared / least(x.c, y.c), 6) AS affinity FROM ed JOIN tot x ON x.n = src JOIN tot y ON y.n = dst WHERE shared / least(x.c, y.c) >= 0.02")
def affinity_pairs(t: Tables) -> DataFrame:
    """Overlap coefficient of shared orders."""
    total = participation(t).groupBy("n").agg(F.count("*").alias("c"))
    side = lambda k: total.select(F.col("n").alias(k), F.col("c").alias(f"c_{k}"))
    ratio = F.col("shared") / F.least("c_src", "c_dst")
    return shared_orders(t).join(side("src"), "src").join(side("dst"), "dst").filter(ratio >= 0.02).select("src", "dst", "shared", F.round(ratio, 6).alias("affinity"))


LW = """s AS (SELECT l_orderkey AS g, l_suppkey AS n, round(sum(l_extendedprice), 2) AS m FROM lineitem GROUP BY ALL), w AS (SELECT g, n AS win FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m DESC, n) AS r FROM s) WHERE r = 1),
lw AS (SELECT s.n AS src, w.win AS dst, count(*) AS contests, CAST(count(*) AS DOUBLE) AS weight FROM s JOIN w ON s.g = w.g AND s.n <> w.win GROUP BY ALL)"""


def winners(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("n")).agg(F.round(F.sum("l_extendedprice"), 2).alias("m"))
    return first_per_group(sums, ["g"], [F.desc("m"), F.col("n")]).select("g", F.col("n").alias("win"))


def contests(t: Tables) -> DataFrame:
    """src lost to dst: losers are participants that didn't win."""
    won = winners(t)
    lost = participation(t).join(won.select("g", F.col("win").alias("n")), ["g", "n"], "left_anti")
    return lost.join(won, "g").groupBy(F.col("n").alias("src"), F.col("win").alias("dst")).agg(F.count("*").alias("contests")).withColumn("weight", F.col("contests").cast("double"))


@query(f"WITH {LW} SELECT src, dst, contests, weight FROM lw")
def loser_winner_edges(t: Tables) -> DataFrame:
    """From each loser to the winner."""
    return contests(t)


@query(f"WITH {LW}, nd AS (SELECT src AS n FROM lw UNION SELECT dst FROM lw) SELECT (SELECT count(*) FROM nd) AS nodes, count(*) AS edges, (SELECT count(*) FROM nd WHERE n NOT IN (SELECT src FROM lw)) AS dead_ends, (SELECT count(*) FROM nd WHERE n NOT IN (SELECT dst FROM lw)) AS never_win, (SELECT count(*) FROM lw a JOIN lw b ON a.src = b.dst AND a.dst = b.src AND a.src < a.dst) AS reciprocal FROM lw")
def graph_structure(t: Tables) -> DataFrame:
    """Dead ends, nodes that never win, reciprocal pairs."""
    e = contests(t).select("src", "dst")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    dead = nodes.join(e.select(F.col("src").alias("n")), "n", "left_anti")
    never = nodes.join(e.select(F.col("dst").alias("n")), "n", "left_anti")
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).filter("src < dst")
    return count(nodes, "nodes").crossJoin(count(e, "edges")).crossJoin(count(dead, "dead_ends")).crossJoin(count(never, "never_win")).crossJoin(count(back, "reciprocal"))


def pagerank_sql(beta: float, rounds: int, name: str = "r", seeded: bool = False) -> str:
    v = "CASE WHEN n = (SELECT min(n) FROM nd) THEN 1.0 ELSE 0.0 END" if seeded else "1.0 / (SELECT count(*) FROM nd)"
    parts = [f"{name}0 AS (SELECT n, v AS rank FROM {name}v)"]
    for i in range(rounds):
        parts.append(f"{name}{i + 1} AS (SELECT n, {beta} * (coalesce((SELECT sum(p * q.rank) FROM sh JOIN {name}{i} q ON q.n = sh.src WHERE sh.dst = z.n), 0) + (SELECT coalesce(sum(rank), 0) FROM {name}{i} WHERE n NOT IN (SELECT src FROM lw)) * v) + (1 - {beta}) * v AS rank FROM {name}v z)")
    return f"{name}v AS (SELECT n, {v} AS v FROM nd), " + ", ".join(parts)


NODES = "nd AS (SELECT src AS n FROM lw UNION SELECT dst FROM lw), sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM lw)"


def ranked(t: Tables, beta: float, rounds: int) -> DataFrame:
    e = gr.cut(contests(t))
    return gr.pagerank(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), beta, rounds)


@query(f"WITH {LW}, {NODES}, {pagerank_sql(0.85, 8)} SELECT n AS node, round(rank, 8) AS rank FROM r8")
def pagerank(t: Tables) -> DataFrame:
    """PageRank of the winners, eight rounds."""
    return ranked(t, 0.85, 8).withColumn("rank", F.round("rank", 8))


@query(f"WITH {LW}, {NODES}, {pagerank_sql(0.85, 5, 'r', True)} SELECT n AS node, round(rank, 8) AS rank FROM r5")
def personalized_pagerank(t: Tables) -> DataFrame:
    """Walks that restart at the smallest node."""
    e = gr.cut(contests(t))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    start = nodes.agg(F.min("node").alias("node")).withColumn("v", F.lit(1.0))
    return gr.pagerank(e, nodes, 0.85, 5, start).withColumn("rank", F.round("rank", 8))


@query(f"WITH {LW}, {NODES}, {pagerank_sql(0.5, 5, 'a')}, {pagerank_sql(0.85, 5, 'b')}, x AS (SELECT a5.n, rank() OVER (ORDER BY round(a5.rank, 10) DESC) AS ra, rank() OVER (ORDER BY round(b5.rank, 10) DESC) AS rb FROM a5 JOIN b5 USING (n)) SELECT count(*) AS nodes, count(*) FILTER (WHERE ra <= 20 AND rb <= 20) AS top_overlap, round(corr(ra, rb), 5) AS spearman, max(ra - rb) AS best_riser FROM x")
def pagerank_beta_sweep(t: Tables) -> DataFrame:
    """Ranks under two damping factors."""
    place = lambda: F.rank().over(Window.orderBy(F.desc(F.round("rank", 10))))  # noqa: E731  one row for each node of the graph
    a, b = ranked(t, 0.5, 5).select("node", place().alias("ra")), ranked(t, 0.85, 5).select("node", place().alias("rb"))
    return a.join(b, "node").agg(F.count("*").alias("nodes"), F.count_if((F.col("ra") <= 20) & (F.col("rb") <= 20)).alias("top_overlap"), F.round(F.corr("ra", "rb"), 5).alias("spearman"), F.max(F.col("ra") - F.col("rb")).cast("long").alias("best_riser"))


def hits_sql(rounds: int) -> str:
    parts = ["h0 AS (SELECT n, 1.0 AS hub FROM nd)"]
    for i in range(rounds):
        parts.append(f"ua{i} AS (SELECT dst AS n, sum(weight * hub) AS x FROM lw JOIN h{i} ON n = src GROUP BY 1), a{i} AS (SELECT n, x / (SELECT sqrt(sum(x * x)) FROM ua{i}) AS auth FROM ua{i})")
        parts.append(f"uh{i} AS (SELECT src AS n, sum(weight * auth) AS x FROM lw JOIN a{i} ON n = dst GROUP BY 1), h{i + 1} AS (SELECT n, x / (SELECT sqrt(sum(x * x)) FROM uh{i}) AS hub FROM uh{i})")
    return ", ".join(parts)


@query(f"WITH {LW}, {NODES}, {hits_sql(4)} SELECT n AS node, round(coalesce(hub, 0), 6) AS hub, round(coalesce(auth, 0), 6) AS authority FROM nd LEFT JOIN h4 USING (n) LEFT JOIN a3 USING (n)")
def hits(t: Tables) -> DataFrame:
    """Hubs and authorities, four rounds."""
    return gr.hits(gr.cut(contests(t)), 4).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query(f"""WITH {PART}, {LW}, p AS (SELECT x.g, x.n AS a, y.n AS b FROM pt x JOIN pt y ON x.g = y.g AND x.n < y.n), k AS (SELECT a, b, count(*) AS shared, count(*) FILTER (WHERE win = a) AS wins_a, count(*) FILTER (WHERE win = b) AS wins_b FROM p JOIN w ON w.g = p.g GROUP BY ALL HAVING count(*) >= {LEAST})
SELECT *, CASE WHEN wins_a + wins_b = 0 THEN 'lose together' WHEN least(wins_a, wins_b) = 0 THEN 'always same' ELSE 'alternate' END AS pattern, round(least(wins_a, wins_b) / greatest(wins_a + wins_b, 1), 6) AS alternation FROM k""")
def head_to_head(t: Tables) -> DataFrame:
    """Who wins where two suppliers meet."""
    p = participation(t)
    pairs = p.select("g", F.col("n").alias("a")).join(p.select("g", F.col("n").alias("b")), "g").filter("a < b").join(winners(t), "g")
    k = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("win") == F.col("a")).alias("wins_a"), F.count_if(F.col("win") == F.col("b")).alias("wins_b")).filter(F.col("shared") >= LEAST)
    low, both = F.least("wins_a", "wins_b"), F.col("wins_a") + F.col("wins_b")
    return k.select("*", F.when(both == 0, "lose together").when(low == 0, "always same").otherwise("alternate").alias("pattern"), F.round(low / F.greatest(both, F.lit(1)), 6).alias("alternation"))


@query(f"WITH RECURSIVE {COPART}, {TWO}, nd AS (SELECT DISTINCT src AS n FROM tw), reach AS (SELECT n, n AS root FROM nd UNION SELECT tw.dst, root FROM reach JOIN tw ON tw.src = reach.n), c AS (SELECT n, min(root) AS component FROM reach GROUP BY 1) SELECT n AS node, component, count(*) OVER (PARTITION BY component) AS size FROM c")
def connected_components(t: Tables) -> DataFrame:
    """Components of suppliers that share orders, with their size."""
    e = gr.cut(shared_orders(t))
    found = gr.connected_components(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def lpa_sql(rounds: int) -> str:
    parts = ["l0 AS (SELECT DISTINCT src AS node, src AS label FROM tw)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS (SELECT node, label FROM (SELECT tw.src AS node, l.label, row_number() OVER (PARTITION BY tw.src ORDER BY sum(CAST(round(weight * 1e6) AS BIGINT)) DESC, l.label) AS r FROM tw JOIN l{i} l ON l.node = tw.dst GROUP BY tw.src, l.label) WHERE r = 1)")
    return ", ".join(parts)


def communities(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = gr.cut(shared_orders(t))
    return e, gr.label_propagation(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), 3)


@query(f"WITH {COPART}, {TWO}, {lpa_sql(3)} SELECT node, label FROM l3")
def label_propagation(t: Tables) -> DataFrame:
    """Three rounds of weighted votes."""
    return communities(t)[1]


@query(f"WITH {COPART}, {TWO}, {lpa_sql(3)}, m AS (SELECT sum(weight) AS m FROM ed), i AS (SELECT coalesce(sum(weight), 0) AS i FROM ed JOIN l3 a ON a.node = src JOIN l3 b ON b.node = dst WHERE a.label = b.label), d AS (SELECT sum(d * d) AS dd FROM (SELECT label, sum(weight) AS d FROM tw JOIN l3 ON node = src GROUP BY 1)) SELECT round(i / m - dd / (4 * m * m), 6) AS modularity FROM m, i, d")
def modularity(t: Tables) -> DataFrame:
    """L1: modularity of the propagated labels."""
    e, labels = communities(t)
    return gr.modularity(e, labels).select(F.round("modularity", 6).alias("modularity"))


@query(f"""WITH {COPART}, {TWO}, {lpa_sql(3)}, x AS (SELECT label, s_nationkey AS nation, count(*) AS n FROM l3 JOIN supplier ON s_suppkey = node GROUP BY ALL), t AS (SELECT label, sum(n) AS t, sum(n * n) AS q FROM x GROUP BY 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, nation) AS r FROM x) WHERE r = 1)
SELECT label, CAST(t AS BIGINT) AS members, nation, round(n / t, 6) AS share, round(q / (t * t), 6) AS expected_same FROM t JOIN b USING (label)""")
def community_profiles(t: Tables) -> DataFrame:
    """Dominant nation of each community, its share, and pairs expected within a nation."""
    placed = communities(t)[1].join(t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("nation")), "node")
    top = mode_per_key(placed, "label", "nation")
    counts = placed.groupBy("label", "nation").agg(F.count("*").alias("c")).groupBy("label").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return top.join(counts, "label").select("label", "members", "nation", F.round("share", 6).alias("share"), F.round(F.col("q") / (F.col("members") * F.col("members")), 6).alias("expected_same"))


AA = "dg AS (SELECT src, count(*) AS d FROM tw GROUP BY 1), aa AS (SELECT x.dst AS src, y.dst AS dst, count(*) AS common, sum(1 / ln(greatest(d, 2))) AS adamic_adar FROM tw x JOIN tw y ON x.src = y.src AND x.dst < y.dst JOIN dg ON dg.src = x.src GROUP BY ALL)"


@query(f"WITH {COPART}, {TWO}, {AA} SELECT src, dst, common, round(adamic_adar, 6) AS adamic_adar FROM aa")
def common_neighbors_adamic_adar(t: Tables) -> DataFrame:
    """Link heuristics."""
    return gr.link_scores(gr.cut(shared_orders(t))).withColumn("adamic_adar", F.round("adamic_adar", 6))


#: Links of link_auc, and of edge_betweenness, whose rows are sources times links.
STRONG = COPART.replace(f">= {LEAST}", ">= 28")


def strong(t: Tables) -> DataFrame:
    return gr.project(participation(t), "g", "n", MOST, 28)


@query(f"WITH {STRONG}, {TWO}, {AA}, s AS (SELECT round(adamic_adar, 6) AS s, e.src IS NOT NULL AS pos FROM aa LEFT JOIN ed e USING (src, dst)), r AS (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s), c AS (SELECT count(*) FILTER (WHERE pos) AS pos, count(*) FILTER (WHERE NOT pos) AS neg, sum(r) FILTER (WHERE pos) AS s FROM r) SELECT pos, neg, round((s - pos * (pos + 1) / 2) / nullif(pos * neg, 0), 6) AS auc FROM c")
def link_auc(t: Tables) -> DataFrame:
    """How well Adamic-Adar tells links from other pairs."""
    e = gr.cut(strong(t))
    scored = gr.link_scores(e).withColumn("s", F.round("adamic_adar", 6)).join(e.select("src", "dst", F.lit(True).alias("link")), ["src", "dst"], "left")
    return gr.auc(scored.withColumn("pos_link", F.coalesce("link", F.lit(False))), "s", "pos_link").withColumn("auc", F.round("auc", 6))


LEVELS = 8  # of the SQL; the operator goes on until no node is new


def paths_sql() -> str:
    parts = ["b0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS n, CAST(1 AS DOUBLE) AS p FROM tw)"]
    for k in range(1, LEVELS + 1):
        old = " UNION ALL ".join(f"SELECT s, n FROM b{i}" for i in range(k))
        parts.append(f"b{k} AS MATERIALIZED (SELECT s, dst AS n, sum(p) AS p FROM b{k - 1} JOIN tw ON tw.src = n WHERE (s, dst) NOT IN (SELECT (s, n) FROM ({old})) GROUP BY ALL)")
    return ", ".join(parts) + ", lv AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, n, p, {k} AS k FROM b{k}" for k in range(LEVELS + 1)) + ")"


@query(f"WITH {STRONG}, {TWO}, {paths_sql()} SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, round(sum(a.p * c.p / z.p) / 2, 6) AS betweenness FROM tw e JOIN lv a ON a.n = e.src JOIN lv c ON c.s = e.dst JOIN lv z ON z.s = a.s AND z.n = c.n AND z.k = a.k + 1 + c.k GROUP BY ALL")
def edge_betweenness(t: Tables) -> DataFrame:
    """L3: shortest paths through each strong link (the SQL counts them by pairs of ends instead)."""
    return gr.edge_betweenness(gr.cut(strong(t))).withColumn("betweenness", F.round("betweenness", 6))


@query()
def girvan_newman_split(t: Tables) -> DataFrame:
    """L4: the best partition of the strongest links (sequential removals: rows only, held against known values in tests)."""
    edges = gr.project(participation(t), "g", "n", 50, 31).select(F.lit(0).cast("long").alias("graph"), "src", "dst")
    found = gr.girvan_newman(edges)
    w = Window.partitionBy("graph").orderBy(F.desc(F.round("modularity", 9)), "parts")
    return found.withColumn("_r", F.rank().over(w)).filter("_r = 1").select("node", "label", "parts", F.round("modularity", 6).alias("modularity"))


STEPS = 5


def walk_sql() -> str:
    parts = ["nb AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i, count(*) OVER (PARTITION BY src) AS d FROM tw)", "w0 AS (SELECT DISTINCT src AS walk, src AS place FROM tw)"]
    for s in range(1, STEPS + 1):
        parts.append(f"w{s} AS (SELECT walk, dst AS place FROM w{s - 1} JOIN nb ON src = place AND i = {sql_hash('walk', s)} % d)")
    return ", ".join(parts) + ", wk AS (" + " UNION ALL ".join(f"SELECT walk, {s} AS step, place FROM w{s}" for s in range(STEPS + 1)) + ")"


def walks(edges: DataFrame) -> DataFrame:
    """walk, step, place: a walk from each node, its choices by hash of (walk, step)."""
    two = gr.both_ways(gr.cut(edges))
    w = Window.partitionBy("src").orderBy("dst")
    nb = gr.cut(two.select("src", "dst", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("src")).alias("d")))
    at = nb.select(F.col("src").alias("walk"), F.col("src").alias("place")).distinct()
    out = at.select("walk", F.lit(0).alias("step"), "place")
    degree = nb.select("src", "d").distinct()
    for s in range(1, STEPS + 1):
        chosen = at.join(degree.withColumnRenamed("src", "place"), "place").select("walk", F.col("place").alias("src"), (portable_hash(F.col("walk"), s) % F.col("d")).alias("i"))
        at = chosen.join(nb, ["src", "i"]).select("walk", F.col("dst").alias("place"))
        out = out.unionByName(at.select("walk", F.lit(s).alias("step"), "place"))
    return out


@query(f"WITH {COPART}, {TWO}, {walk_sql()} SELECT walk, CAST(step AS INT) AS step, place FROM wk")
def deepwalk_walks(t: Tables) -> DataFrame:
    """E3 (p = q = 1): walks over the links."""
    return walks(shared_orders(t))


@query(f"WITH {COPART}, {TWO}, {walk_sql()} SELECT x.place AS center, y.place AS context, count(*) AS n FROM wk x JOIN wk y ON x.walk = y.walk AND x.step <> y.step AND abs(x.step - y.step) <= 2 GROUP BY ALL")
def context_pairs(t: Tables) -> DataFrame:
    """Nodes within two steps of each other on a walk."""
    w = gr.cut(walks(shared_orders(t)))
    other = w.select("walk", F.col("step").alias("s2"), F.col("place").alias("context"))
    return w.join(other, "walk").filter((F.col("step") != F.col("s2")) & (F.abs(F.col("step") - F.col("s2")) <= 2)).groupBy(F.col("place").alias("center"), "context").agg(F.count("*").alias("n"))


@query()
def walk_embedding(t: Tables) -> DataFrame:
    """E5: Word2Vec over walks on the whole graph (hierarchical softmax, not negative sampling; rows only)."""
    made = walks(shared_orders(t)).groupBy("walk").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "place"))), lambda s: s["place"].cast("string")).alias("nodes"))
    return Word2Vec(vectorSize=8, minCount=0, seed=7, inputCol="nodes", outputCol="v").fit(made).getVectors()


@query()
def spectral_clusters(t: Tables) -> DataFrame:
    """Power iteration clustering of the whole weighted graph (MLlib; rows only)."""
    return PowerIterationClustering(k=4, maxIter=10, weightCol="weight").assignClusters(shared_orders(t).select("src", "dst", "weight"))


@query(f"WITH {COPART}, d AS (SELECT src AS n, count(*) AS d FROM (SELECT src FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1), z AS (SELECT d, count(*) AS c FROM d GROUP BY 1) SELECT round(regr_slope(ln(c), ln(d)), 5) AS exponent, count(*) AS points FROM z")
def degree_exponent(t: Tables) -> DataFrame:
    """Slope of the log-log degree distribution."""
    z = gr.degrees(shared_orders(t)).groupBy("degree").agg(F.count("*").alias("c"))
    return z.agg(F.round(F.regr_slope(F.log("c"), F.log("degree")), 5).alias("exponent"), F.count("*").alias("points"))


@query()
def pagerank_convergence(t: Tables) -> DataFrame:
    """Change of the ranks by round until it is under 1e-6 (sequential: held against known ranks in tests)."""
    e, history = gr.cut(contests(t)), []
    gr.pagerank(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), 0.5, 100, tolerance=1e-6, history=history)
    return t.spark.createDataFrame([(i + 1, x) for i, x in enumerate(history)], "round int, change double")


@query(f"WITH {LW}, {NODES}, {pagerank_sql(0.85, 8)}, x AS (SELECT n, s_nationkey AS nation, round(rank, 8) AS rank FROM r8 JOIN supplier ON s_suppkey = n) SELECT n AS node, nation, round(percent_rank() OVER (PARTITION BY nation ORDER BY rank), 6) AS percentile FROM x")
def rank_percentile_by_nation(t: Tables) -> DataFrame:
    """Percentile of each supplier's PageRank among those of its nation."""
    placed = ranked(t, 0.85, 8).join(t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("nation")), "node")
    within = Window.partitionBy("nation").orderBy(F.round("rank", 8))
    return placed.select("node", "nation", F.round(F.percent_rank().over(within), 6).alias("percentile"))


@query(f"WITH {LW}, nd AS (SELECT src AS n FROM lw UNION SELECT dst FROM lw), ps AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM nd) SELECT x.i AS source, y.i AS target, src, dst, weight FROM lw JOIN ps x ON x.n = src JOIN ps y ON y.n = dst")
def export_edges(t: Tables) -> DataFrame:
    """Links with the positions of their nodes in the order of ids, as array formats want them."""
    e = gr.cut(contests(t))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("at", F.col("node").cast("double"))
    place = gr.cut(range_ranks(nodes, "at", "node").select("node", (F.col("rank") - 1).alias("i")))
    side = lambda end, name: place.select(F.col("node").alias(end), F.col("i").alias(name))
    return e.join(side("src", "source"), "src").join(side("dst", "target"), "dst").select("source", "target", "src", "dst", "weight")


@query(f"WITH {LW} SELECT src, dst, contests FROM lw WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def induced_subgraph(t: Tables) -> DataFrame:
    """Contests between suppliers of the first five nations."""
    return gr.induced(contests(t), t.supplier.filter("s_nationkey < 5").select(F.col("s_suppkey").alias("node"))).select("src", "dst", "contests")


@query()
def adjacency_svd(t: Tables) -> DataFrame:
    """Eight singular directions of the normalised adjacency of the whole graph (iterative: held against numpy in tests)."""
    rows, _, _ = sp.truncated_svd(sp.normalized_adjacency(shared_orders(t)), 8)
    return rows.select(F.col("row").alias("node"), "vector")


@query()
def market_svd(t: Tables) -> DataFrame:
    """The first two directions of the loser to winner matrix; the first are its hubs and authorities (as tests hold)."""
    lost, won, _ = sp.truncated_svd(contests(t).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")), 2, 12)
    side = lambda df, key, name: df.select(F.col(key).alias("node"), F.col("vector").alias(name))
    return side(lost, "row", "as_loser").join(side(won, "col", "as_winner"), "node", "outer")
