"""Vector search, clustering and anomaly queries over embeddings and supplier features."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import portable_hash, sql_hash
from quarry.operators import graphs as gr
from quarry.operators import vectors as vc
from quarry.operators.relational import range_ranks
from quarry.plans.eda import supplier_features
from quarry.plans.registry import SQL, Tables, query

V = "(SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def knn_sql(queries: str, k: int) -> str:
    return f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place FROM (SELECT q.k AS query, r.k AS neighbour, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM {V} q JOIN {V} r ON q.k <> r.k WHERE {queries})) WHERE place <= {k})"


@query(f"WITH {knn_sql('q.k % 50 = 0', 10)} SELECT query, neighbour, score, CAST(place AS INT) AS place FROM nn")
def knn_exact(t: Tables) -> DataFrame:
    """The ten nearest of all rows for every query (ids divisible by 50)."""
    return vc.nearest(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", 10)


@query(f"WITH {knn_sql('true', 5)} SELECT DISTINCT least(query, neighbour) AS src, greatest(query, neighbour) AS dst FROM nn")
def knn_graph(t: Tables) -> DataFrame:
    """The graph of five nearest neighbours, either way."""
    found = vc.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 5)
    return found.select(F.least("query", "neighbour").alias("src"), F.greatest("query", "neighbour").alias("dst")).distinct()


NLIST, NPROBE = 16, 8
CELLS = f"c AS (SELECT k, row_number() OVER (ORDER BY {sql_hash('k', 11)}, k) - 1 AS cell, v FROM {V} ORDER BY {sql_hash('k', 11)}, k LIMIT {NLIST})"
IVF = f"""{CELLS}, d AS (SELECT r.k, c.cell, round(list_sum(list_transform(range(1, 65), lambda i: (r.v[i] - c.v[i]) ** 2)), 9) AS d FROM {V} r, c), a AS (SELECT k, cell FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, cell) AS r FROM d) WHERE r = 1),
p AS (SELECT k, cell FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, cell) AS r FROM d) WHERE r <= {NPROBE} AND k % 50 = 0),
iv AS (SELECT query, neighbour, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place FROM (SELECT q.k AS query, r.k AS neighbour, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM p JOIN {V} q USING (k) JOIN a ON a.cell = p.cell JOIN {V} r ON r.k = a.k AND r.k <> q.k)) WHERE place <= 10)"""


def centroids(t: Tables) -> list[tuple[int, list[float]]]:
    """NLIST rows with the smallest hashes: a bounded sample that the index is fitted on."""
    rows = t.embeddings.orderBy(portable_hash(F.col("vec_id"), 11), "vec_id").limit(NLIST).select("embedding").collect()
    return [(i, [float(x) for x in r[0]]) for i, r in enumerate(rows)]


@query(f"WITH {IVF} SELECT query, neighbour, score, CAST(place AS INT) AS place FROM iv")
def ivf_probe(t: Tables) -> DataFrame:
    """Inverted file with NLIST cells, the NPROBE nearest probed; every row is indexed."""
    return vc.probe_cells(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", centroids(t), NPROBE, 10)


@query(f"WITH {knn_sql('q.k % 50 = 0', 10)}, {IVF} SELECT count(*) AS n, round(count(iv.query) / count(*), 6) AS recall FROM nn LEFT JOIN iv ON nn.query = iv.query AND nn.neighbour = iv.neighbour")
def ivf_recall(t: Tables) -> DataFrame:
    """Share of the exact neighbours that the index finds."""
    found = ivf_probe(t).select("query", "neighbour", F.lit(1).alias("hit"))
    return knn_exact(t).join(found, ["query", "neighbour"], "left").agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query()
def ivf_kmeans(t: Tables) -> DataFrame:
    """Inverted file with cells by k-means on a sample, and as many probes as that sample needs for a recall of 0.95
    (floating-point rounds: held against brute force in tests)."""
    centres, probes = vc.fit_cells(t.embeddings, "vec_id", "embedding", 10)
    return vc.probe_fitted(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", centres, probes, 10)


FEATURES = ["participations", "amount", "mean_amount", "lines", "wins", "customer_hhi"]


@query("WITH f AS (" + SQL["supplier_features"] + ") SELECT l_suppkey, " + ", ".join(f"round((ln(1 + {c}) - avg(ln(1 + {c})) OVER ()) / stddev_samp(ln(1 + {c})) OVER (), 4) AS z_{c}" for c in FEATURES) + " FROM f")
def zscore_features(t: Tables) -> DataFrame:
    """Standardised log features."""
    f = supplier_features(t).select("l_suppkey", *[F.log1p(c).alias(c) for c in FEATURES])
    m = f.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"s_{c}") for c in FEATURES])
    return f.crossJoin(F.broadcast(m)).select("l_suppkey", *[F.round((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 4).alias(f"z_{c}") for c in FEATURES])


@query()
def pca_components(t: Tables) -> DataFrame:
    """Share of variance by principal component (MLlib; rows only)."""
    f = supplier_features(t).select(*[F.log1p(c).alias(c) for c in FEATURES])
    made = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(f)
    scaled = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(made).transform(made)
    shares = PCA(k=4, inputCol="z", outputCol="p").fit(scaled).explainedVariance.toArray().tolist()
    return t.spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(shares)], "component int, share double")


ROUNDS, K = 3, 4


def km_sql() -> str:
    dist = "list_sum(list_transform(range(1, 65), lambda i: (r.v[i] - c.v[i]) ** 2))"
    parts = [f"c0 AS (SELECT k AS cell, v FROM {V} WHERE k < {K})"]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS (SELECT k, cell, d, v FROM (SELECT r.k, c.cell, r.v, round({dist}, 9) AS d, row_number() OVER (PARTITION BY r.k ORDER BY round({dist}, 9), c.cell) AS n FROM {V} r, c{i} c) WHERE n = 1)")
        parts.append(f"c{i + 1} AS (SELECT cell, list(m ORDER BY i) AS v FROM (SELECT cell, i, avg(v[i]) AS m FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY cell)")
    parts.append(f"af AS (SELECT k, cell, d, v FROM (SELECT r.k, c.cell, r.v, round({dist}, 9) AS d, row_number() OVER (PARTITION BY r.k ORDER BY round({dist}, 9), c.cell) AS n FROM {V} r, c{ROUNDS} c) WHERE n = 1)")
    return ", ".join(parts)


def clustered(t: Tables) -> DataFrame:
    start = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in t.embeddings.filter(f"vec_id < {K}").orderBy("vec_id").select("vec_id", "embedding").collect()]
    return vc.assign(t.embeddings, "embedding", vc.kmeans(t.embeddings, "embedding", start, ROUNDS))


@query(f"WITH {km_sql()} SELECT k AS vec_id, CAST(cell AS BIGINT) AS cell, round(d, 5) AS distance2 FROM af")
def kmeans_fixed_init(t: Tables) -> DataFrame:
    """Three Lloyd rounds from given centroids."""
    return clustered(t).select("vec_id", F.col("cell").cast("long").alias("cell"), F.round("distance2", 5).alias("distance2"))


@query(f"WITH {km_sql()} SELECT CAST(cell AS BIGINT) AS cell, count(*) AS n, round(sum(d), 4) AS sse, quantile_disc(round(d, 5), 0.5) AS median_d2, round(sqrt(max(d)), 5) AS radius FROM af GROUP BY cell")
def cluster_profiles(t: Tables) -> DataFrame:
    """Size, inertia, median and radius of each cluster."""
    c = clustered(t).groupBy(F.col("cell").cast("long").alias("cell"))
    return c.agg(F.count("*").alias("n"), F.round(F.sum("distance2"), 4).alias("sse"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY round(distance2, 5))").alias("median_d2"), F.round(F.sqrt(F.max("distance2")), 5).alias("radius"))


@query(f"""WITH d AS (SELECT x.k, x.label, y.label AS other, sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) ** 2))) AS d FROM {V} x, {V} y), s AS (SELECT k, label, other, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL),
z AS (SELECT k, label, max(CASE WHEN other = label THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b, max(CASE WHEN other = label THEN n END) AS n FROM s GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM z GROUP BY label""")
def silhouette(t: Tables) -> DataFrame:
    """Mean silhouette of each label."""
    return vc.silhouette(t.embeddings, "vec_id", "embedding", "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 5).alias("silhouette"))


@query(f"""WITH d AS (SELECT x.k, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) ** 2))), 6) AS d, y.k AS o FROM {V} x JOIN {V} y ON x.k <> y.k), r AS (SELECT k, d FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, o) AS r FROM d) WHERE r = 4),
s AS (SELECT d, row_number() OVER (ORDER BY d, k) - 1 AS i, count(*) OVER () AS n, min(d) OVER () AS lo, max(d) OVER () AS hi FROM r), h AS (SELECT *, abs(i / (n - 1) - (d - lo) / (hi - lo)) AS h FROM s)
SELECT n, round(lo, 5) AS lowest, round(hi, 5) AS highest, round(max_by(d, h), 5) AS elbow FROM h GROUP BY n, lo, hi""")
def k_distance_elbow(t: Tables) -> DataFrame:
    """C11, V5: fourth-neighbour distances, and the one furthest from the chord."""
    d = vc.nearest(t.embeddings, t.embeddings, "vec_id", "embedding", 4, "l2").filter("place = 4").select("query", "score")
    bounds = d.agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))
    ranked = range_ranks(d, "score", "query").crossJoin(F.broadcast(bounds))
    height = F.abs((F.col("rank") - 1) / (F.col("n") - 1) - (F.col("score") - F.col("lowest")) / (F.col("highest") - F.col("lowest")))
    return ranked.groupBy("n", F.round("lowest", 5).alias("lowest"), F.round("highest", 5).alias("highest")).agg(F.round(F.max_by("score", height), 5).alias("elbow"))


EPS, MIN_PTS = 0.75, 4
NEAR = f"nb AS (SELECT x.k AS a, y.k AS b FROM {V} x JOIN {V} y ON x.k <> y.k WHERE round(list_cosine_similarity(x.v, y.v), 6) >= {EPS}), core AS (SELECT a FROM nb GROUP BY a HAVING count(*) + 1 >= {MIN_PTS})"


def density(t: Tables) -> DataFrame:
    """vec_id, cluster (smallest core; -1 for noise) by cosine of EPS or more."""
    return vc.density_clusters(t.embeddings, "vec_id", "embedding", EPS, MIN_PTS)


DBSCAN = f"""{NEAR}, ce AS (SELECT a, b FROM nb WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), reach AS (SELECT a AS node, a AS root FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1), cl AS (SELECT k AS vec_id, coalesce(c, (SELECT min(x.c) FROM nb JOIN comp x ON x.node = nb.b WHERE nb.a = k), -1) AS cluster FROM {V} LEFT JOIN comp ON node = k)"""


@query(f"WITH RECURSIVE {DBSCAN} SELECT vec_id, cluster FROM cl")
def dbscan(t: Tables) -> DataFrame:
    """Density clusters; a border point joins its smallest core's cluster."""
    return density(t)


@query(f"""WITH RECURSIVE {DBSCAN}, {km_sql()}, q AS (SELECT cell, quantile_cont(sqrt(d), 0.95) AS q FROM af GROUP BY 1)
SELECT af.k AS vec_id, CAST(af.cell AS BIGINT) AS cell, round(sqrt(d), 5) AS distance FROM af JOIN q USING (cell) JOIN cl ON cl.vec_id = af.k WHERE cluster = -1 AND round(sqrt(d), 9) >= round(q, 9)""")
def anomaly_tail(t: Tables) -> DataFrame:
    """C14: noise that is also in the furthest 5 percent of its k-means cell."""
    c = clustered(t).select("vec_id", F.col("cell").cast("long").alias("cell"), F.sqrt("distance2").alias("distance"))
    far = c.groupBy("cell").agg(F.percentile("distance", F.lit(0.95)).alias("q"))
    return c.join(far, "cell").join(density(t).filter("cluster = -1"), "vec_id").filter(F.round("distance", 9) >= F.round("q", 9)).select("vec_id", "cell", F.round("distance", 5).alias("distance"))


NEARS, TAILS = (0.35, 0.5, 0.75), (0.99, 0.95, 0.9)  # each setting's anomalies are among the next one's


def grid_sql() -> str:
    noise = ", ".join(
        f"nb{i} AS (SELECT x.k AS a, y.k AS b FROM {V} x JOIN {V} y ON x.k <> y.k WHERE round(list_cosine_similarity(x.v, y.v), 6) >= {eps}), co{i} AS (SELECT a FROM nb{i} GROUP BY a HAVING count(*) + 1 >= {MIN_PTS}), no{i} AS (SELECT k FROM {V} WHERE k NOT IN (SELECT a FROM co{i}) AND k NOT IN (SELECT a FROM nb{i} WHERE b IN (SELECT a FROM co{i})))"
        for i, eps in enumerate(NEARS)
    )
    far = ", ".join(f"quantile_cont(sqrt(d), {q}) AS q{j}" for j, q in enumerate(TAILS))
    flags = ", ".join([f"k IN (SELECT k FROM no{i}) AS n{i}" for i in range(3)] + [f"round(sqrt(d), 9) >= round(q{j}, 9) AS d{j}" for j in range(3)])
    cells = " UNION ALL ".join(f"SELECT {e} AS eps, {q} AS quantile, count(*) FILTER (WHERE n{i} AND d{j}) AS anomalies, count(*) FILTER (WHERE n{i} AND d{j} AND NOT (n{min(i + 1, 2)} AND d{min(j + 1, 2)})) AS not_nested FROM fl" for i, e in enumerate(NEARS) for j, q in enumerate(TAILS))
    return f"WITH {km_sql()}, {noise}, far AS (SELECT cell, {far} FROM af GROUP BY 1), fl AS (SELECT {flags} FROM af JOIN far USING (cell)) SELECT CAST(eps AS DOUBLE) AS eps, CAST(quantile AS DOUBLE) AS quantile, anomalies, not_nested FROM ({cells})"


@query(grid_sql())
def anomaly_grid(t: Tables) -> DataFrame:
    """Anomalies by eps and quantile, and how many of them the next looser setting loses (none: the sets are nested)."""
    c = clustered(t).select("vec_id", "cell", F.sqrt("distance2").alias("distance"))
    far = c.groupBy("cell").agg(F.percentile("distance", F.lit(list(TAILS))).alias("q"))
    flags = c.join(far, "cell").select("vec_id", *[(F.round("distance", 9) >= F.round(F.col("q")[j], 9)).alias(f"d{j}") for j in range(3)])
    flags = flags.join(vc.noise(t.embeddings, "vec_id", "embedding", NEARS, MIN_PTS), "vec_id")
    hit = lambda i, j: F.col(f"n{min(i, 2)}") & F.col(f"d{min(j, 2)}")
    grid = [(i, j) for i in range(3) for j in range(3)]
    sums = flags.agg(*[F.count_if(hit(i, j)).alias(f"a{i}{j}") for i, j in grid], *[F.count_if(hit(i, j) & ~hit(i + 1, j + 1)).alias(f"l{i}{j}") for i, j in grid])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(NEARS[i]).alias("eps"), F.lit(TAILS[j]).alias("quantile"), F.col(f"a{i}{j}").alias("anomalies"), F.col(f"l{i}{j}").alias("not_nested")) for i, j in grid])))


@query(f"""WITH {km_sql()}, n AS (SELECT label AS a, cell AS b, count(*) AS n FROM af JOIN embeddings ON vec_id = k GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS bo FROM n), ra AS (SELECT a, sum(n) AS na FROM n GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM n GROUP BY 1),
mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM n JOIN ra USING (a) JOIN rb USING (b), t), ha AS (SELECT sum(-na / t * ln(na / t)) AS ha, sum(na * (na - 1) / 2) AS pa FROM ra, t), hb AS (SELECT sum(-nb / t * ln(nb / t)) AS hb, sum(nb * (nb - 1) / 2) AS pb FROM rb, t)
SELECT round((bo - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 5) AS ari, round(mi / ((ha + hb) / 2), 5) AS nmi FROM t, mi, ha, hb""")
def ari_nmi(t: Tables) -> DataFrame:
    """Agreement of the k-means cells with the given labels."""
    both = clustered(t).select("label", "cell")
    return gr.partition_agreement(both, "label", "cell").select(F.round("ari", 5).alias("ari"), F.round("nmi", 5).alias("nmi"))


@query()
def kmeans_mllib(t: Tables) -> DataFrame:
    """MLlib k-means and bisecting k-means with their silhouettes (squared Euclidean; rows only)."""
    v = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    rows = []
    for name, kind in (("kmeans", KMeans), ("bisecting", BisectingKMeans)):
        model = kind(k=K, seed=7, maxIter=10).fit(v)
        rows.append((name, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(v)))))
    return t.spark.createDataFrame(rows, "method string, cost double, silhouette double")


@query()
def svd_embedding(t: Tables) -> DataFrame:
    """A rank-8 projection of the given embeddings (MLlib PCA; rows only). It reads no text and no graph."""
    v = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return PCA(k=8, inputCol="features", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("projected"))


HELD = f"""kg AS (SELECT DISTINCT least(query, neighbour) AS src, greatest(query, neighbour) AS dst FROM nn), hd AS (SELECT *, {sql_hash("src || '-' || dst", 21)} % 10 = 0 AS held FROM kg),
nd AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM (SELECT src AS n FROM kg UNION SELECT dst FROM kg)),
ng AS (SELECT DISTINCT least(src, n) AS src, greatest(src, n) AS dst FROM hd JOIN nd ON i = {sql_hash("src || '-' || dst", 22)} % c WHERE held AND src <> n AND (least(src, n), greatest(src, n)) NOT IN (SELECT (src, dst) FROM kg)),
tw AS (SELECT src, dst FROM hd WHERE NOT held UNION ALL SELECT dst, src FROM hd WHERE NOT held), dg AS (SELECT src, count(*) AS d FROM tw GROUP BY 1),
aa AS (SELECT x.dst AS src, y.dst AS dst, round(sum(1 / ln(greatest(d, 2))), 6) AS s FROM tw x JOIN tw y ON x.src = y.src AND x.dst < y.dst JOIN dg ON dg.src = x.src GROUP BY ALL),
sc AS (SELECT pos, coalesce(s, 0) AS s FROM (SELECT src, dst, true AS pos FROM hd WHERE held UNION ALL SELECT src, dst, false FROM ng) LEFT JOIN aa USING (src, dst)),
rk AS (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM sc)"""


@query(f"WITH {knn_sql('true', 5)}, {HELD}, c AS (SELECT count(*) FILTER (WHERE pos) AS pos, count(*) FILTER (WHERE NOT pos) AS neg, sum(r) FILTER (WHERE pos) AS s FROM rk) SELECT pos, neg, round((s - pos * (pos + 1) / 2) / nullif(pos * neg, 0), 6) AS auc FROM c")
def holdout_link_auc(t: Tables) -> DataFrame:
    """A tenth of the neighbour graph's links is held out, each with a node drawn by hash that its first end isn't linked to; Adamic-Adar on the rest must tell them apart."""
    graph = gr.cut(knn_graph(t))
    name = F.concat_ws("-", "src", "dst")
    marked = gr.cut(graph.select("src", "dst", (portable_hash(name, 21) % 10 == 0).alias("held"), portable_hash(name, 22).alias("draw")))
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("at", F.col("node").cast("double"))
    places = gr.cut(range_ranks(nodes, "at", "node").select("node", (F.col("rank") - 1).alias("i")))
    total = places.agg(F.count("*").alias("c"))
    drawn = marked.filter("held").crossJoin(F.broadcast(total)).select("src", (F.col("draw") % F.col("c")).alias("i")).join(places, "i").filter("src <> node")
    negative = drawn.select(F.least("src", "node").alias("src"), F.greatest("src", "node").alias("dst")).distinct().join(graph, ["src", "dst"], "left_anti")
    asked = marked.filter("held").select("src", "dst", F.lit(True).alias("link")).unionByName(negative.withColumn("link", F.lit(False)))
    scores = gr.link_scores(marked.filter("not held").select("src", "dst")).select("src", "dst", F.round("adamic_adar", 6).alias("s"))
    scored = asked.join(scores, ["src", "dst"], "left").na.fill(0.0, ["s"])
    return gr.auc(scored, "s", "link").withColumn("auc", F.round("auc", 6))
