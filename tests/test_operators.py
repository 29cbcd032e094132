from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.functions import hashing, text
from quarry.operators import graphs, patterns, recommend, relational, resolution, sketches, spectral, vectors
from quarry.operators import similarity as sm
from quarry.plans import catalog
from quarry.session import plan_facts
from quarry.sources import files


def test_gini_and_hhi(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 2.0), ("b", 6.0)], "g string, v double")
    got = {r["g"]: r["gini"] for r in relational.gini(df, ["g"], "v").collect()}
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(0.25)
    pairs = spark.createDataFrame([("k", "x", 1.0), ("k", "y", 3.0)], "k string, p string, m double")
    row = relational.hhi(pairs, "k", "p", "m").first()
    assert row["hhi"] == pytest.approx(0.625) and row["top_share"] == pytest.approx(0.75)


def test_impute_null_group_takes_overall_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, None), (None, 9.0), ("b", 5.0)], "g string, v double")
    got = {(r["g"], r["imputed"]): r["v"] for r in relational.impute_group_median(df, "g", "v").collect()}
    assert got["a", True] == 1.0 and got[None, True] == 5.0


def test_text(spark):
    df = spark.createDataFrame([("  Perú   S.A.C. ", "20123456789"), ("x, Inc", "123456"), (None, None)], "n string, c string")
    rows = df.select(text.legal_name(F.col("n")).alias("n"), text.id_kind(F.col("c")).alias("k"), text.digits_only(F.col("c")).alias("d")).collect()
    assert [r["n"] for r in rows] == ["PERU", "X", None]
    names = {"Perú S.A.C.": "PERU", "PERU SAC": "PERU", "peru s a c": "PERU", "Andes S.A.": "ANDES", "Sur, S. R. L.": "SUR", "Losa Cabrera": "LOSA CABRERA", "Sacos SA": "SACOS", "Sociedad Anónima Andina": "ANDINA"}
    made = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.legal_name(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in made} == names
    assert [r["k"] for r in rows] == ["company", "local", "foreign"]
    assert rows[0]["d"] == 20123456789 and rows[2]["d"] is None


def test_bloom_has_no_false_negatives_and_cms_no_underestimates(spark):
    keys = spark.range(500).withColumnRenamed("id", "k")
    bits, hashes = sketches.bloom_size(500, 0.01)
    built = sketches.bloom_build(keys, "k", bits, hashes)
    assert sketches.bloom_probe(keys, "k", built, bits, hashes).filter("not maybe").count() == 0
    others = spark.range(10_000, 12_000).withColumnRenamed("id", "k")
    assert sketches.bloom_probe(others, "k", built, bits, hashes).filter("maybe").count() < 60
    many = keys.union(keys.filter("k < 10"))
    found = sketches.cms_estimate(many, "k", sketches.cms_build(many, "k", 64, 4), 64, 4)
    assert found.filter("estimate < if(k < 10, 2, 1)").count() == 0


def test_sizes_follow_the_keys(spark):
    for n in (300, 3000):  # the formula holds for many keys: a filter of ten bits is coarser
        keys, others = spark.range(n).withColumnRenamed("id", "k"), spark.range(10_000, 12_000).withColumnRenamed("id", "k")
        size, width = sketches.bloom_size(n, 0.01), sketches.cms_width(n, 0.01, 4)
        assert sketches.bloom_probe(others, "k", sketches.bloom_build(keys, "k", *size), *size).filter("maybe").count() < 60
        assert sketches.cms_estimate(others, "k", sketches.cms_build(keys, "k", width, 4), width, 4).filter("estimate > 0").count() < 60
    assert sketches.bloom_size(0, 0.01) == sketches.bloom_size(1, 0.01) and sketches.cms_width(0, 0.01, 4) == 3


def test_dgim_error_bound():
    for density in (1, 2, 5):
        d, bits = sketches.Dgim(100), []
        for i in range(1000):
            bit = i % density == 0
            bits.append(bit)
            d.add(bit)
            exact = sum(bits[-100:])
            assert abs(d.estimate() - exact) <= 0.5 * exact + 1
        assert sum(map(len, d.levels)) <= 2 * (math.log2(100) + 2)


def test_apriori_and_rules(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "b")]
    found = patterns.apriori(spark.createDataFrame(rows, "k int, i string"), "k", "i", 0.25, 3)
    assert {tuple(r["items"]): r["n"] for r in found.collect()} == {("a",): 3, ("b",): 3, ("c",): 2, ("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 1, ("a", "b", "c"): 1}
    rule = {(tuple(r["antecedent"]), tuple(r["consequent"])): r for r in patterns.rules(found, 0.5).collect()}
    assert rule[("c",), ("a",)]["confidence"] == 1.0 and rule[("c",), ("a",)]["lift"] == pytest.approx(1.333)


def test_cardinality_stays_in_its_bound(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 20_011).alias("a"), (F.col("id") % 300).cast("string").alias("b"), F.lit(1).alias("c"), F.array("id").alias("d"))
    got = {r["column_name"]: r["approx_distinct"] for r in relational.profile_cardinality(df, 0.02).collect()}
    true = {"a": 20_011, "b": 300, "c": 1}
    assert set(got) == set(true) and all(abs(got[c] - n) <= 0.08 * n for c, n in true.items())  # four standard deviations


def test_numbers_are_gapless(spark):
    names = [f"n{i % 400}" for i in range(1000)] + [None]
    got = relational.numbered(spark.createDataFrame([(n,) for n in names], "x string"), "x", 7).collect()
    assert sorted(r["number"] for r in got) == list(range(401)) and len({r["x"] for r in got}) == 401


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abce", "")], "a string, b string, e string")
    s = lambda c: sm.char_shingles(F.col(c), 3)
    row = df.select(s("a").alias("x"), sm.jaccard(s("a"), s("b")).alias("j"), sm.jaccard(F.array(), F.array()).alias("z"), s("e").alias("e")).first()
    assert row["x"] == ["abc", "bcd"] and row["j"] == pytest.approx(1 / 3) and row["z"] == 1.0 and row["e"] == [""]


def test_pagerank_golden(spark):
    edges = lambda rows: spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src long, dst long, weight double")
    nodes = lambda n: spark.range(n).withColumnRenamed("id", "node")
    assert all(r["rank"] == pytest.approx(1 / 3) for r in graphs.pagerank(edges([(0, 1), (1, 2), (2, 0)]), nodes(3), 0.85, 5).collect())
    got = {r["node"]: r["rank"] for r in graphs.pagerank(edges([(0, 1)]), nodes(2), 0.8, 30).collect()}
    assert got[0] == pytest.approx(5 / 14, abs=1e-6) and got[1] == pytest.approx(9 / 14, abs=1e-6)
    star = {r["node"]: r["authority"] for r in graphs.hits(edges([(0, 1), (0, 2)]), 5).collect()}
    assert star[0] == 0 and star[1] == pytest.approx(1 / math.sqrt(2))


def test_components_modularity_and_agreement(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    nodes = spark.range(7).withColumnRenamed("id", "node")
    assert {r["node"]: r["component"] for r in graphs.connected_components(edges, nodes).collect()} == {**dict.fromkeys(range(6), 0), 6: 6}
    labels = nodes.filter("node < 6").withColumn("label", (F.col("node") >= 3).cast("int"))
    assert graphs.modularity(edges, labels).first()["modularity"] == pytest.approx(6 / 7 - 0.5)
    same = graphs.partition_agreement(labels.withColumn("other", 9 - F.col("label")), "label", "other").first()
    assert same["ari"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)


#: Zachary's karate club: neighbours of larger number. Fixed values.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32],
    3: [7, 12, 13], 4: [6, 10], 5: [6, 10, 16], 6: [16], 8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33],
    19: [33], 20: [32, 33], 22: [32, 33], 23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33], 27: [33], 28: [31, 33],
    29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33],
}


def test_betweenness_and_girvan_newman_golden(spark):
    edges = [(a, b) for a, bs in KARATE.items() for b in bs]
    assert len(edges) == 78
    df = spark.createDataFrame([(0, a, b, 1.0) for a, b in edges], "graph long, src long, dst long, weight double")
    got = {(r["src"], r["dst"]): r["betweenness"] for r in graphs.edge_betweenness(df).collect()}
    assert max(got, key=got.get) == (0, 31) and got[0, 31] == pytest.approx(71.3929, abs=1e-4) and len(got) == 78
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(34)}
    assert graphs.betweenness_of(near) == pytest.approx(got)
    best = graphs.girvan_newman(df).orderBy(F.desc("modularity")).first()
    assert best["parts"] == 5 and best["modularity"] == pytest.approx(0.4013, abs=1e-4)


def test_betweenness_of_no_edges(spark):
    none = spark.createDataFrame([], "graph long, src long, dst long, weight double")
    assert graphs.edge_betweenness(none).count() == 0 and graphs.girvan_newman(none).count() == 0


def test_fuzzy_pairs_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    parts = {(r[0], r[1]) for r in spark.read.parquet(f"{folder}/part.parquet").select("p_brand", "p_name").collect()}
    sets = {}
    for brand, name in parts:
        t = " ".join(sorted(name.split(" ")))
        mark = sorted(re.findall(r"[0-9]+|\b[IVX]+\b", name))
        sets[f"{brand}-{name}"] = (brand, mark, {t[i : i + 3] for i in range(max(1, len(t) - 2))})
    want = {}
    for a, (brand, mark, x) in sets.items():
        for b, (brand_b, mark_b, y) in sets.items():
            if a < b and brand == brand_b and mark == mark_b and len(x & y) / len(x | y) >= 0.5:
                want[a, b] = round(len(x & y) / len(x | y), 6)
    got = catalog.queries()["fuzzy_pairs"](spark, folder).collect()
    assert want and {(r["a"], r["b"]): r["jaccard"] for r in got} == want
    odd = spark.createDataFrame([(1, "", "x"), (2, "", "x"), (3, "ab", "x"), (4, "b II", "x"), (5, "b III", "x"), (6, None, "x")], "k long, n string, g string")
    assert {(r["a"], r["b"]) for r in resolution.fuzzy_pairs(odd, "k", "n", "g", 0.85).collect()} == {(1, 2)}


def test_graph_queries_without_sql_read_links_of_two_orders(spark, tmp_path):
    rows = [(2 * a + k, s) for a in range(8) for k in range(2) for s in (a, (a + 1) % 8)] + [(99, 0), (99, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()
    assert {r["id"] for r in found["spectral_clusters"](spark, str(tmp_path)).collect()} == set(range(8))
    assert {r["word"] for r in found["walk_embedding"](spark, str(tmp_path)).collect()} == {str(s) for s in range(8)}


def test_paired_bootstrap(spark):
    each = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("d"))
    row = recommend.paired_bootstrap(each, "k", "d", 300).first()
    assert row["difference"] == 0.5 and 0.43 < row["low"] < 0.47 and 0.53 < row["high"] < 0.57


def test_ranking_metrics_golden(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "user int, item string, place int")
    row = recommend.ranking_metrics(found, spark.createDataFrame([(1, "b")], "user int, item string"), 2).first()
    assert row["precision"] == 0.5 and row["recall"] == 1.0 and row["ndcg"] == pytest.approx(1 / math.log2(3), abs=1e-6)


def test_nearest_and_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "k long, v array<double>")
    got = vectors.nearest(rows, rows, "k", "v", 2, "l2").filter("query = 10").orderBy("place").collect()
    assert [(r["neighbour"], r["score"]) for r in got] == [(9, 1.0), (11, 1.0)]


def test_noise_is_that_of_density_clusters(spark, monkeypatch):
    rnd = np.random.default_rng(10)
    points = rnd.normal(size=(500, 5))
    points[40:60], points[70], points[71], points[72:74] = points[40], 0, 0, points[74]  # copies, and zeros that are near nothing
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "k long, v array<double>")
    monkeypatch.setattr(vectors.bl, "blocks_for", lambda n, *_, **__: 5)
    monkeypatch.setattr(vectors.bl, "TILE", 50)
    got = {r["k"]: r[1:] for r in vectors.noise(df, "k", "v", (0.8, 0.95, 0.99), 4).collect()}
    unit = points / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None]
    cosine = np.round(unit @ unit.T, 6)
    np.fill_diagonal(cosine, -1)
    for e, eps in enumerate((0.8, 0.95, 0.99)):
        near = cosine >= eps
        core = near.sum(axis=1) + 1 >= 4
        want = ~core & ~(near & core).any(axis=1)
        assert 0 < want.sum() < 500 and [got[i][e] for i in range(500)] == want.tolist()


def test_anomaly_grid_makes_no_clusters(spark, monkeypatch):
    monkeypatch.setattr(vectors.gr, "connected_components", None)
    assert catalog.queries()["anomaly_grid"](spark, "/root/testdata/sf0.001").count() == 9


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(4)
    a = np.where(rng.random((30, 20)) < 0.3, rng.normal(size=(30, 20)), 0) + np.outer(np.linspace(1, 3, 30), np.linspace(2, 1, 20)) * (rng.random((30, 20)) < 0.5)
    entries = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, value double")
    rows, cols, values = spectral.truncated_svd(entries, 4, 30)
    left = np.zeros((30, 4))
    for r in rows.collect():
        left[r["row"]] = r["vector"]
    right = np.array([r["vector"] for r in sorted(cols.collect(), key=lambda r: r["col"])])
    true = np.linalg.svd(a, compute_uv=False)[:4]
    assert np.allclose(values[:3], true[:3], rtol=1e-4) and values[3] == pytest.approx(true[3], rel=0.03) and np.allclose(right.T @ right, np.eye(4), atol=1e-6) and np.allclose(left, a @ right, atol=1e-8)
    assert np.allclose(np.abs(left[:, 0]), np.abs(np.linalg.svd(a)[0][:, 0]) * true[0], rtol=1e-3, atol=1e-4)


def test_market_svd_leads_with_hubs_and_authorities(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0), (2, 3, 2.0), (4, 2, 1.0), (4, 3, 5.0), (3, 1, 1.0)], "src long, dst long, weight double")
    lost, won, _ = spectral.truncated_svd(edges.toDF("row", "col", "value"), 2, 20)
    found = {r["node"]: r for r in graphs.hits(edges, 30).collect()}
    first = {r["row"]: r["vector"][0] for r in lost.collect()}
    length = math.sqrt(sum(x * x for x in first.values()))
    assert all(abs(x) / length == pytest.approx(found[n]["hub"], abs=1e-5) for n, x in first.items())
    assert all(abs(r["vector"][0]) == pytest.approx(found[r["col"]]["authority"], abs=1e-5) for r in won.collect())


def test_pagerank_to_a_tolerance(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 1, 1.0), (1, 5, 1.0)], "src long, dst long, weight double")
    nodes, history = spark.range(1, 6).withColumnRenamed("id", "node"), []
    got = {r["node"]: r["rank"] for r in graphs.pagerank(edges, nodes, 0.5, 100, tolerance=1e-9, history=history).collect()}
    p = np.zeros((5, 5))
    for a, b in ((0, 1), (0, 4), (1, 2), (2, 0), (3, 0)):
        p[b, a] = 0.5 if a == 0 else 1.0
    p[:, 4] = 0.2  # a dead end
    want = np.linalg.solve(np.eye(5) - 0.5 * p, np.full(5, 0.1))
    assert [got[i + 1] for i in range(5)] == pytest.approx(want.tolist(), abs=1e-8) and history[-1] < 1e-9 <= history[-2]
    assert sorted(map(tuple, graphs.induced(edges, spark.range(1, 4).withColumnRenamed("id", "node")).select("src", "dst").collect())) == [(1, 2), (2, 3), (3, 1)]


def test_neighbours_equal_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [(u, f"i{i}", float(rnd.choice((0.0, 0.5, 1.0, 2.0, -1.0)))) for u in range(700) for i in rnd.choice(12, 4, replace=False)]
    monkeypatch.setattr(recommend, "USERS", 90)
    monkeypatch.setattr(recommend, "ITEMS", 5)
    got = {}
    for r in recommend.neighbours(spark.createDataFrame(rows, "user long, item string, rating double"), 3).collect():
        got.setdefault(r["user"], []).append((-r["cosine"], r["other"]))
    table, held = np.zeros((700, 12)), np.zeros((700, 12))
    for u, i, x in rows:
        table[u, int(i[1:])], held[u, int(i[1:])] = x, 1
    norm = np.sqrt((table**2).sum(axis=1))
    cosine = np.round(table @ table.T / np.maximum(np.outer(norm, norm), 1e-300), 9)
    for u in range(700):
        some = [(-cosine[u, v], v) for v in range(700) if v != u and norm[u] > 0 and norm[v] > 0 and held[u] @ held[v] > 0]
        mine, best = sorted(got.get(u, [])), sorted(some)[:3]
        assert [b for _, b in mine] == [b for _, b in best] and [a for a, _ in mine] == pytest.approx([a for a, _ in best], abs=2e-9)


def test_equal_baskets_are_compared_once(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    kinds = [[(f"i{i}", float(rnd.choice((0.7, 1.1, 1.4)))) for i in rnd.choice(9, 3, replace=False)] for _ in range(30)]
    owner = [int(min(rnd.integers(30), rnd.integers(30))) for _ in range(400)]  # from one to many users of a basket
    train = spark.createDataFrame([(u, i, x) for u, kind in enumerate(owner) for i, x in kinds[kind]], "user long, item string, rating double")
    compared, run = [], recommend.bl.with_itself
    monkeypatch.setattr(recommend.bl, "with_itself", lambda rows, *a: compared.append(rows.count()) or run(rows, *a))
    monkeypatch.setattr(recommend, "USERS", 10)
    monkeypatch.setattr(recommend, "TILE", 4)
    reps, who = recommend.fold(train, 3)
    assert reps.select("user").distinct().count() == sum(min(5, owner.count(b)) for b in range(30)) and who.count() == 400
    got = {}
    for r in recommend.unfold(recommend.unseen(recommend.user_cf(reps, 3), reps), who).collect():
        got.setdefault(r["user"], {})[r["item"]] = r["score"]
    assert compared == [len({tuple(sorted(kinds[b])) for b in set(owner)})]
    unit = [{i: x / math.sqrt(sum(y * y for _, y in kind)) for i, x in kind} for kind in kinds]
    cosine = [[round(sum(a[i] * b.get(i, 0) for i in a), 9) for b in unit] for a in unit]
    for u in range(400):
        near = sorted((-cosine[owner[u]][owner[v]], v) for v in range(400) if v != u and unit[owner[u]].keys() & unit[owner[v]].keys())[:3]
        want = {}
        for c, v in near:
            for i, x in kinds[owner[v]]:
                if i not in unit[owner[u]]:
                    want[i] = want.get(i, 0) - c * x
        total = sum(-c for c, _ in near) + 1e-9
        assert got.get(u, {}) == pytest.approx({i: s / total for i, s in want.items()}, abs=1e-8)


def test_density_clusters_equal_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(5, 6))
    points = np.concatenate([centres[i % 5] + rnd.normal(size=6) * (0.25 if i % 3 else 0.9) for i in range(900)]).reshape(-1, 6)
    points[100:160], points[200], points[201] = points[100], 0, 0  # copies, and zeros that are near nothing
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "k long, v array<double>")
    monkeypatch.setattr(vectors.bl, "blocks_for", lambda n, *_, **__: 7)
    monkeypatch.setattr(vectors.bl, "TILE", 50)
    got = {r["k"]: r["cluster"] for r in vectors.density_clusters(df, "k", "v", 0.97, 4).collect()}
    unit = points / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None]
    near = np.round(unit @ unit.T, 6) >= 0.97
    np.fill_diagonal(near, True)
    core, label = near.sum(axis=1) >= 4, {}
    for i in np.flatnonzero(core):
        stack = [i] if i not in label else []
        label.setdefault(i, i)
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if j not in label:
                    label[j] = label[i]
                    stack.append(j)
    want = {i: label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)) for i in range(900)}
    assert got == want and len(set(want.values())) >= 4 and -1 in want.values()


def test_copies_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sm, "COPIES", 3)
    monkeypatch.setattr(sm, "SETS", 2)
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them at once".split()
    texts = [" ".join(base)] * 10 + [" ".join(base[:14])] * 2 + [" ".join(base[3:])] * 4 + ["something else entirely is written here today", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    signed = df.select("doc_id", F.sha2("text", 256).alias("same"), sm.word_minhash(F.col("text"), 3, 32).alias("signature"))
    old = df.select("doc_id", sm.minhash(sm.word_shingles(F.col("text"), 3), 32).alias("s"))
    assert signed.join(old, "doc_id").filter("signature <> s").count() == 0
    sets = [sm.word_sets(t, 3) if t is not None else set() for t in texts]
    bucket = {r["doc_id"]: {tuple(r["s"][4 * i : 4 * i + 4]) + (i,) for i in range(8)} for r in old.collect()}
    want = sorted((i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if bucket[i] & bucket[j])
    assert sorted(map(tuple, sm.lsh_candidates(old, "doc_id", "s", 8, 4).collect())) == want
    assert sm.candidate_count(old, "doc_id", "s", 8, 4).first()[0] == len(want)
    reps, members = sm.classed(signed.filter("same is not null"), "doc_id", "same")
    found = sm.verified(sm.rep_pairs(reps, 8, 4), df.select(F.col("doc_id").alias("rep"), "text"), 3, 0.5)
    got = sm.copied(found.unionByName(sm.with_itself(reps).withColumn("jaccard", F.lit(1.0))), reps, members).collect()
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert sorted((r["a"], r["b"], round(r["jaccard"], 9)) for r in got) == [(a, b, round(jaccard(sets[a], sets[b]), 9)) for a, b in want if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.5]


def test_plan_facts_tell_joins_apart(spark):
    a, b = spark.range(1000), spark.range(500)
    hinted = {h: a.join(b.hint(h), "id") for h in ("broadcast", "merge", "shuffle_hash")}
    facts = {h: plan_facts(df) for h, df in hinted.items()}
    assert facts["broadcast"]["broadcast_joins"] == 1 and facts["broadcast"]["exchanges"] == 0
    assert facts["merge"]["merge_joins"] == 1 and facts["merge"]["exchanges"] == 2
    assert {df.count() for df in hinted.values()} == {500} and facts["broadcast"]["python"] == 0


def test_csv_packages_and_memo(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n0001,"a ""q"" b",1\n')
    (tmp_path / "b.csv").write_text("id,y\n0002,7\n")
    df = files.read_packages(spark, {"p1": f"{tmp_path}/a.csv", "p2": f"{tmp_path}/b.csv"}, ["id", "name", "y"])
    assert sorted(map(tuple, df.collect()), key=str) == [("0001", 'a "q" b', None, "p1"), ("0002", None, "7", "p2")]
    calls = []

    def make():
        calls.append(1)
        return df

    for _ in range(2):
        files.memoized(spark, f"{tmp_path}/memo", f"{tmp_path}/a.csv", make).count()
    assert len(calls) == 1
    files.write_partitioned(df, f"{tmp_path}/parts", "package")
    assert spark.read.parquet(f"{tmp_path}/parts").filter("package = 'p1'").count() == 1
    files.export(df, f"{tmp_path}/out", "t", "d")
    assert spark.read.json(f"{tmp_path}/out/index").count() == 1


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_totalprice > 1000").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and "o_orderpriority" not in plan


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_fitted_cells_reach_their_recall(spark, folder):
    from quarry.plans.catalog import queries

    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").toPandas()
    ids, v = table["vec_id"].to_numpy(), vectors.unit(vectors.matrix(table, "embedding"))
    asked = np.flatnonzero(ids % 50 == 0)
    scores = np.round(v[asked] @ v.T, 6)
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {(ids[q], ids[j]): scores[i, j] for i, q in enumerate(asked) for j in np.lexsort((ids, -scores[i]))[:10]}
    got = {(r["query"], r["neighbour"]): r["score"] for r in queries()["ivf_kmeans"](spark, f"/root/testdata/{folder}").collect()}
    assert len(want.keys() & got.keys()) >= 0.9 * len(want)
    assert len(got) == len(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want.keys() & got.keys())


def test_fitted_cells_of_odd_tables(spark):
    schema = "k int, v array<float>"
    for rows in ([], [(1, [1.0, 0.0])], [(1, None)], [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None)]):
        df = spark.createDataFrame(rows, schema)
        centres, probes = vectors.fit_cells(df, "k", "v", 2)
        found = vectors.probe_fitted(df, df, "k", "v", centres, len(centres), 2).collect()
        held = [k for k, v in rows if v]
        assert {(r["query"], r["neighbour"]) for r in found} == {(a, b) for a in held for b in held if a != b}
        assert 1 <= probes <= len(centres)


def test_blocks_of_a_large_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    monkeypatch.setattr(vectors.bl, "blocks_for", lambda rows, **_: max(1, rows // 40))
    found = vectors.probe_fitted(df, df, "k", "v", np.eye(4)[:2], 2, 3).select("query", "neighbour", "score", "place")
    exact = vectors.nearest(df, df, "k", "v", 3).select("query", "neighbour", "score", "place")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_resamples_are_hashed_in_numpy(spark):
    keys = ["", "7", "12345", "é" * 20, "x" * 51, "x" * 52, "x" * 53, "x" * 80]
    hashed = hashing.unit_hashes(keys, range(200))
    rows = spark.createDataFrame([(k,) for k in keys], "k string").crossJoin(spark.range(200).withColumnRenamed("id", "b"))
    for r in rows.select("k", "b", hashing.unit_hash(F.col("k"), F.col("b")).alias("u")).collect():
        assert hashed(r["b"])[keys.index(r["k"])] == r["u"]
    each = spark.createDataFrame([(i, float(i % 3)) for i in range(50)] + [(None, 1.0), (50, None)], "k long, d double")
    assert "Generate" not in recommend.paired_bootstrap(each, "k", "d", 40)._jdf.queryExecution().toString()  # no row for each key and resample
    means = []
    for b in range(40):
        times = {k: sum(hashing.unit_hashes([str(k)], range(40))(b)[0] > c for c in recommend.POISSON) for k in range(51)}
        means.append(round(sum(times[i] * (i % 3) for i in range(50)) / sum(times.values()), 9))
    row = recommend.paired_bootstrap(each, "k", "d", 40).first()
    assert (row["low"], row["high"]) == pytest.approx(tuple(np.quantile(means, (0.025, 0.975))), abs=2e-9)
