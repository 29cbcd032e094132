"""Similarity of texts: whole documents by signatures, benchmark items by all pairs."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, MinHashLSH
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import sql_hash
from quarry.operators import similarity as sm
from quarry.operators.spectral import truncated_svd
from quarry.plans.registry import Tables, query

SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def char_sql(k: int, name: str = "sh") -> str:
    return f"{name} AS (SELECT DISTINCT item_id AS k, substr(t, CAST(i AS BIGINT), {k}) AS s FROM (SELECT item_id, {SQUEEZED} AS t FROM benchmark), LATERAL (SELECT unnest(range(1, greatest(1, length(t) - {k} + 1) + 1)) AS i))"


def pairs_sql(k: int, sh: str = "sh", suffix: str = "") -> str:
    return f"{char_sql(k, sh)}, sz{suffix} AS (SELECT k, count(*) AS n FROM {sh} GROUP BY 1), pr{suffix} AS (SELECT a, b, c, c / (x.n + y.n - c) AS j FROM (SELECT p.k AS a, q.k AS b, count(*) AS c FROM {sh} p JOIN {sh} q ON p.s = q.s AND p.k < q.k GROUP BY ALL) JOIN sz{suffix} x ON x.k = a JOIN sz{suffix} y ON y.k = b)"


def item_pairs(t: Tables, k: int) -> DataFrame:
    sets = t.benchmark.select("item_id", F.explode(sm.char_shingles(F.col("text"), k)).alias("s"))
    return sm.overlap_pairs(sets, "item_id", "s")


@query(f"WITH {pairs_sql(9)} SELECT a, b, c AS common, round(j, 6) AS jaccard FROM pr")
def jaccard_pairs(t: Tables) -> DataFrame:
    """M1, M2, M3: exact Jaccard of all items that share a 9-character shingle."""
    return item_pairs(t, 9).withColumn("jaccard", F.round("jaccard", 6))


SIZES = (3, 5, 7, 9, 11, 13)


@query(
    "WITH tot AS (SELECT count(*) * (count(*) - 1) / 2 AS n FROM benchmark), "
    + ", ".join(pairs_sql(k, f"sh{k}", str(k)) for k in SIZES)
    + ", al AS ("
    + " UNION ALL ".join(f"SELECT {k} AS size, j FROM pr{k}" for k in SIZES)
    + """), r AS (SELECT size, j, row_number() OVER (PARTITION BY size ORDER BY j) + (SELECT n FROM tot) - count(*) OVER (PARTITION BY size) AS pos FROM al)
SELECT CAST(size AS INT) AS size, round(coalesce(max(j) FILTER (WHERE pos = ceil(n * 0.5)), 0), 6) AS median, round(coalesce(max(j) FILTER (WHERE pos = ceil(n * 0.99)), 0), 6) AS p99, coalesce(max(j) FILTER (WHERE pos = ceil(n * 0.99)), 0) < 0.02 AS clean FROM r, tot GROUP BY size"""
)
def shingle_k_calibration(t: Tables) -> DataFrame:
    """M4: background similarity by shingle size; pairs with nothing in common count as 0 without being made."""
    total = t.benchmark.agg((F.count("*") * (F.count("*") - 1) / 2).alias("n"))
    out = None
    for k in SIZES:
        found = item_pairs(t, k).select(F.lit(k).alias("size"), "jaccard")
        out = found if out is None else out.unionByName(found)
    counted = out.groupBy("size").agg(F.count("*").alias("m"))
    w = Window.partitionBy("size").orderBy("jaccard")
    ranked = out.withColumn("r", F.row_number().over(w)).join(F.broadcast(counted), "size").crossJoin(F.broadcast(total)).withColumn("at", F.col("r") + F.col("n") - F.col("m"))
    q = lambda p: F.coalesce(F.max(F.when(F.col("at") == F.ceil(F.col("n") * p), F.col("jaccard"))), F.lit(0.0))
    return ranked.groupBy("size").agg(F.round(q(0.5), 6).alias("median"), F.round(q(0.99), 6).alias("p99"), (q(0.99) < 0.02).alias("clean"))


def signature_sql(n: int, source: str = "sh") -> str:
    numbers = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(sm.minhash_numbers(n)))
    return f"hx AS (SELECT k, {sql_hash('s', 9)} % {sm.PRIME} AS h FROM {source}), lin(i, a, b) AS (VALUES {numbers}), sg AS (SELECT k, i, min((a * h + b) % {sm.PRIME}) AS v FROM hx, lin GROUP BY ALL)"


WORDS_SQL = "w AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS l FROM documents), sh AS (SELECT DISTINCT doc_id AS k, array_to_string(l[i : i + 2], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(l) - 2) + 1)) AS i))"


def signed_documents(t: Tables, n: int) -> DataFrame:
    return t.documents.select("doc_id", sm.word_minhash(F.col("text"), 3, n).alias("signature"))


@query(f"WITH {WORDS_SQL}, {signature_sql(16)} SELECT k AS doc_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS signature FROM sg GROUP BY 1")
def minhash_signature(t: Tables) -> DataFrame:
    """M5, M6: 16 minima over word trigrams of whole documents."""
    return signed_documents(t, 16).select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query(f"WITH {pairs_sql(5)}, {signature_sql(64)}, e AS (SELECT a, b, j, (SELECT 1) AS one FROM pr), g AS (SELECT e.a, e.b, e.j, x.i, CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END AS same FROM e JOIN sg x ON x.k = e.a JOIN sg y ON y.k = e.b AND x.i = y.i) "
       "SELECT CAST(n AS INT) AS n, round(avg(abs(est - j)), 6) AS mean_error FROM (SELECT n, a, b, max(j) AS j, avg(same) AS est FROM g, (VALUES (16), (32), (64)) AS z(n) WHERE i < n GROUP BY ALL) GROUP BY n")
def minhash_error(t: Tables) -> DataFrame:
    """M7: mean error of the estimate for 16, 32 and 64 minima over pairs of items."""
    signed = t.benchmark.select("item_id", sm.minhash(sm.char_shingles(F.col("text"), 5), 64).alias("s"))
    pairs = item_pairs(t, 5).join(signed.select(F.col("item_id").alias("a"), F.col("s").alias("sa")), "a").join(signed.select(F.col("item_id").alias("b"), F.col("s").alias("sb")), "b")
    rows = F.array(*[F.struct(F.lit(n).alias("n"), sm.agreement(F.slice("sa", 1, n), F.slice("sb", 1, n)).alias("est")) for n in (16, 32, 64)])
    return pairs.select("jaccard", F.inline(rows)).groupBy("n").agg(F.round(F.avg(F.abs(F.col("est") - F.col("jaccard"))), 6).alias("mean_error"))


def bands_sql(count: int, rows: int) -> str:
    return f"bd AS (SELECT k, i // {rows} AS band, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS bucket FROM sg WHERE i < {count * rows} GROUP BY ALL), cd AS (SELECT DISTINCT x.k AS a, y.k AS b FROM bd x JOIN bd y ON x.band = y.band AND x.bucket = y.bucket AND x.k < y.k)"


@query(f"WITH {WORDS_SQL}, {signature_sql(32)}, {bands_sql(8, 4)} SELECT a, b FROM cd")
def lsh_candidates(t: Tables) -> DataFrame:
    """Candidates among whole documents, 8 bands of 4."""
    return sm.lsh_candidates(signed_documents(t, 32), "doc_id", "signature", 8, 4)


@query(f"WITH {WORDS_SQL}, {signature_sql(32)}, {bands_sql(8, 4)}, z AS (SELECT k, count(*) AS n FROM sh GROUP BY 1), c AS (SELECT a, b, count(*) AS c FROM cd JOIN sh x ON x.k = a JOIN sh y ON y.k = b AND x.s = y.s GROUP BY ALL) "
       "SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM c JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE c / (x.n + y.n - c) >= 0.5")
def lsh_verified(t: Tables) -> DataFrame:
    """Candidates with exact Jaccard of 0.5 or more; each pair of different texts is compared once, whatever their copies."""
    text = F.sha2(F.lower(sm.squeeze(F.col("text"))), 256)
    reps, members = sm.classed(t.documents.select("doc_id", text.alias("same"), sm.word_minhash(F.col("text"), 3, 32).alias("signature")), "doc_id", "same")
    found = sm.verified(sm.rep_pairs(reps, 8, 4), t.documents.select(F.col("doc_id").alias("rep"), "text"), 3, 0.5)
    every = found.unionByName(sm.with_itself(reps).withColumn("jaccard", F.lit(1.0)))
    return sm.copied(every, reps, members).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {WORDS_SQL}, {signature_sql(32)}, {bands_sql(8, 4)}, m AS (SELECT count(DISTINCT a) AS heads, count(*) AS candidates FROM cd), d AS (SELECT count(*) AS n FROM documents) SELECT n AS documents, CAST(n * (n - 1) // 2 AS BIGINT) AS possible, candidates FROM m, d")
def lsh_scale_report(t: Tables) -> DataFrame:
    """Pairs possible against candidates."""
    n = t.documents.agg(F.count("*").alias("documents"))
    return sm.candidate_count(signed_documents(t, 32), "doc_id", "signature", 8, 4).crossJoin(n).select("documents", F.expr("documents * (documents - 1) div 2").alias("possible"), "candidates")


SWEEP = [(16, 1), (8, 2), (5, 3), (4, 4)]


@query(
    f"WITH {pairs_sql(5)}, tru AS (SELECT a, b FROM pr WHERE j >= 0.3), tot AS (SELECT count(*) * (count(*) - 1) / 2 AS n FROM benchmark), {signature_sql(16)}, "
    + ", ".join(bands_sql(b, r).replace("bd ", f"bd{r} ").replace("cd AS", f"cd{r} AS") for b, r in SWEEP)
    + " "
    + " UNION ALL ".join(
        f"SELECT {r} AS r, {b} AS b, count(*) AS candidates, (SELECT count(*) FROM tru) - count(t.a) AS missed, count(*) - count(t.a) AS extra, round(100.0 * count(*) / max(n), 4) AS verified_pct FROM cd{r} c LEFT JOIN tru t ON t.a = c.a AND t.b = c.b, tot" for b, r in SWEEP
    )
)
def lsh_sweep(t: Tables) -> DataFrame:
    """Missed and extra pairs by bands and rows; without any candidate the share to verify is null."""
    truth = item_pairs(t, 5).filter("jaccard >= 0.3").select("a", "b", F.lit(1).alias("true"))
    total = t.benchmark.agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).crossJoin(truth.agg(F.count("*").alias("all_true")))
    signed = t.benchmark.select("item_id", sm.minhash(sm.char_shingles(F.col("text"), 5), 16).alias("s"))
    out = None
    for b, r in SWEEP:
        found = sm.lsh_candidates(signed, "item_id", "s", b, r).join(truth, ["a", "b"], "left").agg(F.count("*").alias("candidates"), F.count("true").alias("hits"))
        one = found.crossJoin(total).select(F.lit(r).alias("r"), F.lit(b).alias("b"), "candidates", (F.col("all_true") - F.col("hits")).alias("missed"), (F.col("candidates") - F.col("hits")).alias("extra"), F.round(100.0 * F.nullif("candidates", F.lit(0)) / F.col("n"), 4).alias("verified_pct"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH c(b, r) AS (VALUES (64, 2), (32, 4), (16, 8)), s AS (SELECT unnest(range(1, 20)) / 20.0 AS s) SELECT CAST(b AS INT) AS b, CAST(r AS INT) AS r, CAST(s AS DOUBLE) AS s, round(1 - (1 - CAST(s AS DOUBLE) ** r) ** b, 6) AS p, round((1.0 / b) ** (1.0 / r), 6) AS threshold FROM c, s")
def s_curve(t: Tables) -> DataFrame:
    """Chance of becoming a candidate."""
    grid = t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(r).alias("r")) for b, r in ((64, 2), (32, 4), (16, 8))])))
    grid = grid.select("b", "r", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("_i")).select("b", "r", (F.col("_i") / 20.0).alias("s"))
    return grid.select("b", "r", "s", F.round(1 - F.pow(1 - F.pow("s", "r"), "b"), 6).alias("p"), F.round(F.pow(1.0 / F.col("b"), 1.0 / F.col("r")), 6).alias("threshold"))


TOKENS_SQL = "tk AS (SELECT doc_id AS k, w, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) AS w FROM documents) GROUP BY ALL)"


@query(
    f"WITH {TOKENS_SQL}, h AS (SELECT k, tf, {sql_hash('w', 4)} AS h FROM tk) SELECT k AS doc_id, CAST("
    + " + ".join(f"(CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN tf ELSE -tf END) > 0 THEN {1 << i}::BIGINT ELSE 0 END)" for i in range(60))
    + " AS BIGINT) AS simhash FROM h GROUP BY 1"
)
def simhash_documents(t: Tables) -> DataFrame:
    """A 60-bit SimHash of each whole document, words weighted by count."""
    words = t.documents.select("doc_id", F.explode(F.split(F.lower(sm.squeeze(F.col("text"))), " ")).alias("w"))
    return sm.simhash(words.groupBy("doc_id", "w").agg(F.count("*").alias("tf")), "doc_id", "w", "tf")


ITEM_TOKENS = "tk AS (SELECT item_id AS k, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark)"


def item_tokens(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w"))


TFIDF_SQL = f"""{ITEM_TOKENS}, tf AS (SELECT k, w, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(DISTINCT k) AS n FROM tk),
rw AS (SELECT k, w, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (w), n), nm AS (SELECT k, sqrt(sum(x * x)) AS z FROM rw GROUP BY 1), tw AS (SELECT k, w, x / z AS x FROM rw JOIN nm USING (k)),
dp AS (SELECT p.k AS a, q.k AS b, sum(p.x * q.x) AS dot FROM tw p JOIN tw q ON p.w = q.w AND p.k < q.k GROUP BY ALL)"""


@query(f"WITH {TFIDF_SQL}, s AS (SELECT a AS k, b AS o, round(dot, 6) AS c FROM dp UNION ALL SELECT b, a, round(dot, 6) FROM dp) SELECT k AS item_id, o AS other, c AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, o) AS r FROM s) WHERE r <= 3")
def tfidf_cosine_topk(t: Tables) -> DataFrame:
    """The three nearest items by TF-IDF cosine."""
    pairs = sm.dot_pairs(sm.tfidf(item_tokens(t), "item_id", "w"), "item_id", "w").withColumn("c", F.round("dot", 6))
    both = pairs.select(F.col("a").alias("item_id"), F.col("b").alias("other"), "c").union(pairs.select("b", "a", "c"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("c"), "other"))
    return both.withColumn("r", place).filter("r <= 3").select("item_id", "other", F.col("c").alias("cosine"))


@query(
    f"WITH {ITEM_TOKENS.replace('tk AS', 't0 AS')}, tk AS (SELECT k, w, count(*) AS tf FROM t0 GROUP BY ALL), h AS (SELECT k, tf, {sql_hash('w', 4)} AS h FROM tk), sh AS (SELECT k, CAST("
    + " + ".join(f"(CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN tf ELSE -tf END) > 0 THEN {1 << i}::BIGINT ELSE 0 END)" for i in range(60))
    + f" AS BIGINT) AS s FROM h GROUP BY 1), {TFIDF_SQL.replace('tk AS (SELECT item_id', 'tq AS (SELECT item_id').replace('FROM tk', 'FROM tq')} SELECT count(*) AS pairs, round(corr(1 - bit_count(xor(x.s, y.s)) / 60.0, dot), 4) AS correlation FROM dp JOIN sh x ON x.k = a JOIN sh y ON y.k = b"
)
def simhash_hamming(t: Tables) -> DataFrame:
    """Correlation of SimHash agreement with TF-IDF cosine over pairs of items."""
    tokens = item_tokens(t)
    hashes = sm.simhash(tokens.groupBy("item_id", "w").agg(F.count("*").alias("tf")), "item_id", "w", "tf")
    pairs = sm.dot_pairs(sm.tfidf(tokens, "item_id", "w"), "item_id", "w")
    joined = pairs.join(hashes.select(F.col("item_id").alias("a"), F.col("simhash").alias("x")), "a").join(hashes.select(F.col("item_id").alias("b"), F.col("simhash").alias("y")), "b")
    return joined.agg(F.count("*").alias("pairs"), F.round(F.corr(1 - F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) / 60.0, "dot"), 4).alias("correlation"))


@query(f"WITH {pairs_sql(9)} SELECT a, b, round(j, 6) AS jaccard, x.n_chars AS chars_a, y.n_chars AS chars_b FROM pr JOIN (SELECT item_id, length(text) AS n_chars FROM benchmark) x ON x.item_id = a JOIN (SELECT item_id, length(text) AS n_chars FROM benchmark) y ON y.item_id = b ORDER BY round(j, 6) DESC, a, b LIMIT 5")
def near_duplicate_cases(t: Tables) -> DataFrame:
    """The five most similar pairs with facts on both sides."""
    facts = lambda n: t.benchmark.select(F.col("item_id").alias(n), F.length("text").cast("long").alias(f"chars_{n}"))
    top = item_pairs(t, 9).select("a", "b", F.round("jaccard", 6).alias("jaccard")).orderBy(F.desc("jaccard"), "a", "b").limit(5)
    return top.join(facts("a"), "a").join(facts("b"), "b").select("a", "b", "jaccard", "chars_a", "chars_b")


@query()
def mllib_minhash(t: Tables) -> DataFrame:
    """MLlib's MinHash join on the items, for contrast (own random hashes: rows only)."""
    made = t.benchmark.select("item_id", sm.char_shingles(F.col("text"), 5).alias("sh"))
    vectors = CountVectorizer(inputCol="sh", outputCol="v", binary=True).fit(made).transform(made).select("item_id", "v")
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=8, seed=7).fit(vectors)
    joined = model.approxSimilarityJoin(vectors, vectors, 0.95, "distance")  # the items have little in common
    return joined.select(F.col("datasetA.item_id").alias("a"), F.col("datasetB.item_id").alias("b"), "distance").filter("a < b")


@query()
def lsa_documents(t: Tables) -> DataFrame:
    """TF-IDF of the documents' words, then eight singular directions (iterative: held against numpy in tests)."""
    words = t.documents.select("doc_id", F.explode(F.split(F.lower(sm.squeeze(F.col("text"))), " ")).alias("w"))
    weights = sm.tfidf(words, "doc_id", "w").select(F.col("doc_id").alias("row"), F.col("w").alias("col"), F.col("weight").alias("value"))
    return truncated_svd(weights, 8, 4)[0].select(F.col("row").alias("doc_id"), "vector")
