"""The corpus pipeline against brute force over the smallest documents, and its guard rails."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F
from quarry.llm import decontam

from tests.llm.test_operators import brute_links

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    spoken = corpus_pipeline.identify_language(spark, docs, SMALL)
    assert spoken.columns == docs.columns
    left = sorted((r["doc_id"], r["text"]) for r in spoken.collect())
    assert len(left) >= 0.97 * docs.count() and all(re.search(r"[^\W\d_]", t) for _, t in left)

    seen, exact = set(), []
    for d, t in left:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if norm not in seen:
            seen.add(norm)
            exact.append((d, t))
    links = brute_links(exact)
    near = [(d, t) for d, t in exact if links[d] == d]

    norm = lambda t: re.sub(r"[\W_]+", " ", t).strip().lower().encode()
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items = [i for i in items if len(i) >= decontam.MIN_BYTES]
    clean = [d for d, t in near if not any(decontam.myers(i, norm(t), decontam.budget(len(i)))[0] <= decontam.budget(len(i)) for i in items)]

    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in got.select("doc_id").distinct().collect()) == clean
    assert got.groupBy("doc_id").agg((F.sum("length") - F.max("doc_tokens")).alias("x")).filter("x <> 0").count() == 0


def test_clashing_columns_and_null_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()}
    alone = spark.createDataFrame([(None, "a lonely document without any id, of its own kind", "en", "s", 49)], docs.schema)
    more = docs.unionByName(docs.limit(3)).unionByName(alone).withColumns({n: F.lit("x") for n in ("_keep", "_name", "_sha", "_copy", "_bad", "class_id", "node", "shard", "score")})
    more.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").withColumn("doc_id", F.lit("x")).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} - {None} == want
    assert got.groupBy("doc_id").agg((F.sum("length") - F.max("doc_tokens")).alias("x")).filter("x <> 0").count() == 0


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
