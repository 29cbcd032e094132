"""Entity resolution over supplier and customer records with made-up variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import graphs as gr
from quarry.operators import resolution as rs
from quarry.operators.relational import mode_per_key
from quarry.plans.registry import Tables, query

#: Each customer appears under up to three spellings; a third of the codes are local numbers.
RECORDS = """rec AS (SELECT CASE c_custkey % 3 WHEN 0 THEN '20' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 1 THEN lpad(CAST(c_custkey % 500 AS VARCHAR), 6, '4') ELSE 'X' || c_custkey END AS code,
CASE v WHEN 0 THEN c_mktsegment || ' ' || c_name WHEN 1 THEN lower(c_mktsegment || ' ' || c_name || ' S.A.C.') ELSE c_mktsegment || ', ' || c_name || ' Inc' END AS name, c_nationkey AS place, c_custkey FROM customer, (SELECT unnest([0, 1, 2]) AS v))"""


def normal_sql(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(translate(upper({col}), '{text.ACCENTED}', '{text.PLAIN}'), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '{text.legal_pattern()}', ' ', 'g'), '\\s+', ' ', 'g'))"


KEYS = f"""{RECORDS}, nm AS (SELECT code, n AS normal FROM (SELECT code, {normal_sql('name')} AS n, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, {normal_sql('name')}) AS r FROM rec GROUP BY 1, 2) WHERE r = 1),
pl AS (SELECT code, place FROM (SELECT code, place, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, place) AS r FROM rec GROUP BY 1, 2) WHERE r = 1),
ky AS (SELECT code, normal, CASE WHEN regexp_matches(d, '^20[0-9]{{9}}$') THEN 'TAX-' || code WHEN regexp_matches(d, '^[0-9]{{6,7}}$') THEN 'CON-' || normal || '|' || place WHEN NOT regexp_matches(d, '^1[057][0-9]{{9}}$') AND normal <> '' THEN 'EXT-' || normal ELSE 'ID-' || code END AS key FROM (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM nm JOIN pl USING (code)))"""


def records(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("20"), F.lpad(k.cast("string"), 9, "0"))).when(k % 3 == 1, F.lpad((k % 500).cast("string"), 6, "4")).otherwise(F.concat(F.lit("X"), k.cast("string")))
    base = F.concat_ws(" ", "c_mktsegment", "c_name")
    names = F.array(base, F.lower(F.concat(base, F.lit(" S.A.C."))), F.concat("c_mktsegment", F.lit(", "), "c_name", F.lit(" Inc")))
    return t.customer.select(code.alias("code"), F.explode(names).alias("name"), F.col("c_nationkey").alias("place"), "c_custkey")


def keyed(t: Tables) -> DataFrame:
    return rs.exact_keys(records(t), "code", "name", "place")


@query(f"WITH {KEYS} SELECT code, key, normal FROM ky")
def name_keys(t: Tables) -> DataFrame:
    """Canonical keys by kind of code."""
    return keyed(t)


RIVALS = f"{KEYS}, pp AS (SELECT DISTINCT o_orderkey % 50 AS g, code FROM orders JOIN rec ON o_custkey = c_custkey), rv AS (SELECT DISTINCT key FROM (SELECT g, key FROM pp JOIN ky USING (code) GROUP BY ALL HAVING count(DISTINCT code) > 1))"


def meetings(t: Tables) -> DataFrame:
    people = records(t).select("code", "c_custkey").distinct()
    return t.orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_orderkey") % 50).alias("g"), "code").distinct()


@query(f"WITH {RIVALS} SELECT code, CASE WHEN key IN (SELECT key FROM rv) THEN 'ID-' || code ELSE key END AS key FROM ky")
def rival_conflicts(t: Tables) -> DataFrame:
    """Keys whose codes meet in one group are rolled back."""
    keys = keyed(t)
    return rs.roll_back(keys.select("code", "key"), rs.rivals(meetings(t), "g", "code", keys.select("code", "key")), "code")


@query(f"WITH {RECORDS} SELECT c_custkey, count(DISTINCT code) AS codes, count(DISTINCT {normal_sql('name')}) AS names FROM rec GROUP BY 1")
def homonyms(t: Tables) -> DataFrame:
    """Codes and normalised names of each customer."""
    return records(t).groupBy("c_custkey").agg(F.count_distinct("code").alias("codes"), F.count_distinct(text.legal_name(F.col("name"))).alias("names"))


@query(f"WITH {RECORDS} SELECT code, name, n, round(share, 6) AS share FROM (SELECT code, name, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY code) AS share, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, name) AS r FROM rec GROUP BY 1, 2) WHERE r = 1")
def canonical_names(t: Tables) -> DataFrame:
    """The most frequent name of each code."""
    return mode_per_key(records(t), "code", "name").withColumn("share", F.round("share", 6))


@query(f"WITH {RIVALS}, f AS (SELECT code, CASE WHEN key IN (SELECT key FROM rv) THEN 'ID-' || code ELSE key END AS key FROM ky) SELECT split_part(key, '-', 1) AS kind, count(*) AS codes, count(DISTINCT key) AS entities FROM f GROUP BY 1")
def resolution_report(t: Tables) -> DataFrame:
    """Codes and entities by kind of key."""
    return rival_conflicts(t).groupBy(F.split("key", "-")[0].alias("kind")).agg(F.count("*").alias("codes"), F.count_distinct("key").alias("entities"))


@query()
def fuzzy_pairs(t: Tables) -> DataFrame:
    """Alike part names in a brand, by trigrams, with their class (tested by brute force)."""
    names = t.part.select(F.concat_ws("-", "p_brand", "p_name").alias("k"), F.col("p_name").alias("n"), "p_brand").distinct()
    pairs = gr.cut(rs.fuzzy_pairs(names, "k", "n", "p_brand", 0.5))
    found = gr.connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return pairs.join(found.withColumnRenamed("node", "a"), "a").select("a", "b", F.round("jaccard", 6).alias("jaccard"), "component")
