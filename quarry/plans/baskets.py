"""Baskets, itemsets and rules over orders and their parts."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import patterns as pt
from quarry.plans.registry import Tables, query

LINES = "SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey"
SUPPORT = 0.001


def lines(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("i")).distinct()


@query("""WITH b AS (SELECT l_orderkey AS o, o_custkey AS c, o_orderdate AS d, p_name AS i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey),
x AS (SELECT 'order' AS basket, CAST(o AS VARCHAR) AS k, i FROM b UNION ALL SELECT 'customer-month', c || strftime(d, '-%Y-%m'), i FROM b UNION ALL SELECT 'customer-quarter', c || '-' || year(d) || 'T' || quarter(d), i FROM b),
s AS (SELECT basket, k, count(DISTINCT i) AS s FROM x GROUP BY ALL)
SELECT basket, count(*) AS baskets, round(avg(s), 6) AS mean_size, max(s) AS max_size, round(avg(CASE WHEN s >= 2 THEN 1.0 ELSE 0.0 END), 6) AS share_2 FROM s GROUP BY 1""")
def basket_definitions(t: Tables) -> DataFrame:
    """B1: three definitions of a basket, and what each makes of co-occurrence."""
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    keys = {"order": F.col("l_orderkey").cast("string"), "customer-month": F.concat_ws("-", "o_custkey", F.date_format("o_orderdate", "yyyy-MM")), "customer-quarter": F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"), F.lit("T"), F.quarter("o_orderdate").cast("string"))}
    out = None
    for name, key in keys.items():
        one = pt.basket_stats(b.select(key.alias("k"), "p_name"), "k", "p_name").select(F.lit(name).alias("basket"), "*")
        out = one if out is None else out.unionByName(one)
    return out


ITEMSETS = f"""b AS ({LINES}), n AS (SELECT count(DISTINCT k) AS n FROM b),
s1 AS (SELECT i AS a, NULL AS b, NULL AS c, count(*) AS m FROM b GROUP BY 1),
s2 AS (SELECT x.i AS a, y.i AS b, NULL AS c, count(*) AS m FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY ALL),
s3 AS (SELECT x.i AS a, y.i AS b, z.i AS c, count(*) AS m FROM b x JOIN b y ON x.k = y.k AND x.i < y.i JOIN b z ON y.k = z.k AND y.i < z.i GROUP BY ALL),
f AS (SELECT concat_ws(',', a, b, c) AS items, m AS n, m / (SELECT n FROM n) AS support FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE m >= {SUPPORT} * (SELECT n FROM n))"""


@query(f"WITH {ITEMSETS} SELECT items, n, round(support, 6) AS support FROM f")
def apriori_1_2_3(t: Tables) -> DataFrame:
    """Frequent sets of one to three brands."""
    return pt.apriori(lines(t), "k", "i", SUPPORT, 3).select(F.array_join("items", ",").alias("items"), "n", F.round("support", 6).alias("support"))


@query(f"WITH {ITEMSETS.replace(str(SUPPORT), '0.003')} SELECT items, n FROM f")
def fpgrowth_itemsets(t: Tables) -> DataFrame:
    """The sets of one to three brands by FP-Growth, to hold against the levels above; larger ones (small tables have some) are left out."""
    made = lines(t).groupBy("k").agg(F.array_sort(F.collect_set("i")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=0.003).fit(made).freqItemsets
    return found.filter(F.size("items") <= 3).select(F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("n"))


RULES = f"""{ITEMSETS}, w AS (SELECT string_split(items, ',') AS l, support FROM f WHERE contains(items, ',')), m AS (SELECT l, support, unnest(range(1, CAST(2 ** len(l) AS BIGINT) - 1)) AS m FROM w),
r AS (SELECT support, array_to_string(list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 1), ',') AS antecedent, array_to_string(list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 0), ',') AS consequent FROM m),
q AS (SELECT antecedent, consequent, round(r.support, 5) AS support, round(r.support / a.support, 4) AS confidence, round(r.support / a.support / c.support, 3) AS lift FROM r JOIN f a ON a.items = antecedent JOIN f c ON c.items = consequent WHERE r.support / a.support >= 0.05)"""


def found_rules(t: Tables) -> DataFrame:
    out = pt.rules(pt.apriori(lines(t), "k", "i", SUPPORT, 3), 0.05)
    return out.withColumns({c: F.array_join(c, ",") for c in ("antecedent", "consequent")})


@query(f"WITH {RULES} SELECT * FROM q")
def rules_lift(t: Tables) -> DataFrame:
    """Rules with support, confidence and lift."""
    return found_rules(t)


@query(f"""WITH {RULES}, k AS (SELECT * FROM q WHERE support >= 0.0015 AND lift >= 0.5), z AS (SELECT *, round(sqrt(((support - min(support) OVER ()) / greatest(max(support) OVER () - min(support) OVER (), 1e-12)) ** 2 + ((lift - min(lift) OVER ()) / greatest(max(lift) OVER () - min(lift) OVER (), 1e-12)) ** 2), 6) AS score FROM k)
SELECT * FROM z ORDER BY score DESC, antecedent, consequent LIMIT 10""")
def relevant_rules(t: Tables) -> DataFrame:
    """The ten rules furthest out in support and lift."""
    return pt.relevance(found_rules(t), 0.0015, 0.5, 10)


@query("""WITH s AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey AS k, unnest(['STATUS=' || o_orderstatus, 'PRIORITY=' || o_orderpriority, 'SEGMENT=' || c_mktsegment, 'BAND=' || CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END, 'BIDDER=' || CASE WHEN b <= 1 THEN 'single' ELSE 'many' END]) AS i FROM orders JOIN customer ON c_custkey = o_custkey JOIN s ON o_orderkey = l_orderkey),
n AS (SELECT count(DISTINCT k) AS n FROM e), c1 AS (SELECT i, count(*) AS m FROM e GROUP BY 1), c2 AS (SELECT x.i, count(*) AS m FROM e x JOIN e y ON x.k = y.k WHERE y.i = 'BIDDER=single' AND x.i <> y.i GROUP BY 1)
SELECT c2.i AS antecedent, round(c2.m / n, 5) AS support, round(c2.m / c1.m, 4) AS confidence, round(c2.m / c1.m / ((SELECT m FROM c1 WHERE i = 'BIDDER=single') / n), 3) AS lift FROM c2 JOIN c1 USING (i), n WHERE c2.m >= 0.001 * n""")
def enriched_rules_single(t: Tables) -> DataFrame:
    """Attributes as items, and the rules that end in a single bidder."""
    bidders = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("b"))
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(bidders, F.col("o_orderkey") == F.col("l_orderkey"))
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 300000, "mid").otherwise("high")
    made = F.array_union(F.array(F.concat(F.lit("STATUS="), "o_orderstatus"), F.concat(F.lit("PRIORITY="), "o_orderpriority"), F.concat(F.lit("SEGMENT="), "c_mktsegment")), F.array(F.concat(F.lit("BAND="), band), F.concat(F.lit("BIDDER="), F.when(F.col("b") <= 1, "single").otherwise("many"))))
    found = pt.rules(pt.apriori(o.select(F.col("o_orderkey").alias("k"), F.explode(made).alias("i")), "k", "i", 0.001, 2), 0.0)
    single = found.filter(F.array_contains("consequent", "BIDDER=single"))
    return single.select(F.array_join("antecedent", ",").alias("antecedent"), "support", "confidence", "lift")
