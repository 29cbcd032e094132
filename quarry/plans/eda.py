"""Profiling, cleaning and exploratory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.hashing import portable_hash, sql_hash
from quarry.operators import relational as rel
from quarry.plans.registry import Tables, query


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS amount,
round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS largest, min(o_totalprice) AS smallest FROM orders GROUP BY 1""")
def monthly_series(t: Tables) -> DataFrame:
    """Count and amounts by month."""
    return (
        t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("largest"), F.min("o_totalprice").alias("smallest"))
        .orderBy("month")
    )


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, date_trunc('month', o_orderdate) AS month_start,
year(o_orderdate) || 'T' || CAST(CAST(ceil(month(o_orderdate) / 3) AS INT) AS VARCHAR) AS quarter FROM orders""")
def date_parts(t: Tables) -> DataFrame:
    """Year, month, truncation and quarter label."""
    d = F.col("o_orderdate")
    quarter = F.concat_ws("T", F.year(d), F.ceil(F.month(d) / 3).cast("int"))
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.date_trunc("month", d).alias("month_start"), quarter.alias("quarter"))


@query(
    "SELECT CAST(month(o_orderdate) AS INT) AS m, "
    + ", ".join(f"count(*) FILTER (WHERE year(o_orderdate) = {y}) AS y{y}" for y in range(1995, 2002))
    + " FROM orders GROUP BY 1"
)
def season_pivot(t: Tables) -> DataFrame:
    """Months by years."""
    years = list(range(1995, 2002))
    base = t.orders.select(F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("yr"))
    wide = base.groupBy("m").pivot("yr", years).count().na.fill(0)
    return wide.select("m", *[F.col(str(y)).alias(f"y{y}") for y in years])


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5""")
def by_priority_top(t: Tables) -> DataFrame:
    """The five largest orders of each priority."""
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.withColumn("r", place).filter("r <= 5").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def largest_orders(t: Tables) -> DataFrame:
    """O1, O2: top 20 with a tie-break."""
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20)


@query("""SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT (o_custkey, o_orderstatus)) AS customer_states, round(sum(o_totalprice), 2) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def segment_rollup_distinct(t: Tables) -> DataFrame:
    """A2: distinct counts of columns and of a pair."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.count_distinct("c_custkey").alias("customers"),
        F.count_distinct("o_orderkey").alias("orders"),
        F.count_distinct(F.struct("o_custkey", "o_orderstatus")).alias("customer_states"),
        F.round(F.sum("o_totalprice"), 2).alias("amount"),
    )


#: Bands of amounts, lower bounds.
BANDS = [(500_000, "f_500k"), (300_000, "e_300k"), (200_000, "d_200k"), (100_000, "c_100k"), (50_000, "b_50k")]


@query(
    "WITH s AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS bidders FROM lineitem GROUP BY 1) SELECT CASE "
    + " ".join(f"WHEN o_totalprice >= {n} THEN '{b}'" for n, b in BANDS)
    + """ ELSE 'a_low' END AS band, count(*) AS n, round(avg(CASE WHEN bidders = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_share,
quantile_disc(bidders, 0.5) AS median_bidders, round(avg(bidders), 6) AS mean_bidders FROM orders JOIN s ON o_orderkey = l_orderkey GROUP BY 1"""
)
def amount_bands_competition(t: Tables) -> DataFrame:
    """Competition by band of amount."""
    bidders = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("bidders"))
    band = F.lit("a_low")
    for n, name in reversed(BANDS):
        band = F.when(F.col("o_totalprice") >= n, name).otherwise(band)
    return t.orders.join(bidders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(band.alias("band")).agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("bidders") == 1).cast("double")), 6).alias("single_share"),
        F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY bidders) as long)").alias("median_bidders"),
        F.round(F.avg("bidders"), 6).alias("mean_bidders"),
    )


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("WITH n AS (SELECT count(*) AS n FROM events) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct FROM events" for c in EVENT_COLUMNS))
def profile_nulls(t: Tables) -> DataFrame:
    """A4: nulls by column."""
    return rel.profile_nulls(t.events.select(*EVENT_COLUMNS))


@query()
def profile_cardinality(t: Tables) -> DataFrame:
    """A3: approximate distinct counts by column (HyperLogLog: tested by its error bound)."""
    return rel.profile_cardinality(t.lineitem)


@query("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1""")
def dedup_latest(t: Tables) -> DataFrame:
    """The latest version of each key, nulls last."""
    return rel.first_per_group(t.events, ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type")


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, sum(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey, round(m, 2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(m, 2) DESC, l_suppkey) AS r FROM s) WHERE r = 1""")
def top_supplier_per_order(t: Tables) -> DataFrame:
    """The main supplier of each order."""
    sums = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    return rel.first_per_group(sums, ["l_orderkey"], [F.desc("amount"), F.col("l_suppkey")])


@query("""SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS items, count(DISTINCT p_brand) AS n_items, min(l_shipdate) AS first_ship, max(l_linenumber) AS last_line
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def basket_per_order(t: Tables) -> DataFrame:
    """The set of an order's brands."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    items = F.array_sort(F.collect_set("p_brand"))
    return lines.groupBy("l_orderkey").agg(items.alias("items"), F.size(items).cast("long").alias("n_items"), F.min("l_shipdate").alias("first_ship"), F.max("l_linenumber").alias("last_line"))


@query("""WITH h AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
g AS (SELECT event_type, quantile_disc(value, 0.5) AS m FROM h GROUP BY 1), o AS (SELECT quantile_disc(value, 0.5) AS m FROM h)
SELECT event_id, event_type, coalesce(h.value, g.m, o.m) AS value, h.value IS NULL AS imputed FROM h LEFT JOIN g USING (event_type) CROSS JOIN o""")
def impute_group_median(t: Tables) -> DataFrame:
    """A seventh of the values is blanked, and filled with the median of its type."""
    holes = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return rel.impute_group_median(holes, "event_type", "value").select("event_id", "event_type", "value", "imputed")


@query("""WITH b AS (SELECT quantile_cont(ln(1 + o_totalprice), 0.25) AS q1, quantile_cont(ln(1 + o_totalprice), 0.75) AS q3 FROM orders)
SELECT o_orderkey, ln(1 + o_totalprice) < q1 - 1.5 * (q3 - q1) OR ln(1 + o_totalprice) > q3 + 1.5 * (q3 - q1) AS outlier FROM orders, b""")
def tukey_flag(t: Tables) -> DataFrame:
    """Outliers of log amounts."""
    return rel.tukey_flag(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5).select("o_orderkey", "outlier")


@query("SELECT event_id, least(value, (SELECT quantile_disc(value, 0.999) FROM events)) AS value FROM events")
def winsorize_p999(t: Tables) -> DataFrame:
    """P10: the upper tail capped."""
    return rel.winsorize(t.events.select("event_id", "value"), "value", 0.999)


@query("""WITH c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE o_totalprice > 0) AS n1, count(*) FILTER (WHERE o_totalprice > 0 AND o_orderdate BETWEEN '1996-01-01' AND '2000-12-31') AS n2,
count(*) FILTER (WHERE o_totalprice > 0 AND o_orderdate BETWEEN '1996-01-01' AND '2000-12-31' AND NOT o_orderstatus = 'P') AS n3 FROM orders)
SELECT 1 AS step_no, 'positive amount' AS step, n0 AS rows_in, n1 AS rows_out FROM c UNION ALL SELECT 2, 'in period', n1, n2 FROM c UNION ALL SELECT 3, 'settled', n2, n3 FROM c""")
def cleaning_log(t: Tables) -> DataFrame:
    """Rows in and out of each filter, in one pass."""
    steps = [("positive amount", F.col("o_totalprice") > 0), ("in period", F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("2000-12-31").cast("timestamp"))), ("settled", ~(F.col("o_orderstatus") == "P"))]
    return rel.cleaning_log(t.orders, steps)


@query(
    f"""WITH n AS (SELECT s_suppkey, s_name || ' S.A.C. é' AS raw FROM supplier)
SELECT s_suppkey, upper(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS repaired,
trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(translate(upper(raw), '{text.ACCENTED}', '{text.PLAIN}'), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '{text.legal_pattern()}', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM n"""
)
def text_normalize(t: Tables) -> DataFrame:
    """Repaired and normalised names."""
    raw = F.concat("s_name", F.lit(" S.A.C. é"))
    return t.supplier.select("s_suppkey", text.repair(raw).alias("repaired"), text.legal_name(raw).alias("normal"))


LEVELS = [("^[0-2]", "low"), ("(URGENT|HIGH)", "high"), ("MEDIUM", "mid")]


@query("SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[0-2]') THEN 'low' WHEN regexp_matches(o_orderpriority, '(URGENT|HIGH)') THEN 'high' WHEN regexp_matches(o_orderpriority, 'MEDIUM') THEN 'mid' ELSE 'other' END AS level FROM orders")
def regex_level(t: Tables) -> DataFrame:
    """The first pattern that matches names the class."""
    return t.orders.select("o_orderkey", text.classify(F.col("o_orderpriority"), LEVELS, "other").alias("level"))


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '20' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 1 THEN '10-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '4') ELSE 'X' || c_custkey END AS code FROM customer)
SELECT c_custkey, code, CASE WHEN regexp_matches(d, '^20[0-9]{9}$') THEN 'company' WHEN regexp_matches(d, '^1[057][0-9]{9}$') THEN 'person' WHEN regexp_matches(d, '^[0-9]{6,7}$') THEN 'local' ELSE 'foreign' END AS kind,
coalesce(TRY_CAST(nullif(regexp_replace(code, '[^0-9-]', '', 'g'), '') AS BIGINT), -1) AS number FROM (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM c)""")
def identifier_kinds(t: Tables) -> DataFrame:
    """Identifiers typed by their digits, and parsed."""
    k, padded = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    code = F.when(k % 4 == 0, F.concat(F.lit("20"), padded)).when(k % 4 == 1, F.concat(F.lit("10-"), padded)).when(k % 4 == 2, F.lpad(k.cast("string"), 7, "4")).otherwise(F.concat(F.lit("X"), k.cast("string")))
    return t.customer.select("c_custkey", code.alias("code")).select("c_custkey", "code", text.id_kind(F.col("code")).alias("kind"), F.coalesce(text.digits_only(F.col("code")), F.lit(-1)).alias("number"))


@query("SELECT lang, count(*) FILTER (WHERE contains(text, 'é')) AS acute, count(*) FILTER (WHERE contains(text, '&')) AS amp, count(*) FILTER (WHERE length(text) >= 1000) AS long FROM documents GROUP BY 1")
def residual_characters(t: Tables) -> DataFrame:
    """Rows with suspicious characters."""
    return t.documents.groupBy("lang").agg(F.count_if(F.contains("text", F.lit("é"))).alias("acute"), F.count_if(F.contains("text", F.lit("&"))).alias("amp"), F.count_if(F.length("text") >= 1000).alias("long"))


@query("""WITH r AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 1 + n_nationkey / 10.0 END AS rate FROM nation),
g AS (SELECT quantile_disc(rate, 0.5) AS m FROM r)
SELECT s_suppkey, round(s_acctbal * coalesce(r.rate, g.m), 4) AS converted FROM supplier LEFT JOIN r ON s_nationkey = k CROSS JOIN g""")
def currency_conversion(t: Tables) -> DataFrame:
    """Own rate, else the median rate."""
    rates = t.nation.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 5 != 0, 1 + F.col("n_nationkey") / 10.0).alias("rate"))
    middle = rates.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rate)").alias("m"))
    return t.supplier.join(rates, F.col("s_nationkey") == F.col("k"), "left").crossJoin(F.broadcast(middle)).select("s_suppkey", F.round(F.col("s_acctbal") * F.coalesce("rate", "m"), 4).alias("converted"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_mktsegment, n_name, coalesce(lines, 0) AS lines, coalesce(amount, 0.0) AS amount, lines IS NOT NULL AS awarded
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON o_orderkey = l_orderkey""")
def star_join(t: Tables) -> DataFrame:
    """Orders with customer, nation and line totals; missing totals are 0."""
    sums = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    out = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.withColumn("awarded", F.col("lines").isNotNull()).na.fill(0, ["lines", "amount"]).select("o_orderkey", "c_mktsegment", "n_name", "lines", "amount", "awarded")


@query("""SELECT count(*) FILTER (WHERE NOT a) AS orders_without_lines, count(*) FILTER (WHERE a) AS orders_with_lines FROM (SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS a FROM orders)""")
def anti_join_links(t: Tables) -> DataFrame:
    """Counterparts present and missing, by semi and anti joins."""
    keys = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    missing = t.orders.join(keys, "o_orderkey", "left_anti").agg(F.count("*").alias("orders_without_lines"))
    return missing.crossJoin(t.orders.join(keys, "o_orderkey", "left_semi").agg(F.count("*").alias("orders_with_lines")))


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT coalesce(s.k, c.k) AS nation, n_suppliers, n_customers FROM s FULL JOIN c ON s.k = c.k""")
def outer_join_modes(t: Tables) -> DataFrame:
    """Full outer join of two summaries."""
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return s.join(t.customer.filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers")), "nation", "outer")


@query("""SELECT k AS kind, id, balance, extra FROM (SELECT 'customer' AS k, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS extra FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier)""")
def union_missing_cols(t: Tables) -> DataFrame:
    """Union by name with missing columns null."""
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("extra"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("""WITH a AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, CAST(sum(1) AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def two_way_except(t: Tables) -> DataFrame:
    """U4: rows of either side that the other lacks."""
    a = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    b = t.orders.filter("o_orderstatus <> 'P'").groupBy("o_orderpriority").agg(F.sum(F.lit(1)).alias("n"))
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


@query("""WITH d AS (SELECT l_orderkey, max(l_linenumber) AS top_line, count(DISTINCT l_linenumber) AS numbers, count(*) AS n, round(max(l_extendedprice), 2) AS header FROM lineitem GROUP BY 1) SELECT * FROM d""")
def order_rollup_from_lines(t: Tables) -> DataFrame:
    """A header taken as max of repeated values, with a control count."""
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top_line"), F.count_distinct("l_linenumber").alias("numbers"), F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("header"))


@query("""SELECT o_orderkey, CAST(sum(c) OVER w AS BIGINT) AS cum_cents, row_number() OVER w AS place FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def running_amount(t: Tables) -> DataFrame:
    """Cumulative amount in date order by priority (in whole cents)."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return t.orders.select("o_orderkey", F.sum(cents).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_cents"), F.row_number().over(w).alias("place").cast("long"))


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 49 PRECEDING) AS BIGINT) AS errors FROM events""")
def rolling_last_n(t: Tables) -> DataFrame:
    """Errors among a user's last 50 events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-49, 0)
    return t.events.select("event_id", F.sum((F.col("event_type") == "error").cast("int")).over(w).alias("errors"))


@query("""SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS rank_min,
round((rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0) / count(*) OVER (PARTITION BY s_nationkey), 6) AS pct FROM supplier""")
def rank_min_pct(t: Tables) -> DataFrame:
    """Least rank, and percentile rank with ties averaged."""
    by = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    ties, all_rows = F.count("*").over(Window.partitionBy("s_nationkey", "s_acctbal")), F.count("*").over(Window.partitionBy("s_nationkey"))
    return t.supplier.select("s_suppkey", F.rank().over(by).cast("long").alias("rank_min"), F.round((F.rank().over(by) + (ties - 1) / 2.0) / all_rows, 6).alias("pct"))


@query("""WITH r AS (SELECT c_mktsegment, o_totalprice AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) AS i FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0)
SELECT c_mktsegment, count(*) AS n, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 6) AS gini FROM r GROUP BY 1 HAVING count(*) >= 50""")
def gini_by_segment(t: Tables) -> DataFrame:
    """Inequality of amounts by segment."""
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_totalprice")
    return rel.gini(df, ["c_mktsegment"], "o_totalprice", 50).withColumn("gini", F.round("gini", 6))


@query("""WITH r AS (SELECT c_custkey, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY v, c_custkey) AS i, count(*) OVER () AS n, sum(v) OVER (ORDER BY v, c_custkey ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS share FROM r),
p AS (SELECT unnest(range(1, 201)) AS pt) SELECT CAST(pt AS INT) AS point, round(i / n, 6) AS population, round(share, 6) AS share FROM p JOIN k ON i = greatest(1, (pt * n) // 200)""")
def lorenz_curve(t: Tables) -> DataFrame:
    """200 points of the Lorenz curve of customers' amounts."""
    sums = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    whole = sums.agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    points = whole.select("n", "total", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("point")).withColumn("rank", F.greatest(F.lit(1), F.expr("(point * n) div 200")))
    ranked = rel.range_ranks(sums, "v", "c_custkey")
    return points.join(ranked, "rank").select("point", F.round(F.col("rank") / F.col("n"), 6).alias("population"), F.round(F.col("running") / F.col("total"), 6).alias("share"))


@query("""WITH r AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, o_custkey) AS i, count(*) OVER () AS n FROM r)
SELECT CAST(p AS INT) AS pct, CAST(max(greatest(1, n * p // 100)) AS BIGINT) AS customers, round(sum(v) FILTER (WHERE i <= greatest(1, n * p // 100)) / sum(v), 6) AS share FROM k, (VALUES (1), (5), (10), (25)) AS x(p) GROUP BY p""")
def top_share(t: Tables) -> DataFrame:
    """Share of the top 1, 5, 10 and 25 percent of customers."""
    sums = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    whole = sums.agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    cut = whole.select("n", "total", F.explode(F.array(*map(F.lit, (1, 5, 10, 25)))).alias("pct")).withColumn("rank", F.greatest(F.lit(1), F.expr("(n * pct) div 100")))
    ranked = rel.range_ranks(sums, "v", "o_custkey", descending=True)
    return cut.join(ranked, "rank").select("pct", F.col("rank").alias("customers"), F.round(F.col("running") / F.col("total"), 6).alias("share"))


@query("SELECT CAST(least(floor((log10(o_totalprice) - 2) / (4 / 43.0)) + 1, 43) AS INT) AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 AND log10(o_totalprice) BETWEEN 2 AND 6 GROUP BY 1")
def log_histogram(t: Tables) -> DataFrame:
    """43 log-spaced bins."""
    return rel.count_log_bins(t.orders, "o_totalprice", 2.0, 6.0, 43)


@query("""WITH o AS (SELECT l_suppkey, l_orderkey, sum(l_extendedprice) AS m, count(*) AS lines, min(l_shipdate) AS f, max(l_shipdate) AS x, avg(l_discount) AS d FROM lineitem GROUP BY ALL),
w AS (SELECT l_orderkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(m, 2) DESC, l_suppkey) AS r FROM o) WHERE r = 1),
c AS (SELECT l_suppkey, o_custkey, sum(m) AS m FROM o JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
a AS (SELECT l_suppkey, count(*) AS participations, round(sum(m), 2) AS amount, round(avg(m), 4) AS mean_amount, quantile_disc(round(m, 2), 0.5) AS median_amount, CAST(sum(lines) AS BIGINT) AS lines, CAST(date_diff('day', min(f), max(x)) AS INT) AS active_days FROM o GROUP BY 1)
SELECT a.*, coalesce(wins, 0) AS wins, round(coalesce(wins, 0) / greatest(participations, coalesce(wins, 0)), 6) AS win_rate, customers, round(top, 6) AS top_customer_share, round(hhi, 6) AS customer_hhi FROM a
LEFT JOIN (SELECT l_suppkey, count(*) AS wins FROM w GROUP BY 1) USING (l_suppkey) JOIN (SELECT l_suppkey, count(*) AS customers, max(m) / sum(m) AS top, sum(m * m) / (sum(m) * sum(m)) AS hhi FROM c GROUP BY 1) USING (l_suppkey)""")
def supplier_features(t: Tables) -> DataFrame:
    """One feature row for each supplier."""
    per_order = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_extendedprice").alias("m"), F.count("*").alias("lines"), F.min("l_shipdate").alias("f"), F.max("l_shipdate").alias("x"))
    won = rel.first_per_group(per_order.withColumn("_m", F.round("m", 2)), ["l_orderkey"], [F.desc("_m"), F.col("l_suppkey")]).groupBy("l_suppkey").agg(F.count("*").alias("wins"))
    served = per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    spread = rel.hhi(served, "l_suppkey", "o_custkey", "m").join(served.groupBy("l_suppkey").agg(F.count_distinct("o_custkey").alias("customers")), "l_suppkey")
    base = per_order.groupBy("l_suppkey").agg(
        F.count("*").alias("participations"), F.round(F.sum("m"), 2).alias("amount"), F.round(F.avg("m"), 4).alias("mean_amount"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY round(m, 2))").alias("median_amount"), F.sum("lines").alias("lines"), F.datediff(F.max("x"), F.min("f")).alias("active_days"),
    )
    out = base.join(won, "l_suppkey", "left").na.fill(0, ["wins"]).join(spread, "l_suppkey")
    rate = F.round(F.col("wins") / F.greatest("participations", "wins"), 6)
    return out.select(*base.columns, "wins", rate.alias("win_rate"), "customers", F.round("top_share", 6).alias("top_customer_share"), F.round("hhi", 6).alias("customer_hhi"))


@query("""WITH w AS (SELECT o_custkey, o_orderkey, l_suppkey, sum(l_extendedprice) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
p AS (SELECT o_custkey, l_suppkey, sum(m) AS m FROM w GROUP BY ALL)
SELECT o_custkey, o.orders, o.amount, suppliers, round(hhi, 6) AS supplier_hhi, round(top, 6) AS top_supplier_share FROM (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1) o
JOIN (SELECT o_custkey, count(*) AS suppliers, sum(m * m) / (sum(m) * sum(m)) AS hhi, max(m) / sum(m) AS top FROM p GROUP BY 1) USING (o_custkey)""")
def customer_features_hhi(t: Tables) -> DataFrame:
    """Entity features with supplier concentration."""
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    spread = rel.hhi(lines, "o_custkey", "l_suppkey", "l_extendedprice").join(lines.groupBy("o_custkey").agg(F.count_distinct("l_suppkey").alias("suppliers")), "o_custkey")
    own = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    return own.join(spread, "o_custkey").select("o_custkey", "orders", "amount", "suppliers", F.round("hhi", 6).alias("supplier_hhi"), F.round("top_share", 6).alias("top_supplier_share"))


INTERACTION = "SELECT o_custkey AS r, l_suppkey AS c, CAST(year(o_orderdate) AS INT) AS y, count(DISTINCT o_orderkey) AS n, round(sum(l_extendedprice), 2) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"


def interaction(t: Tables) -> DataFrame:
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("r"), F.col("l_suppkey").alias("c"), F.year("o_orderdate").alias("y")).agg(F.count_distinct("o_orderkey").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query(INTERACTION)
def interaction_long(t: Tables) -> DataFrame:
    """The interaction matrix in long form."""
    return interaction(t)


@query(f"""WITH i AS ({INTERACTION}), f AS (SELECT *, min(y) OVER (PARTITION BY r, c) AS fy FROM i)
SELECT y, count(*) AS pairs, count(*) FILTER (WHERE fy < y) AS persistent, round(count(*) FILTER (WHERE fy < y) / count(*), 6) AS share, round(coalesce(sum(n) FILTER (WHERE fy < y), 0) / sum(n), 6) AS share_n, round(coalesce(sum(amount) FILTER (WHERE fy < y), 0) / sum(amount), 6) AS share_amount FROM f GROUP BY 1""")
def pair_persistence(t: Tables) -> DataFrame:
    """Pairs seen in an earlier year."""
    i = interaction(t)
    seen = i.withColumn("old", F.min("y").over(Window.partitionBy("r", "c")) < F.col("y"))
    part = lambda v: F.round(F.sum(F.when(F.col("old"), v).otherwise(0)) / F.sum(v), 6)
    return seen.groupBy("y").agg(F.count("*").alias("pairs"), F.count_if("old").alias("persistent"), part(F.lit(1)).alias("share"), part(F.col("n")).alias("share_n"), part(F.col("amount")).alias("share_amount"))


@query(f"""WITH i AS (SELECT DISTINCT r, c FROM ({INTERACTION})), d AS (SELECT r, count(*) AS degree FROM i GROUP BY 1), h AS (SELECT degree, count(*) AS n FROM d GROUP BY 1), s AS (SELECT count(*) / (count(DISTINCT r) * count(DISTINCT c)) AS density FROM i)
SELECT degree, n, round(sum(n) OVER (ORDER BY degree DESC) / sum(n) OVER (), 6) AS ccdf, round(density, 6) AS density FROM h, s""")
def matrix_density(t: Tables) -> DataFrame:
    """Degrees of the matrix's rows as CCDF, and its density."""
    cells = interaction(t).select("r", "c").distinct()
    density = cells.agg((F.count("*") / (F.count_distinct("r") * F.count_distinct("c"))).alias("density"))
    counted = cells.groupBy("r").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("degree")))  # one row for each degree
    return counted.select("degree", "n", F.round(above / F.sum("n").over(Window.partitionBy()), 6).alias("ccdf")).crossJoin(F.broadcast(density)).withColumn("density", F.round("density", 6))


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderdate >= '1997-01-01' GROUP BY 1")
def sql_view_aggregate(t: Tables) -> DataFrame:
    """SQL over a temporary view."""
    t.orders.createOrReplaceTempView("quarry_orders")
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM quarry_orders WHERE o_orderdate >= timestamp'1997-01-01' GROUP BY o_orderstatus")


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def region_rollup(t: Tables) -> DataFrame:
    """Map-side combined sums over joins with small tables."""
    small = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.lineitem.join(small, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT CAST(label AS INT) AS label, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS q1, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS q0 FROM (SELECT toxic AS label, quality FROM labels) GROUP BY 1")
def label_crosstab(t: Tables) -> DataFrame:
    """Two labelings against each other."""
    return t.labels.groupBy(F.col("toxic").alias("label")).pivot("quality", [0, 1]).count().na.fill(0).select("label", F.col("1").alias("q1"), F.col("0").alias("q0"))


@query("""SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS median, quantile_disc(l_extendedprice, 0.25) AS q1, quantile_disc(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1""")
def group_medians(t: Tables) -> DataFrame:
    """Quantiles that are elements of their group."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY l_extendedprice)")
    return t.lineitem.groupBy("l_returnflag").agg(at(0.5).alias("median"), at(0.25).alias("q1"), at(0.75).alias("q3"))


@query(f"SELECT event_id, {sql_hash('event_id', 3)} AS h FROM events")
def portable_hashes(t: Tables) -> DataFrame:
    """A keyed hash that any engine gives."""
    return t.events.select("event_id", portable_hash(F.col("event_id"), 3).alias("h"))
