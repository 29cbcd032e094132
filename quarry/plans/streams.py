"""Sampling and stream summaries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import sql_hash
from quarry.operators import sketches as sk
from quarry.plans.registry import Tables, query

UNIT = float(1 << 60)


@query(f"SELECT event_id, user_id FROM events WHERE {sql_hash('user_id', 5)} / {UNIT} < 0.1")
def key_sample(t: Tables) -> DataFrame:
    """All events of a tenth of the users."""
    return sk.key_sample(t.events, "user_id", 0.1, 5).select("event_id", "user_id")


@query(f"SELECT event_id, user_id FROM events WHERE {sql_hash('event_id', 6)} / {UNIT} < 0.1")
def event_sample(t: Tables) -> DataFrame:
    """A tenth of the events."""
    return sk.row_sample(t.events, "event_id", 0.1, 6).select("event_id", "user_id")


@query(f"SELECT event_id, value FROM events ORDER BY {sql_hash('event_id', 7)}, event_id LIMIT 500")
def bottom_k_sample(t: Tables) -> DataFrame:
    """A uniform sample of 500 events."""
    return sk.bottom_k(t.events, "event_id", 500, 7).select("event_id", "value")


@query(f"""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {sql_hash('event_id', 8)}, event_id) AS r FROM events) WHERE r <= 25""")
def stratified_sample(t: Tables) -> DataFrame:
    """25 events of each type, by hash order."""
    from quarry.functions.hashing import portable_hash

    place = F.row_number().over(Window.partitionBy("event_type").orderBy(portable_hash(F.col("event_id"), 8), "event_id"))
    return t.events.withColumn("r", place).filter("r <= 25").select("event_type", "event_id")


@query(f"""WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), k AS (SELECT user_id, count(*) AS n FROM events WHERE {sql_hash('user_id', 5)} / {UNIT} < 0.1 GROUP BY 1), e AS (SELECT user_id, count(*) AS n FROM events WHERE {sql_hash('event_id', 6)} / {UNIT} < 0.1 GROUP BY 1)
SELECT 'by key' AS sample, count(*) AS users, round(avg(CASE WHEN k.n = a.n THEN 1.0 ELSE 0.0 END), 6) AS complete FROM k JOIN a USING (user_id) UNION ALL SELECT 'by event', count(*), round(avg(CASE WHEN e.n = a.n THEN 1.0 ELSE 0.0 END), 6) FROM e JOIN a USING (user_id)""")
def sample_completeness(t: Tables) -> DataFrame:
    """Share of sampled users that kept all their events."""
    whole = t.events.groupBy("user_id").agg(F.count("*").alias("all_n"))
    parts = {"by key": sk.key_sample(t.events, "user_id", 0.1, 5), "by event": sk.row_sample(t.events, "event_id", 0.1, 6)}
    out = [
        df.groupBy("user_id").agg(F.count("*").alias("n")).join(whole, "user_id").agg(F.lit(name).alias("sample"), F.count("*").alias("users"), F.round(F.avg((F.col("n") == F.col("all_n")).cast("double")), 6).alias("complete"))
        for name, df in parts.items()
    ]
    return out[0].unionByName(out[1])


@query(f"""WITH a AS (SELECT event_type, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM events GROUP BY 1), s AS (SELECT event_type, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM events WHERE {sql_hash('event_id', 6)} / {UNIT} < 0.1 GROUP BY 1)
SELECT event_type, round(coalesce(a.pct, 0), 6) AS stream_pct, round(coalesce(s.pct, 0), 6) AS sample_pct, round(max(abs(coalesce(a.pct, 0) - coalesce(s.pct, 0))) OVER (), 6) AS worst FROM a FULL JOIN s USING (event_type)""")
def sample_drift(t: Tables) -> DataFrame:
    """Composition of the sample against the stream."""

    def mix(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy("event_type").agg(F.count("*").alias("n"))
        return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("t")))).select("event_type", (100.0 * F.col("n") / F.col("t")).alias(name))

    both = mix(t.events, "a").join(mix(sk.row_sample(t.events, "event_id", 0.1, 6), "s"), "event_type", "outer").na.fill(0.0)
    worst = F.max(F.abs(F.col("a") - F.col("s"))).over(Window.partitionBy())  # one row for each type
    return both.select("event_type", F.round("a", 6).alias("stream_pct"), F.round("s", 6).alias("sample_pct"), F.round(worst, 6).alias("worst"))


RATE = 0.01  # of false positives, for filters and sketches sized by their counted keys
INSERTED = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'"
BLOOM_SIZE = f"bz AS (SELECT bits, CAST(greatest(1, round(bits / n * ln(2))) AS BIGINT) AS hashes FROM (SELECT n, CAST(ceil(-n * ln({RATE}) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM (SELECT greatest(count(*), 1) AS n FROM ({INSERTED}))))"


def pending(t: Tables) -> DataFrame:
    """Customers with pending orders: the keys that the filters hold."""
    return t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()


def bloom_sql(keys: str, name: str) -> str:
    step = "CASE WHEN h2 = 0 THEN 1 ELSE h2 END"
    return f"{name} AS (SELECT DISTINCT k, (h1 + i * {step}) % bits AS bit FROM (SELECT k, bits, {sql_hash('k', 1)} % bits AS h1, {sql_hash('k', 2)} % bits AS h2, unnest(range(0, hashes)) AS i FROM ({keys}), bz))"


@query(f"WITH {BLOOM_SIZE}, {bloom_sql(INSERTED, 'b')} SELECT DISTINCT CAST(bit AS BIGINT) AS bit FROM b")
def bloom_build(t: Tables) -> DataFrame:
    """The bits that customers with pending orders set, of a filter sized by their number."""
    keys = pending(t)
    return sk.bloom_build(keys, "c_custkey", *sk.bloom_size(keys.count(), RATE))


@query(f"""WITH {BLOOM_SIZE}, {bloom_sql(INSERTED, 'b')}, {bloom_sql('SELECT c_custkey AS k FROM customer', 'p')}, s AS (SELECT DISTINCT bit FROM b),
r AS (SELECT k, count(*) = count(s.bit) AS maybe FROM p LEFT JOIN s USING (bit) GROUP BY 1) SELECT k AS c_custkey, maybe, k IN ({INSERTED}) AS member FROM r""")
def bloom_probe(t: Tables) -> DataFrame:
    """Membership of all customers, against the truth."""
    keys = pending(t)
    size = sk.bloom_size(keys.count(), RATE)
    found = sk.bloom_probe(t.customer, "c_custkey", sk.bloom_build(keys, "c_custkey", *size), *size)
    return found.join(keys.withColumn("_in", F.lit(True)), "c_custkey", "left").select("c_custkey", "maybe", F.coalesce("_in", F.lit(False)).alias("member"))


DEPTH = 4


def cms_size(keys: str) -> str:
    return f"cz AS (SELECT CAST(ceil(greatest(count(DISTINCT k), 1) / -ln(1 - {RATE} ** (1.0 / {DEPTH}))) AS BIGINT) AS width FROM ({keys}))"


def cms_cells(keys: str) -> str:
    return " UNION ALL ".join(f"SELECT k, {d} AS r, {sql_hash('k', 100 + d)} % width AS c FROM ({keys}), cz" for d in range(DEPTH))


def cms_sql(source: str) -> str:
    return f"{cms_size(source)}, cells AS ({cms_cells(source)}), sketch AS (SELECT r, c, count(*) AS n FROM cells GROUP BY ALL), est AS (SELECT k, min(n) AS estimate FROM (SELECT DISTINCT k, r, c FROM cells) JOIN sketch USING (r, c) GROUP BY 1)"


@query(f"WITH {cms_sql('SELECT user_id AS k FROM events')}, tr AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) SELECT k AS user_id, n, CAST(estimate AS BIGINT) AS estimate FROM tr JOIN est USING (k)")
def cms_estimate(t: Tables) -> DataFrame:
    """Events by user, true and estimated by a sketch that is sized by the number of users."""
    true = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    width = sk.cms_width(true.filter("user_id is not null").count(), RATE, DEPTH)
    return true.join(sk.cms_estimate(t.events, "user_id", sk.cms_build(t.events, "user_id", width, DEPTH), width, DEPTH), "user_id")


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events), d AS (SELECT unnest(range(1, 9)) AS d), s AS (SELECT CAST(d AS INT) AS d, CAST(ceil(n / -ln(1 - 0.01 ** (1.0 / d))) AS BIGINT) AS w FROM d, n)
SELECT d, w, CAST(d * w * 8 AS BIGINT) AS bytes, d * w * 8 = min(d * w * 8) OVER () AS best FROM s""")
def cms_membership_sizing(t: Tables) -> DataFrame:
    """T4: the smallest count-min table for membership at 1 percent."""
    sized = t.events.agg(F.count_distinct("user_id").alias("n")).select("n", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("d"))
    sized = sized.withColumn("w", F.ceil(F.col("n") / -F.log(1 - F.pow(F.lit(0.01), 1.0 / F.col("d")))))
    return sized.select("d", "w", (F.col("d") * F.col("w") * 8).alias("bytes"), (F.col("d") * F.col("w") == F.min(F.col("d") * F.col("w")).over(Window.partitionBy())).alias("best"))


@query(f"""WITH {cms_sql(INSERTED)}, {BLOOM_SIZE}, {bloom_sql(INSERTED, 'b')}, {bloom_sql('SELECT c_custkey AS k FROM customer', 'p')}, s AS (SELECT DISTINCT bit FROM b), r AS (SELECT k, count(*) = count(s.bit) AS maybe FROM p LEFT JOIN s USING (bit) GROUP BY 1),
pc AS ({cms_cells('SELECT c_custkey AS k FROM customer')}), m AS (SELECT pc.k, min(coalesce(n, 0)) > 0 AS maybe FROM pc LEFT JOIN sketch USING (r, c) GROUP BY 1),
x AS (SELECT 'bloom' AS structure, k, maybe FROM r UNION ALL SELECT 'count-min', k, maybe FROM m)
SELECT structure, count(*) FILTER (WHERE maybe AND k NOT IN ({INSERTED})) AS false_positives, count(*) FILTER (WHERE NOT maybe AND k IN ({INSERTED})) AS false_negatives FROM x GROUP BY 1""")
def bloom_vs_cms(t: Tables) -> DataFrame:
    """T5: both structures, sized for the same keys and rate, on one membership task."""
    keys = pending(t)
    held = keys.count()
    size, width = sk.bloom_size(held, RATE), sk.cms_width(held, RATE, DEPTH)
    bloom = sk.bloom_probe(t.customer, "c_custkey", sk.bloom_build(keys, "c_custkey", *size), *size).select(F.lit("bloom").alias("structure"), "c_custkey", "maybe")
    cms = sk.cms_estimate(t.customer, "c_custkey", sk.cms_build(keys, "c_custkey", width, DEPTH), width, DEPTH).select(F.lit("count-min").alias("structure"), "c_custkey", (F.col("estimate") > 0).alias("maybe"))
    both = bloom.unionByName(cms).join(keys.withColumn("_in", F.lit(True)), "c_custkey", "left")
    return both.groupBy("structure").agg(F.count_if(F.col("maybe") & F.col("_in").isNull()).alias("false_positives"), F.count_if(~F.col("maybe") & F.col("_in").isNotNull()).alias("false_negatives"))


@query()
def dgim_window(t: Tables) -> DataFrame:
    """Errors among each user's last 50 events, by DGIM and exactly; sequential, so tested against the exact count."""
    bits = t.events.select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bit"))
    found = sk.dgim_by_key(bits, "user_id", ["ts", "event_id"], "bit", 50)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    exact = bits.withColumn("r", place).filter("r <= 50").groupBy("user_id").agg(F.count_if("bit").alias("exact"))
    return found.join(exact, "user_id")


@query(f"""WITH s AS (SELECT * FROM events ORDER BY {sql_hash('event_id', 7)}, event_id LIMIT 500), b AS (SELECT max(ts) - INTERVAL 7 DAY AS f, count(*) AS n FROM events)
SELECT count(*) AS sampled, count(*) FILTER (WHERE ts > f AND event_type = 'error') AS hits, round(count(*) FILTER (WHERE ts > f AND event_type = 'error') * max(n) / count(*), 4) AS estimate,
(SELECT count(*) FROM events, b WHERE ts > f AND event_type = 'error') AS exact FROM s, b""")
def window_by_sample(t: Tables) -> DataFrame:
    """Errors of the last week from a uniform sample, scaled."""
    bound = t.events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("f"), F.count("*").alias("n"))
    hit = (F.col("ts") > F.col("f")) & (F.col("event_type") == "error")
    exact = t.events.crossJoin(F.broadcast(bound)).agg(F.count_if(hit).alias("exact"))
    found = sk.bottom_k(t.events, "event_id", 500, 7).crossJoin(F.broadcast(bound)).agg(F.count("*").alias("sampled"), F.count_if(hit).alias("hits"), F.max("n").alias("n"))
    return found.crossJoin(exact).select("sampled", "hits", F.round(F.col("hits") * F.col("n") / F.col("sampled"), 4).alias("estimate"), "exact")
