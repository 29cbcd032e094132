"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.plans.registry import Tables, query
from quarry.streaming import events as ev


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_counts(t: Tables) -> DataFrame:
    """Counts by day and type."""
    return ev.tumbling(t.events)


@query("SELECT date_trunc('day', ts) - INTERVAL 1 DAY * d AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, (SELECT unnest(range(0, 7)) AS d) GROUP BY ALL")
def sliding_counts(t: Tables) -> DataFrame:
    """Counts over seven days, each day."""
    return ev.tumbling(t.events, "7 days", slide="1 day")


@query("WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def session_counts(t: Tables) -> DataFrame:
    """Sessions that end after half an hour of silence."""
    return ev.sessions(t.events)


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_seen_dedup(t: Tables) -> DataFrame:
    """The first event of each user and type."""
    return ev.first_seen(t.events, ["user_id", "event_type"])
