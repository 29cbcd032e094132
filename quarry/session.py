"""One place where sessions get their settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; names in `settings` have _ for dots (spark_driver_memory="8g")."""
    builder = SparkSession.builder.master(master) if master else SparkSession.builder
    for name, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: What plan_facts counts in the text of a physical plan.
FACTS = {
    "exchanges": r"(?<!Broadcast)Exchange (?:hash|range|Single|Round)",
    "broadcasts": r"BroadcastExchange",
    "broadcast_joins": r"BroadcastHashJoin",
    "merge_joins": r"SortMergeJoin",
    "python": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMap(?:Co)?GroupsInPandas",
    "pushed_filters": r"PushedFilters: \[[^\]]",
}


def plan_facts(df: DataFrame) -> dict[str, int]:
    """How often the physical plan of df exchanges, broadcasts, joins by each strategy, leaves the JVM and filters in a scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {name: len(re.findall(pattern, plan)) for name, pattern in FACTS.items()}
