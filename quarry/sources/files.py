"""CSV packages, Parquet, artifacts and memoized tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_packages(spark: SparkSession, paths: dict[str, str], columns: list[str], **options: str) -> DataFrame:
    """CSV packages of one table, all columns as text: those of `columns` that a package has, with `package` telling which.

    A quote within quotes is doubled. Missing columns are null. Options go to the reader (sep, encoding, multiLine, nullValue).
    """
    out = None
    for name, path in paths.items():
        raw = spark.read.options(header="true", quote='"', escape='"', inferSchema="false", **options).csv(path)
        one = raw.select(*[c for c in columns if c in raw.columns]).withColumn("package", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    have = out.columns
    return out.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in [*columns, "package"]])


def read_text_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A table with another separator and encoding, multi-line fields and `NA` for null."""
    return spark.read.schema(schema).options(header="true", sep=sep, encoding=encoding, multiLine="true", nullValue="NA", quote='"', escape='"').csv(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Overwrite a Parquet table partitioned by a column; rows of one value are gathered first, so files stay few."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def export(df: DataFrame, folder: str, name: str, description: str) -> None:
    """A result as CSV and JSON lines, and a line in the folder's index."""
    df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")
    df.write.mode("overwrite").json(f"{folder}/{name}.json")
    line = df.sparkSession.createDataFrame([(name, description, time.time())], "name string, description string, at double")
    line.write.mode("append").json(f"{folder}/index")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def changed_at(spark: SparkSession, path: str) -> int:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).getModificationTime()


def memoized(spark: SparkSession, path: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made again if it isn't complete or is older than its source."""
    done = f"{path}/_SUCCESS"
    if not exists(spark, done) or changed_at(spark, done) < changed_at(spark, source):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
