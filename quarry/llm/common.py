"""Scratch tables, cut lineage and batch helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: later plans start there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._quarry_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on between tasks and stages, and shares its executor's memory with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(run: Callable[..., pd.DataFrame]) -> Callable[..., pd.DataFrame]:
    """run, a function of one or two groups, with its memory given back after each."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out = run(frame)
        release_memory()
        return out

    def two(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = run(left, right)
        release_memory()
        return out

    return one if len(inspect.signature(run).parameters) == 1 else two


def pieces(frames: Iterator[pd.DataFrame], column: str, max_chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of at most max_chars characters (at least one row each), so that memory doesn't follow the row count."""
    for frame in frames:
        size = frame[column].str.len().fillna(0).to_numpy()
        run = (size.cumsum() // max_chars).astype("int64") if len(size) else size
        if len(run) and run[-1] != run[0]:
            for _, part in frame.groupby(run, sort=True):
                yield part.reset_index(drop=True)
        elif len(run):
            yield frame
        del frame
    release_memory()
