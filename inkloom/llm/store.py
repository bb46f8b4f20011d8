"""Tables in the shared folder, and the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which every executor reaches."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "step", codec: str | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: one computation, short lineage, safe when executors go."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
