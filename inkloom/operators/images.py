"""What is known of an image beside the rows of its lines."""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = 64  # lines of a band
ROWS = 1 << 17  # rows of the given files whose lines make up a partition


@lru_cache(maxsize=16)
def _rows(spark: SparkSession, files: tuple[str, ...]) -> int:
    """Rows of Parquet files, from their footers."""
    return spark.read.schema("_ int").option("recursiveFileLookup", "true").parquet(*files).count()


def by_line(df: DataFrame, line: list[str]) -> DataFrame:
    """``df`` dealt by ``line`` over partitions that grow in number with the files it comes from; there are all shuffle partitions at least.

    A given number is not merged: positions pack so well that partitions merged by their bytes would hold many times the rows meant.
    """
    spark = df.sparkSession
    files = sorted(unquote(f) for f in df.inputFiles() if f.endswith(".parquet"))
    plain = tuple(f for f in files if not any(c in f for c in "*?[]{}\\"))  # others would be read as patterns
    rows = _rows(spark, plain) if plain else 0
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *line)


def with_image(df: DataFrame, facts: DataFrame, last: Column | None = None) -> DataFrame:
    """``df`` (image_id, y, ..) joined with ``facts``, the rows of its image; lines beyond ``last`` (h - 1) are no part of it.

    The facts are repeated once per band of lines and met by image and band, so neither the join nor a step after it runs
    in one task per image.
    """
    last = F.col("h") - 1 if last is None else last
    bands = facts.withColumn("_band", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), last) / LINES).cast("int"))))
    return df.withColumn("_band", F.floor(F.col("y") / LINES).cast("int")).join(bands, ["image_id", "_band"]).drop("_band")
