"""Writers for tables, score sets and entity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = "\t") -> None:
    """Parquet by default; `fmt="csv"` writes delimited text with a header."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str, by: str = "clf") -> None:
    """Long score table, one folder per classifier, so that readers prune by it."""
    scores.write.mode("overwrite").partitionBy(by).parquet(path)


def write_entities(df: DataFrame, path: str, column: str = "entity_id") -> None:
    """One entity per line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
