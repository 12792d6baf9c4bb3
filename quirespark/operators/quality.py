"""Data quality and retention: punctuation clean-up with a report, staged files, discarded scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import blank_if_null, strip_marc_punctuation


def punctuation_changes(df: DataFrame, table: str, key: str, fields: list[str]) -> DataFrame:
    """``table_name, key, field, old_value, new_value`` for each field that cleaning would change."""
    entries = [F.struct(F.lit(f).alias("field"), blank_if_null(F.col(f)).alias("old_value"), strip_marc_punctuation(F.col(f)).alias("new_value")) for f in fields]
    return df.select(F.lit(table).alias("table_name"), F.col(key).alias("key"), F.inline(F.array(*entries))).where("old_value <> new_value")


def clean_punctuation(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({f: strip_marc_punctuation(F.col(f)) for f in fields})


def change_counts(changes: DataFrame) -> DataFrame:
    """``table_name, n`` with a last row ``total``."""
    counted = changes.rollup("table_name").agg(F.count(F.lit(1)).alias("n"), F.grouping("table_name").alias("g"))
    return counted.select(F.when(F.col("g") == 1, "total").otherwise(F.col("table_name")).alias("table_name"), "n")


def retained(scans: DataFrame, now, days: int = 30, status: str = "status", updated: str = "updated_at") -> DataFrame:
    """Scans without those discarded and untouched for longer than ``days``."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return scans.where(~((F.col(status) == "discarded") & (F.col(updated) < cutoff)) | F.col(updated).isNull())


def stale_files(files: DataFrame, now, days: int = 30) -> DataFrame:
    """Paths of files (as ``binaryFile`` lists them) not modified for longer than ``days``."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return files.where(F.col("modificationTime") < cutoff).select("path", "modificationTime", "length")
