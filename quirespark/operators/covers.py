"""Cover images: which identifier of a record leads to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import cover_url

#: Identifier types in order of trial; the least size of an image that isn't a blank.
PRIORITY, LEAST_BYTES = ("ISBN", "OCLC", "LCCN"), 100


def cover_candidates(identifiers: DataFrame, record: str = "record_pk", base_url: str = "https://covers.example.org/b") -> DataFrame:
    """``record, priority, url``: of each type the first value."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("identifier_type"))
    first = identifiers.where(F.col("identifier_type").isin(*PRIORITY) & (F.col("value") != "")).groupBy(record, "identifier_type").agg(F.min("value").alias("value"))
    return first.select(record, rank.cast("int").alias("priority"), cover_url(F.col("identifier_type"), F.col("value"), base_url).alias("url"))


def best_covers(candidates: DataFrame, sizes: DataFrame, record: str = "record_pk") -> DataFrame:
    """``record, cover_url``: the first candidate whose image (``url, body_size``) is large enough."""
    valid = candidates.join(sizes.where(F.col("body_size") >= LEAST_BYTES).select("url").distinct(), "url")
    return valid.groupBy(record).agg(F.min_by("url", "priority").alias("cover_url"))


def without_cover(records: DataFrame, identifiers: DataFrame, record: str = "record_pk") -> DataFrame:
    """Records with identifiers but no cover yet."""
    return records.where(F.col("cover_url") == "").join(identifiers.select(record), record, "left_semi")


def wanted_covers(records: DataFrame, identifiers: DataFrame, record: str = "record_pk", base_url: str = "https://covers.example.org/b") -> DataFrame:
    """Candidates of the records without a cover, for ``sources.sru.first_covers``."""
    wanting = without_cover(records, identifiers, record).select(record)
    return cover_candidates(identifiers.join(wanting, record, "left_semi"), record, base_url)


def backfill(records: DataFrame, identifiers: DataFrame, sizes: DataFrame, record: str = "record_pk", base_url: str = "https://covers.example.org/b") -> DataFrame:
    """``record, cover_url`` that records without a cover would get: a report, and the changes for an upsert."""
    return best_covers(wanted_covers(records, identifiers, record, base_url), sizes, record)
