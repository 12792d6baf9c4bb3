"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests of normalised texts, bucketed and sorted by digest.  A batch is
hashed in its scan, grouped by digest (partial sums first, so that a text with a third of all rows costs
one row a task), held against the index by a sort-merge anti-join, and what is new is appended.  All of
it is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators.joins import join_counted

from .common import ASCII_SPACE, id_and_text, materialize, scratch_path, without


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


class DigestIndex:
    """Digests of all texts ingested so far, each with the id of the document that stays."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        """Open table ``name``, whose files are at ``path`` (below the shared folder if not given).

        A catalogue that doesn't know the table gets it, over the files that are there, if any: an index
        outlives a session by its path, name and number of buckets.
        """
        self.spark = spark
        self.name = name or f"quirespark_digests_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or scratch_path(spark, "digests")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _append(self, rows: DataFrame) -> None:
        """A task for each bucket, so that a batch adds one sorted file to it."""
        dealt = rows.repartition(self.buckets, "digest")
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def close(self) -> None:
        """Have the catalogue forget the table; its files stay, and so do results of ``ingest``."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the batch's new texts; ``doc_id, keep_id, group_size, kept, text_sha256`` for each row.

        ``keep_id`` is the smallest id among equal texts of the batch, or the one that the index had for
        the text before; ``group_size`` counts the batch's rows with that text; ``kept`` holds for rows
        whose id is ``keep_id``, so that a batch that is ingested again gives what it gave.  Null texts
        count as empty.  Repeated rows of one id and text stay or go together.  A null id never stays
        unless its text has no other.  An empty batch gives no rows and appends none.  Further columns
        are ignored.
        """
        hashed = materialize(
            id_and_text(docs, id_col, text_col).select("doc_id", digest(F.col("text")).alias("digest")),
            "hashed",
        )
        groups = materialize(
            hashed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "groups"
        )
        fresh = groups.hint("merge").join(self.read(), "digest", "left_anti")
        self._append(materialize(fresh.select("digest", F.col("first_id").alias("keep_id")), "fresh"))
        # By now the index holds each of the batch's digests, with the id that stays.
        resolved = materialize(groups.hint("merge").join(self.read(), "digest").select("digest", "keep_id", "group_size"), "resolved")
        rows = join_counted(hashed, resolved, "digest", hashed.count(), "group_size")
        stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return rows.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay (see ``DigestIndex.ingest``).

    The verdict is on an id and a text: of several rows with one id, or without, but different texts, each
    stays or goes by its own text.  Repeated rows of one id and text stay or go together; a null text is an
    empty one; an empty table gives no rows; columns may have any names.
    """
    index, own = (index, False) if index else (DigestIndex(docs.sparkSession), True)
    verdict = index.ingest(docs, id_col, text_col)
    dropped = verdict.where("not kept").select("doc_id", F.unhex("text_sha256").alias("mark"))
    kept = without(docs, dropped, id_col, digest(F.col(text_col).cast("string")))
    if own:
        index.close()
    return kept
