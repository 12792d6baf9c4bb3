"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.durable import scratch_path

#: The white space that the normalisations of this subpackage know.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of a row group that a task holds in memory while it writes.
ROW_GROUP = 16 << 20
#: Rows that a worker's function works on at a time.
ROWS_AT_ONCE = 512


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read again: what follows never recomputes it, also
    when executors are lost, and sees the same rows each time."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for a context, so that their Python finds it."""
    context = spark.sparkContext
    if getattr(context, "_quirespark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="quirespark-")) / "quirespark_source.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._quirespark_shipped = True


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: T.StructType | str
) -> DataFrame:
    """``df.mapInArrow`` for a function of one batch; batches without rows are left out.

    The function gets a share of what Spark hands over at a time, so that results, here and on their way
    back, are small whatever the size of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                out = fn(whole.slice(at, ROWS_AT_ONCE))
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, as ``doc_id`` and ``text``; a null text becomes empty.

    Other columns, also ones named like an operator's results, are left behind here.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def id_remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    text = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % F.lit(mod)


#: Bytes of a list of rows to be left out that are broadcast; a longer one is joined by sort and merge.
DROP_LIST = 32 << 20


def without(docs: DataFrame, dropped: DataFrame, id_col: str, mark: Column, row_bytes: int = 64) -> DataFrame:
    """The rows of ``docs`` but for those whose id (nulls being equal) and ``mark`` are a row of ``dropped``.

    ``dropped`` has columns ``doc_id, mark``.  It is written down and counted; one that is short goes
    to where the rows are, so that texts aren't shuffled, any other is joined by sort and merge.
    """
    listed = materialize(dropped.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "dropped")
    small = listed.count() * row_bytes <= DROP_LIST
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (mark == F.col("__mark"))
    return docs.join(F.broadcast(listed) if small else listed.hint("merge"), on, "left_anti")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The column's values one by one, without a list of them all."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""
