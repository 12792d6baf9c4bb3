"""The review queue as a stream of scan events; the latest event of a scan is its state."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirespark.operators.ingest import latest_state
from quirespark.sources.versions import Versions

#: Batches' folders that are read one by one before they are merged.
BATCHES = 16


def latest_status(events: DataFrame, key: str = "scan_id", status: str = "status", at: str = "ts") -> DataFrame:
    """``key, status, at`` of each scan's last event; of events at one time the greatest status counts.

    Works on a batch and on a stream alike (in complete or update mode).
    """
    last = F.max_by(F.struct(F.col(status).alias("status"), F.col(at).alias("at")), F.struct(F.col(at), F.col(status)))
    return events.groupBy(key).agg(last.alias("l")).select(key, F.col("l.status").alias(status), F.col("l.at").alias(at))


def upsert_states(events: DataFrame, path: str, checkpoint: str, key: str = "scan_id", at: str = "ts") -> StreamingQuery:
    """Keep the last event of each scan below ``path``; ``current_states`` reads them.

    The stream's state store holds the states, and a batch writes those that it changes, in a folder of its
    own; many folders are merged.  A batch that is run again after a failure writes its folder again.
    """
    return write_changes(latest_state(events, key, at), path, checkpoint, key)


def write_changes(states: DataFrame, path: str, checkpoint: str, key: str = "scan_id", gone: str | None = None) -> StreamingQuery:
    """Write the rows that each batch of ``states``, a stream in update mode, brings, the last of a key
    being its state; a state of status ``gone`` is none."""

    def write(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path)
        name = f"data/batch-{number:020d}"
        if number <= versions.current()[1].get("merged", -1):
            return  # this batch had been written, and merged, before
        batch.write.mode("overwrite").parquet(f"{path}/{name}")

        def add(state: dict) -> dict | None:
            return None if name in state.get("batches", []) else state | {"batches": [*state.get("batches", []), name]}

        state = versions.change(add)
        if len(state["batches"]) > BATCHES:
            _merge(batch.sparkSession, path, key, gone, number)

    query = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def _latest(spark: SparkSession, path: str, state: dict, key: str) -> DataFrame:
    names = [n for n in (state.get("base"), *state.get("batches", [])) if n]
    parts = [spark.read.parquet(f"{path}/{name}").withColumn("__turn", F.lit(turn)) for turn, name in enumerate(names)]
    rows = functools.reduce(DataFrame.unionByName, parts)
    others = [c for c in rows.columns if c not in (key, "__turn")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "__turn").alias("__last")).select(key, "__last.*")


def _merge(spark: SparkSession, path: str, key: str, gone: str | None, number: int) -> None:
    versions = Versions(spark, path)
    _, state = versions.current()
    name = versions.fresh("base")
    rows = _latest(spark, path, state, key)
    (rows if gone is None else rows.where(F.col("status") != gone)).write.parquet(f"{path}/{name}")
    versions.change(lambda now: {"base": name, "batches": [], "merged": number} if now == state else None)


def current_states(spark: SparkSession, path: str, key: str = "scan_id", gone: str | None = None) -> DataFrame | None:
    """The states after the last batch; None before the first."""
    _, state = Versions(spark, path).current()
    if not state:
        return None
    rows = _latest(spark, path, state, key)
    return rows if gone is None else rows.where(F.col("status") != gone)
