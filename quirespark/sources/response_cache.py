"""A cache of responses: the latest entry of a key counts, until it is too old.

What is stored goes to a tail of small folders; a tail of more than ``TAIL`` is merged with the base, which
holds each key once, in buckets of its key, sorted.  A version file names base and tail.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

TTL_SECONDS = 30 * 24 * 60 * 60
_ENTRY = "cache_key string, data string, stored_at timestamp, ttl_seconds long"


class ResponseCache:
    """A cache below ``path``, which many jobs may use at a time."""

    TAIL = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.versions = Versions(spark, self.path)

    def _log(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """All that the base (of some buckets) and the tail hold, with the order of storing."""
        parts = [self.spark.createDataFrame([], _ENTRY).withColumn("turn", F.lit(0))]
        if state.get("base"):
            base = self.spark.read.schema(f"{_ENTRY}, bucket int").parquet(f"{self.path}/{state['base']}")
            base = base if buckets is None else base.where(F.col("bucket").isin(*buckets))
            parts.append(base.drop("bucket").withColumn("turn", F.lit(0)))
        for turn, name in enumerate(state.get("tail", []), 1):
            parts.append(self.spark.read.schema(_ENTRY).parquet(f"{self.path}/{name}").withColumn("turn", F.lit(turn)))
        return functools.reduce(DataFrame.unionByName, parts[1:] or parts)

    def _latest(self, log: DataFrame) -> DataFrame:
        entry = F.struct("data", "stored_at", "ttl_seconds")
        return log.groupBy("cache_key").agg(F.max_by(entry, F.struct("stored_at", "turn")).alias("e")).select("cache_key", "e.*")

    def _bucket(self):
        return F.pmod(F.xxhash64("cache_key"), F.lit(self.buckets)).cast("int")

    def entries(self, now=None, buckets: list[int] | None = None) -> DataFrame:
        """``cache_key, data`` of entries that hold at ``now``."""
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        fresh = F.col("stored_at") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)")) > at
        return self._latest(self._log(self.versions.current()[1], buckets)).where(fresh & F.col("data").isNotNull()).select("cache_key", "data")

    def put(self, responses: DataFrame, now=None, ttl_seconds: int = TTL_SECONDS) -> None:
        """Store ``cache_key, data``."""
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        name = self.versions.fresh("tail")
        rows = responses.select("cache_key", "data", at.alias("stored_at"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"))
        rows.write.parquet(f"{self.path}/{name}")
        state = self.versions.change(lambda s: {"base": s.get("base"), "tail": [*s.get("tail", []), name]})
        if len(state["tail"]) > self.TAIL:
            self.compact(now)

    def compact(self, now=None) -> None:
        """Merge the tail into the base, without entries that no longer hold.

        What is stored meanwhile stays in the tail; a merge of another job meanwhile makes this one void.
        """
        _, state = self.versions.current()
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        fresh = F.col("stored_at") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)")) > at
        name, taken = self.versions.fresh("base"), state.get("tail", [])
        live = self._latest(self._log(state)).where(fresh & F.col("data").isNotNull()).withColumn("bucket", self._bucket())
        live.repartition("bucket").sortWithinPartitions("bucket", "cache_key").write.partitionBy("bucket").parquet(f"{self.path}/{name}")

        def switch(now: dict) -> dict | None:
            if now.get("base") != state.get("base") or now.get("tail", [])[: len(taken)] != taken:
                return None
            return {"base": name, "tail": now["tail"][len(taken) :]}

        self.versions.change(switch)

    def invalidate(self, keys: DataFrame, now=None) -> None:
        """Store that the keys hold nothing."""
        self.put(keys.select("cache_key", F.lit(None).cast("string").alias("data")), now)

    def clear(self) -> None:
        self.versions.change(lambda _: {"base": None, "tail": []})

    def misses(self, requested: DataFrame, now=None) -> DataFrame:
        """Requests whose key has no entry; only their buckets of the base are read."""
        buckets = [r[0] for r in requested.select(self._bucket()).distinct().collect()]  # as many as there are buckets
        return requested.join(self.entries(now, buckets).hint("merge"), "cache_key", "left_anti")

    def vacuum(self, older_than_seconds: float = 86_400) -> int:
        """Delete folders that no kept version names."""
        return self.versions.vacuum(lambda s: {n for n in (s.get("base"), *s.get("tail", [])) if n}, older_than_seconds)
