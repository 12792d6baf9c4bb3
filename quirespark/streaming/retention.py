"""States that go when their time comes: event-time timers on a stream's state.

Discarded scans are forgotten a while after they were discarded, cached answers when they are too old.
Time is the stream's own: a timer fires once the watermark has passed it.  Events older than the watermark
that a batch begins with come too late and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirespark.shipping import ship

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Parts of the states that are read and written whole.  A call of the state store takes milliseconds, as long as
#: some thousands of states take within one value: with a value and a timer for each key, large batches waited for calls.
BUCKETS = 1024


class _Expiring(StatefulProcessor):
    """Keeps the last event of each key of a bucket, and forgets it ``after`` milliseconds if its status is one that ends.

    A bucket is one value of the state and has one timer, that of the first of its keys to go.
    """

    def __init__(self, key: T.StructField, after: int, ending: frozenset[str], gone: str):
        self.key, self.after, self.ending, self.gone = key, after, ending, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {"keys": self.key.dataType, "statuses": T.StringType(), "ats": T.LongType()}
        fields = [T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()]
        self.states = handle.getValueState("states", T.StructType([*fields, T.StructField("timer", T.LongType())]))

    def _held(self) -> tuple[dict, int | None]:
        """``(at, status)`` by key, and the time of the bucket's timer."""
        found = self.states.get()
        if found is None:
            return {}, None
        keys, statuses, ats, timer = found
        return dict(zip(keys, zip(ats, statuses, strict=True), strict=True)), timer

    def _ends(self, at: int) -> int:
        return at // 1000 + self.after

    def _hold(self, held: dict, timer: int | None) -> None:
        first = min((self._ends(at) for at, status in held.values() if status in self.ending), default=None)
        if first != timer and timer is not None:
            self.handle.deleteTimer(timer)
        if first != timer and first is not None:
            self.handle.registerTimer(first)
        if held:
            ats, statuses = zip(*held.values(), strict=True)
            self.states.update((list(held), list(statuses), list(ats), first))
        else:
            self.states.clear()

    def _rows(self, states: dict, status: str | None = None) -> pd.DataFrame:
        ats, statuses = zip(*states.values(), strict=True)
        return pd.DataFrame({self.key.name: list(states), "status": status or statuses, "at": ats})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        changed: dict = {}
        for batch in rows:
            for name, status, at in zip(batch[self.key.name], batch["status"], batch["at"], strict=True):
                last = changed.get(name) or held.get(name)
                if last is None or (at, status) > last:
                    changed[name] = (at, status)
        if changed:
            self._hold(held | changed, timer)
            yield self._rows(changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        fired, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        # Whatever else the watermark has passed goes with the first.
        passed = lambda end: end <= fired or end < mark
        gone = {name: (at, status) for name, (at, status) in held.items() if status in self.ending and passed(self._ends(at))}
        if gone:
            self._hold({name: last for name, last in held.items() if name not in gone}, None if timer == fired else timer)
            yield self._rows(gone, self.gone)

    def close(self) -> None:
        pass


def expiring_states(
    events: DataFrame, after: timedelta, ending: tuple[str, ...] = ("discarded",), gone: str = "expired",
    key: str = "scan_id", status: str = "status", at: str = "ts", delay: str = "1 hour", buckets: int = BUCKETS,
) -> DataFrame:
    """``key, status, at`` of each state that changes, of a stream of events: its last event, and ``gone``
    once an event of a status in ``ending`` has been the last for ``after``.

    Of events at one time the greatest status counts; rows without a key, a status or a time are passed
    over.  ``at`` of a state that is gone is that of its last event.  An event may come as long as
    ``delay`` after others with a later time.

    States are kept by bucket of the key's hash, ``buckets`` of them: a batch reads and writes the buckets
    that its events fall in, whole.  A stream's number of buckets stays what it was when it began.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # timers need it
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("status", T.StringType()), T.StructField("at", T.LongType())])
    known = events.where(F.col(key).isNotNull() & F.col(status).isNotNull() & F.col(at).isNotNull())
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket")
    timed = known.select(bucket, key, F.col(status).alias("status"), F.col(at).alias("__time"), F.unix_micros(at).alias("at")).withWatermark("__time", delay)
    processor = _Expiring(T.StructField(key, kind), int(after.total_seconds() * 1000), frozenset(ending), gone)
    states = timed.groupBy("__bucket").transformWithStateInPandas(processor, out, "Update", "eventTime")
    return states.select(key, "status", F.timestamp_micros("at").alias("at"))
