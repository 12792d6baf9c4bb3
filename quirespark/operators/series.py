"""Series: volume specifications, missing volumes, new volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.durable import written
from quirespark.functions.text import blank_if_null, trimmed


#: Numbers that one array holds at most.
MOST = 10_000
#: Numbers of a series that are looked at together.
_STRETCH = 4096


def _span(spec: Column) -> tuple[Column, Column]:
    """The first and last number of a range, nulls for a list."""
    text = trimmed(blank_if_null(spec))
    everything = F.regexp_extract(text, r"(?i)^all\s+(\d+)$", 1).try_cast("int")
    low = F.regexp_extract(text, r"^(\d+)\s*-\s*(\d+)$", 1).try_cast("int")
    high = F.regexp_extract(text, r"^(\d+)\s*-\s*(\d+)$", 2).try_cast("int")
    return F.when(everything.isNotNull(), F.lit(1)).otherwise(low).cast("long"), F.coalesce(everything, high).cast("long")


def volume_numbers(spec: Column) -> Column:
    """Numbers as texts: ``all 3`` and ``1-3`` are ranges (empty if they run backwards), else a list with
    commas, blanks left out.  Null for a range of more than ``MOST`` numbers, which ``volume_rows`` has."""
    low, high = _span(spec)
    wide = high - low >= MOST
    none = F.array().cast("array<string>")
    numbers = F.transform(F.sequence(low, F.when(wide, low).otherwise(F.greatest(low, high))), lambda n: n.cast("string"))
    listed = F.filter(F.transform(F.split(trimmed(blank_if_null(spec)), ","), trimmed), lambda p: p != "")
    span = F.when(wide, F.lit(None)).when(high >= low, numbers).otherwise(none)
    return F.when(low.isNotNull() & high.isNotNull(), span).otherwise(listed)


def volume_rows(specs: DataFrame, spec: str = "spec", volume: str = "volume_number") -> DataFrame:
    """``specs`` with a row for each number of its specification, in the column ``volume``.

    A wide range is first dealt out in stretches, so that no array holds it and many tasks share it.
    """
    own = [F.col(c) for c in specs.columns if c != spec]
    low, high = _span(F.col(spec))
    wide = high - low >= MOST
    narrow = specs.where(~F.coalesce(wide, F.lit(False))).select(*own, F.explode(volume_numbers(F.col(spec))).alias(volume))
    begun = specs.where(wide).select(*own, high.alias("__high"), F.explode(F.sequence(low, high, F.lit(MOST).cast("long"))).alias("__low")).repartition("__low")
    stretch = F.sequence("__low", F.least(F.col("__low") + MOST - 1, F.col("__high")))
    return narrow.unionByName(begun.select(*own, F.explode(F.transform(stretch, lambda n: n.cast("string"))).alias(volume)))


def _stretches(volumes: DataFrame, series: str, number: str) -> DataFrame:
    """``series, low, high, inner``: a series' numbers a few thousand at a time, and the ranges missing between them."""
    whole = F.regexp_extract(F.col(number), r"(?U)^\s*([+-]?[0-9]+)\s*$", 1).try_cast("int").cast("long")
    numbers = volumes.select(series, whole.alias("n")).where("n IS NOT NULL")
    held = numbers.groupBy(series, F.floor(F.col("n") / _STRETCH).alias("stretch")).agg(F.array_sort(F.collect_set("n")).alias("had"))
    between = F.zip_with(F.slice("had", 1, F.size("had") - 1), F.slice("had", 2, F.size("had") - 1), lambda x, y: F.struct((x + 1).alias("first"), (y - 1).alias("last")))
    inner = F.filter(between, lambda g: g["first"] <= g["last"])
    return held.select(series, F.element_at("had", 1).alias("low"), F.element_at("had", -1).alias("high"), inner.alias("inner"))


def gap_ranges(volumes: DataFrame, series: str = "series_pk", number: str = "volume_number") -> DataFrame:
    """``series, first, last``: the ranges of numbers that a series lacks between its least and greatest.

    Nothing is expanded.  Numbers that aren't whole (in 32 bits) are passed over.  A series' numbers are
    looked at in stretches of a few thousand, whose ends are then put in order, a million at most, so that
    one series may have any share of the rows.
    """
    stretches = _stretches(volumes, series, number)
    before = F.lag("high").over(Window.partitionBy(series).orderBy("low"))
    outer = stretches.select(series, (before + 1).alias("first"), (F.col("low") - 1).alias("last"))
    return stretches.select(series, F.inline("inner")).unionByName(outer.where("first <= last"))


def gaps(volumes: DataFrame, series: str = "series_pk", number: str = "volume_number", most: int = MOST) -> DataFrame:
    """``series, missing``: numbers between a series' least and greatest that it lacks, ascending.

    Series without gaps are left out; of one that lacks more than ``most`` numbers the array is null, and
    ``gap_ranges`` has them.
    """
    own = Window.partitionBy(series)
    size = lambda g: g["last"] - g["first"] + 1
    before = F.lag("high").over(own.orderBy("low"))
    outer = F.when(before + 1 < F.col("low"), F.array(F.struct((before + 1).alias("first"), (F.col("low") - 1).alias("last"))))
    found = _stretches(volumes, series, number).select(series, F.concat(F.coalesce(outer, F.slice("inner", 1, 0)), "inner").alias("gaps"))
    counted = found.withColumn("n", F.sum(F.aggregate("gaps", F.lit(0).cast("long"), lambda s, g: s + size(g))).over(own))
    few = F.transform(F.flatten(F.transform("gaps", lambda g: F.sequence(g["first"], g["last"]))), lambda n: n.cast("int"))
    parts = counted.where("n > 0").withColumn("missing", F.when(F.col("n") <= most, few))
    missing = F.when(F.max("n") <= most, F.array_sort(F.flatten(F.collect_list("missing")))).alias("missing")  # nulls aren't collected
    return parts.groupBy(series).agg(missing)


def new_volumes(specs: DataFrame, existing: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``series_pk, volume_number, record_pk, held`` for each volume asked for that doesn't exist yet.

    ``specs``: series_pk, spec; ``existing``: series_pk, volume_number; ``records``: series_pk,
    volume_number, record_pk of records that are at hand, of which the smallest counts.  A volume with a
    record is held.
    """
    # Written, as the plan would else hold every existing volume and record against the specifications' patterns.
    asked = written(volume_rows(specs.select("series_pk", "spec")).distinct(), "asked")
    new = asked.join(existing.select("series_pk", "volume_number"), ["series_pk", "volume_number"], "left_anti")
    if records is None:
        new = new.withColumn("record_pk", F.lit(None).cast("long"))
    else:
        # The smallest is taken of what was asked for only, which may be far less than all records.
        at_hand = records.select("series_pk", "volume_number", "record_pk")
        new = new.join(at_hand, ["series_pk", "volume_number"], "left").groupBy("series_pk", "volume_number").agg(F.min("record_pk").alias("record_pk"))
    return new.withColumn("held", F.col("record_pk").isNotNull())


def series_info(title: Column, volume: Column) -> Column:
    """``struct(title, volume)`` of a candidate, null without a title."""
    name = trimmed(blank_if_null(title))
    return F.when(name != "", F.struct(name.alias("title"), trimmed(blank_if_null(volume)).alias("volume")))
