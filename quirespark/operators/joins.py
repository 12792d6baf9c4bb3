"""Joins that withstand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.durable import written

#: A key is hot if it has more than one in so many rows, so that fewer than this many keys are.
HOT_SHARE = 512


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: int, n: str = "n") -> DataFrame:
    """``left`` joined to ``right``, which has a bounded number of rows for each key and in ``n`` the key's
    rows in ``left``.

    The few hot keys (at most ``HOT_SHARE``, as they share ``rows`` rows) are joined by broadcast, where
    their rows are; all others by a shuffle that no key can unbalance.
    """
    most = rows // HOT_SHARE
    hot, cold = right.where(F.col(n) > most), right.where(F.col(n) <= most)
    return left.join(F.broadcast(hot), key).unionByName(
        left.join(F.broadcast(hot.select(key).distinct()), key, "left_anti").hint("merge").join(cold, key)
    )


#: Rows of a key that one task pairs, at least, before the key is cut.
BLOCK = 2000

#: Pairs of cut keys for each of which, roughly, there is a task, up to ``MOST_TASKS``.
TASK_PAIRS = 5_000_000
MOST_TASKS = 4 * HOT_SHARE


def dealt_blocks(left: DataFrame, right: DataFrame, on: list[str], least: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an inner join, dealt out so that rows meet if they agree in the columns given third: ``on``,
    and a cell of the key.

    A key with more than a block of rows on a side is cut into a grid, whose cells each pair a block of the one
    with a block of the other; a block has ``least`` rows, or more, so that fewer than ``HOT_SHARE`` keys are cut.
    Tasks are as many as their pairs ask for: by the few bytes of the rows, adaptive execution would merge them.
    """
    count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    sizes = count(left, "__left").join(count(right, "__right"), on, "full_outer").fillna(0, ["__left", "__right"])
    sizes = written(sizes.where((F.col("__left") > least) | (F.col("__right") > least)), "sizes")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n_left, n_right, pairs = sizes.agg(total(F.col("__left")), total(F.col("__right")), total(F.col("__left").cast("double") * F.col("__right"))).first()
    block = max(least, (n_left + n_right) // HOT_SHARE)
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")
    hot = sizes.where((F.col("__left") > block) | (F.col("__right") > block)).select(*on, blocks("__left").alias("__rows"), blocks("__right").alias("__columns"))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, int(pairs // TASK_PAIRS)))
    cell = [*on, "__row", "__column"]

    def dealt(df: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        share = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int")
        every: Column = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        found = df.join(F.broadcast(hot), on, "left").select(*df.columns, share.alias(own_block), every.alias(other_block))
        return found.repartition(tasks, *cell) if pairs > TASK_PAIRS else found

    return dealt(left, "__rows", "__columns", "__row", "__column"), dealt(right, "__columns", "__rows", "__column", "__row"), cell


def join_blocks(left: DataFrame, right: DataFrame, on: list[str], least: int = BLOCK) -> DataFrame:
    """An inner join that may give far more rows than it gets, as both sides may hold a key any number of times."""
    rows, columns, cell = dealt_blocks(left, right, on, least)
    return rows.join(columns.hint("merge"), cell).drop("__row", "__column")
