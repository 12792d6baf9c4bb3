"""Connected components of an edge table, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.operators.joins import join_counted

from .common import materialize


def _toward_least(pairs: DataFrame, rows: int, larger_only: bool) -> DataFrame:
    """For each ``u``: edges from its partners ``v`` (only larger ones, if asked) to the least of ``u`` and all ``v``."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_counted(pairs, least, "u", rows)
    return joined.where(F.col("v") > F.col("u")) if larger_only else joined


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u long, v long``): the least node it is linked with.

    Large-star and small-star steps in turn, until nothing changes; each round is written to the shared
    folder.  Edges of a node to itself, repeated and reversed ones are no matter; no edges, no rows.
    """
    table = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(rounds):
        count, mark = table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == (count, mark) or not count:
            break
        state = (count, mark)
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, 2 * count, True).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        small = _toward_least(large, large.count(), False)
        table = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
            .where("u <> v")
            .distinct(),
            "small",
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
