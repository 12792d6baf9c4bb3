"""A catalogue's tables in one place, changed together or not at all.

Each table is kept in buckets of its key; a change writes the buckets that it touches to fresh folders,
and one version file then names them for all tables at once (see ``Versions``).  A change that fails on
its way leaves the old state in full; of two at one time the second begins again from what the first made,
so that a name is created once and a number given once, whoever asks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.operators.ingest import get_or_create, upsert

from .versions import Versions

#: Rows that a bucket of a table is laid out for.
BUCKET_ROWS = 1_000_000


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Draft:
    """The tables as a change sees and alters them; nobody else does until it is published."""

    def __init__(self, catalogue: Catalogue, state: dict):
        self.catalogue, self.spark = catalogue, catalogue.spark
        self.state = {"tables": {n: dict(t) for n, t in state.get("tables", {}).items()}}

    def create(self, name: str, rows: DataFrame, key: str, pk: str | None = None) -> None:
        """A new table, or a table anew.  ``pk``: its column of numbers, given by ``get_or_create``."""
        count = rows.count()
        highest = (rows.agg(F.max(pk)).first()[0] or 0) if pk else 0
        held = {"key": key, "pk": pk, "highest": highest, "schema": rows.schema.json(), "folders": [None] * (1 + count // BUCKET_ROWS)}
        self.state["tables"][name] = held
        self._write(name, rows)

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.state["tables"][name]["schema"]))

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, or those in some of its buckets."""
        folders = self.state["tables"][name]["folders"]
        paths = [f"{self.catalogue.path}/{f}" for i, f in enumerate(folders) if f and (buckets is None or i in buckets)]
        schema = self._schema(name)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, touched: list[int] | None = None) -> None:
        table = self.state["tables"][name]
        buckets = len(table["folders"])
        folder = self.catalogue.versions.fresh(name)
        columns = [f.name for f in self._schema(name).fields]
        bucketed = rows.select(*columns, _bucket(F.col(table["key"]), buckets).alias("__bucket"))
        bucketed.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.catalogue.path}/{folder}")
        made = set(self.catalogue.versions.below(folder))
        table["folders"] = [
            (f"{folder}/__bucket={i}" if f"__bucket={i}" in made else None) if touched is None or i in touched else old for i, old in enumerate(table["folders"])
        ]

    def _touched(self, name: str, keys: DataFrame, column: str | None = None) -> list[int]:
        """Buckets of the keys (first column), or of rows that hold them in another ``column``."""
        table = self.state["tables"][name]
        keys = keys.select(F.col(keys.columns[0]).alias("__k"))
        if column and column != table["key"]:
            keys = self.read(name).join(keys, F.col(column) == F.col("__k"), "left_semi").select(F.col(table["key"]).alias("__k"))
        return [r[0] for r in keys.select(_bucket(F.col("__k"), len(table["folders"])).alias("b")).distinct().collect()]

    def upsert(self, name: str, changes: DataFrame) -> None:
        """Rows replaced or added by key; columns that ``changes`` lacks keep their values."""
        key = self.state["tables"][name]["key"]
        touched = self._touched(name, changes.select(key))
        self._write(name, upsert(self.read(name, touched), changes, key), touched)

    def delete(self, name: str, ids: DataFrame, column: str | None = None) -> None:
        """Without the rows that hold one of ``ids`` (first column) as their key, or in ``column``."""
        column = column or self.state["tables"][name]["key"]
        touched = self._touched(name, ids, column)
        gone = ids.select(F.col(ids.columns[0]).alias("__k"))
        self._write(name, self.read(name, touched).join(gone, F.col(column) == F.col("__k"), "left_anti"), touched)

    def unlink(self, name: str, ids: DataFrame, column: str) -> None:
        """``column`` becomes null where it holds one of ``ids``."""
        touched = self._touched(name, ids, column)
        gone = ids.select(F.col(ids.columns[0]).alias("__k")).distinct().withColumn("__gone", F.lit(True))
        marked = self.read(name, touched).join(gone, F.col(column) == F.col("__k"), "left")
        self._write(name, marked.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))), touched)

    def get_or_create(self, name: str, incoming: DataFrame) -> DataFrame:
        """Create the keys of ``incoming`` that the table lacks, with the next numbers; returns the rows of
        all of its keys."""
        table = self.state["tables"][name]
        key, pk = table["key"], table["pk"]
        touched = self._touched(name, incoming.select(key))
        held = self.read(name, touched)
        # The highest number is the table's, not that of the buckets at hand.
        base = self.spark.createDataFrame([(None, table["highest"])], T.StructType([self._schema(name)[key], T.StructField(pk, T.LongType())]))
        fresh = get_or_create(held.select(key, F.lit(0).cast("long").alias(pk)).unionByName(base.where(f"{pk} > 0")), incoming, key, pk)
        folder = self.catalogue.versions.fresh(f"{name}-new")
        fresh.write.parquet(f"{self.catalogue.path}/{folder}")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{self.catalogue.path}/{folder}")
        table["highest"] += fresh.count()
        self._write(name, held.unionByName(fresh, allowMissingColumns=True), touched)
        return self.read(name, touched).join(incoming.select(key).distinct(), key, "left_semi")


class Catalogue:
    """Tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)

    def read(self, name: str) -> DataFrame:
        return Draft(self, self.versions.current()[1]).read(name)

    def change(self, fn: Callable[[Draft], None]) -> None:
        """Publish what ``fn`` does to a draft, in one step; if another change was first, ``fn`` runs again."""

        def attempt(state: dict) -> dict:
            draft = Draft(self, state)
            fn(draft)
            return draft.state

        self.versions.change(attempt)

    def delete_records(self, ids: DataFrame, cascading: dict[str, str], nulling: dict[str, str]) -> None:
        """Records (ids in the first column) go from all tables at once: rows of ``cascading`` tables (by
        their column of the record) vanish, in ``nulling`` ones the column becomes null."""

        def drop(draft: Draft) -> None:
            for name, column in cascading.items():
                draft.delete(name, ids, column)
            for name, column in nulling.items():
                draft.unlink(name, ids, column)

        self.change(drop)

    def vacuum(self, older_than_seconds: float = 86_400) -> int:
        """Delete folders that no kept version names."""

        def named(state: dict) -> set[str]:
            return {"/".join(f.split("/")[:2]) for t in state.get("tables", {}).values() for f in t["folders"] if f}

        return self.versions.vacuum(named, older_than_seconds)
