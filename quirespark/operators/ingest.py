"""From reviewed candidates to records: assembly, identifiers, get-or-create, review states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.durable import durable
from quirespark.functions.text import blank_if_null, date_display, record_id, slug, strict_int, strip_marc_punctuation, trimmed, year_of

#: Which field of a candidate becomes which type of identifier.
IDENTIFIER_FIELDS = (("isbn", "ISBN"), ("lccn", "LCCN"), ("oclc", "OCLC"), ("lc_classification", "LCC"), ("dewey_classification", "DDC"))


def get_or_create(dimension: DataFrame, incoming: DataFrame, key: str, pk: str = "pk") -> DataFrame:
    """Rows of ``incoming`` whose key the dimension lacks, each key once, with the next primary keys in
    order of the keys.

    New keys are numbered by sorted ranges with running totals, not in one task.  Columns of ``incoming``
    besides the key are taken from the row that sorts first.
    """
    others = [c for c in incoming.columns if c != key]
    fresh = incoming.where(blank_if_null(F.col(key)) != "").join(dimension.select(key), key, "left_anti")
    first = F.min_by(F.struct(*others), F.struct(*others)) if others else None
    once = fresh.groupBy(key).agg(first.alias("__rest")).select(key, "__rest.*") if others else fresh.select(key).distinct()
    highest = dimension.agg(F.coalesce(F.max(pk), F.lit(0).cast("long")).alias("__highest"))
    return numbered(once, [F.col(key)], "__n").crossJoin(F.broadcast(highest)).withColumn(pk, F.col("__highest") + F.col("__n")).drop("__n", "__highest")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with dense numbers from 1 in the order given: each range of the sorted rows is numbered on
    its own and moved up by the sizes of the ranges before.  No task sorts more than a range."""
    ranged = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    local = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    return local.join(F.broadcast(bases), "__part").withColumn(name, F.col("__at") + F.col("__base")).drop("__part", "__at", "__base")


def add_pairs(bridge: DataFrame, incoming: DataFrame) -> DataFrame:
    """The bridge with further pairs, none twice."""
    return bridge.unionByName(incoming.select(*bridge.columns)).dropDuplicates()


def identifiers(candidates: DataFrame, record: str = "record_pk") -> DataFrame:
    """``record, identifier_type, value`` of each identifier that a candidate has."""
    pairs = [F.struct(F.lit(kind).alias("identifier_type"), trimmed(blank_if_null(F.col(f))).alias("value")) for f, kind in IDENTIFIER_FIELDS if f in candidates.columns]
    return candidates.select(record, F.inline(F.array(*pairs))).where("value <> ''").distinct()


def relations(candidates: DataFrame, column: str, record: str = "record_pk", name: str = "name") -> DataFrame:
    """``record, name`` of each entry of an array column, without field punctuation or blanks."""
    return candidates.select(record, F.explode(column).alias("__v")).select(record, strip_marc_punctuation(F.col("__v")).alias(name)).where(f"{name} <> ''").distinct()


def _clean(column: str) -> Column:
    return strip_marc_punctuation(F.col(column))


def records_from_candidates(candidates: DataFrame) -> DataFrame:
    """Records as they are made when a candidate is confirmed at once: a year is read from any date text,
    and the text is kept where there is none.  The vernacular title goes to ``title_romanized``, as ever."""
    return candidates.select(
        *(c for c in candidates.columns if c in ("record_pk", "source_catalog")),
        _clean("title").alias("title"), _clean("title_alternate").alias("title_romanized"), _clean("place").alias("place_of_publication"),
        blank_if_null(F.col("language")).alias("language"), year_of(F.col("date")).alias("date_of_publication"),
        date_display(F.col("date")).alias("date_of_publication_display"),
    )


def records_from_queue(candidates: DataFrame) -> DataFrame:
    """Records as they are made from the review queue: only a bare number counts as a year, and no text
    of the date is kept."""
    return candidates.select(
        *(c for c in candidates.columns if c in ("record_pk", "source_catalog")),
        _clean("title").alias("title"), _clean("title_alternate").alias("title_romanized"), _clean("place").alias("place_of_publication"),
        blank_if_null(F.col("language")).alias("language"), strict_int(F.col("date")).alias("date_of_publication"),
    )


def from_forms(entries: DataFrame) -> dict[str, DataFrame]:
    """Filled-in forms (see ``schemas.MANUAL_ENTRY``) as tables: ``record``, and for each relation its pairs
    of ``record_pk`` and name; relations hold several names, one a line."""

    def names(column: str) -> DataFrame:
        each = F.explode(F.split(blank_if_null(F.col(column)), "\n"))
        return entries.select("record_pk", each.alias("n")).select("record_pk", strip_marc_punctuation(F.col("n")).alias("name")).where("name <> ''").distinct()

    record = entries.select(
        "record_pk", _clean("title").alias("title"), _clean("title_romanized").alias("title_romanized"), _clean("subtitle").alias("subtitle"),
        strict_int(F.col("date_of_publication")).alias("date_of_publication"), blank_if_null(F.col("date_display")).alias("date_of_publication_display"),
        _clean("place").alias("place_of_publication"), blank_if_null(F.col("language")).alias("language"), blank_if_null(F.col("notes")).alias("notes"),
    )
    return {"record": record} | {r: names(r) for r in ("authors", "subjects", "publishers", "locations", "isbns")}


def with_public_ids(records: DataFrame, pk: str = "pk", prefix: str = "rec-") -> DataFrame:
    """Records with ``record_id`` and, where it is empty, ``slug``."""
    made = slug(F.col("title_romanized"), F.col("title"))
    kept = F.col("slug") if "slug" in records.columns else F.lit("")
    return records.withColumns({"record_id": record_id(F.col(pk), prefix), "slug": F.when(blank_if_null(kept) != "", kept).otherwise(made)})


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with rows replaced or added by key; columns that ``changes`` lacks keep their values."""
    changed = changes.select(key, *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key), F.lit(True).alias("__changed"))
    joined = table.join(changed, key, "full_outer")
    return joined.select(*(
        F.col(c) if c == key or c not in changes.columns else F.when(F.col("__changed"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in table.columns
    ))


def delete_records(ids: DataFrame, tables: dict[str, DataFrame], cascading: tuple[str, ...], nulling: tuple[str, ...], key: str = "record_pk") -> dict[str, DataFrame]:
    """All tables after records are deleted: rows of ``cascading`` tables go, in ``nulling`` ones the key becomes null."""
    gone = ids.select(key).distinct()
    out = dict(tables)
    for name in cascading:
        out[name] = tables[name].join(gone, key, "left_anti")
    for name in nulling:
        marked = tables[name].join(gone.withColumn("__gone", F.lit(True)), key, "left")
        out[name] = marked.withColumn(key, F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(key))).select(*tables[name].columns)
    return out


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key, all columns."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *sorted(o for o in others if o != order))).alias("__last")).select(key, "__last.*")


def queue_of(scans: DataFrame, user: int | str, staff: bool, owner: str = "scanned_by", status: str = "status") -> DataFrame:
    """Pending scans that a user may see: staff see all."""
    pending = scans.where(F.col(status) == "pending")
    return pending if staff else pending.where(F.col(owner) == user)
