"""Schemas of the catalogue tables.  Text columns hold "" where there is nothing; numbers and keys hold null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType(), "t": T.TimestampType(), "a": T.ArrayType(T.StringType())}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


RECORD = _table(
    pk="l", record_id="s", slug="s", title="s", title_romanized="s", subtitle="s", date_of_publication="i", date_of_publication_display="s",
    place_of_publication="s", language="s", source_marc="s", source_catalog="s", cover_url="s", notes="s", created_by="l", created_at="t", updated_at="t",
)
AUTHOR = _table(pk="l", name="s", name_romanized="s", viaf_id="s", variant_names="a")
SUBJECT = _table(pk="l", heading="s", heading_romanized="s", source="s")
PUBLISHER = _table(pk="l", name="s", name_romanized="s", place="s")
SERIES = _table(pk="l", title="s", title_romanized="s", total_volumes="i", publisher_pk="l")
SERIES_VOLUME = _table(pk="l", series_pk="l", record_pk="l", volume_number="s", held="b")
LOCATION = _table(pk="l", label="s")
EXTERNAL_IDENTIFIER = _table(pk="l", record_pk="l", identifier_type="s", value="s")
TITLE_PAGE_IMAGE = _table(pk="l", record_pk="l", image="s", uploaded_at="t", staged="b")
API_USAGE = _table(pk="l", api="s", model="s", user_pk="l", created_at="t", input_tokens="i", output_tokens="i")
BRIDGE = _table(record_pk="l", other_pk="l")

MANUAL_ENTRY = _table(
    record_pk="l", title="s", title_romanized="s", subtitle="s", date_of_publication="s", date_display="s", place="s", language="s", notes="s",
    authors="s", subjects="s", publishers="s", locations="s", isbns="s",
)

#: What enumerated columns may hold.
SOURCE_CATALOGS = ("NLI", "LC", "DNB", "")
IDENTIFIER_TYPES = ("ISBN", "LCCN", "LCC", "DDC", "NLI", "VIAF", "OCLC")
SCAN_TYPES, SCAN_STATUSES = ("isbn", "ocr"), ("pending", "confirmed", "discarded")

CANDIDATE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in (
        "title", "title_alternate", "author", "author_alternate", "publisher", "place", "date", "language", "isbn", "lccn", "oclc",
        "lc_classification", "dewey_classification", "series_title", "series_volume", "source_catalog",
    )),
    T.StructField("additional_authors", T.ArrayType(T.StringType())),
    T.StructField("subjects", T.ArrayType(T.StringType())),
])
SCAN_RESULT = T.StructType([
    T.StructField("pk", T.LongType()), T.StructField("scan_type", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("isbn", T.StringType()), T.StructField("image", T.StringType()), T.StructField("ocr_output", T.StringType()),
    T.StructField("candidate_records", T.ArrayType(CANDIDATE)), T.StructField("selected_candidate_index", T.IntegerType()),
    T.StructField("created_record_pk", T.LongType()), T.StructField("scanned_by", T.LongType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns: absent ones are added, empty text for strings, else null.

    Files written before a column was added are read so.
    """

    def column(field: T.StructField) -> Column:
        text = isinstance(field.dataType, T.StringType)
        empty = F.lit("") if text else F.lit(None)
        if field.name not in df.columns:
            return empty.cast(field.dataType).alias(field.name)
        value = F.col(field.name).cast(field.dataType)
        return (F.coalesce(value, empty) if text else value).alias(field.name)

    return df.select(*map(column, schema.fields))


def violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often: none, if the key is unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def out_of_range(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose enumerated column holds another value."""
    return df.where(~F.col(column).isin(*allowed))
