"""Tables as Parquet, read with declared schemas; candidates and suggestions as JSON; staged images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark import schemas
from quirespark.functions.text import any_contains

TABLES: dict[str, T.StructType] = {
    "record": schemas.RECORD, "author": schemas.AUTHOR, "subject": schemas.SUBJECT, "publisher": schemas.PUBLISHER, "series": schemas.SERIES,
    "series_volume": schemas.SERIES_VOLUME, "location": schemas.LOCATION, "external_identifier": schemas.EXTERNAL_IDENTIFIER,
    "title_page_image": schemas.TITLE_PAGE_IMAGE, "scan_result": schemas.SCAN_RESULT, "api_usage": schemas.API_USAGE,
    "record_author": schemas.BRIDGE, "record_subject": schemas.BRIDGE, "record_publisher": schemas.BRIDGE, "record_location": schemas.BRIDGE,
}


class Catalog:
    """Catalogue tables below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """A table; columns that its files lack are filled in."""
        files = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
        return schemas.conform(files, TABLES[name])

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        schemas.conform(df, TABLES[name]).write.mode(mode).parquet(f"{self.path}/{name}")


def candidates_to_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def candidates_from_json(df: DataFrame, column: str) -> DataFrame:
    """An array of candidates; keys that a candidate lacks are null."""
    return df.withColumn(column, F.from_json(column, T.ArrayType(schemas.CANDIDATE)))


def suggestions(languages: DataFrame, query: str, columns: list[str], order: Column | str, most: int = 10) -> DataFrame:
    """The first languages, in their order, of which a column contains the query; none below two letters."""
    found = languages.where(any_contains([F.col(c) for c in columns], query)).where(F.lit(len(query.strip()) >= 2))
    return found.orderBy(order).limit(most)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def stage_images(images: DataFrame, path: str) -> DataFrame:
    """Write images (``name, content``) below ``path``, named by their content's digest, so that a task that
    runs again writes the same files; ``name, image`` tells where each went."""
    spark = images.sparkSession
    named = images.select("name", "content", F.concat(F.sha2("content", 256), F.lit("."), F.lower(F.regexp_extract("name", r"([A-Za-z0-9]+)$", 1))).alias("image"))
    named.select("image", "content").dropDuplicates(["image"]).write.mode("append").parquet(f"{path}/staged")
    return spark.read.parquet(f"{path}/staged").select("image").distinct().join(named.select("name", "image"), "image").select("name", "image")


def staged_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of image files; content is only read where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").option("recursiveFileLookup", "true").load(path)
