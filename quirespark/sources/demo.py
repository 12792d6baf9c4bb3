"""A small catalogue for trials, made by rule and loaded idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import ingest, series

RECORDS = 26
LANGUAGES = ("heb", "eng", "ger", "yid")
CATALOGS = ("NLI", "LC", "DNB", "")
#: Series, each with its volumes and those held.
SERIES = (("Hidden Springs", 14, "1-9"), ("Letters of the North", 22, "1-20"), ("Old Maps", 11, "2-11"))


def candidates(spark: SparkSession) -> DataFrame:
    """The demonstration's records as candidates."""
    n = F.col("id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return spark.range(RECORDS).select(
        (n + 1).alias("record_pk"), F.concat(F.lit("Demonstration volume "), (n + 1).cast("string"), F.lit(" /")).alias("title"),
        F.when(n % 4 == 0, F.concat(F.lit("כרך "), (n + 1).cast("string"))).otherwise("").alias("title_alternate"),
        F.concat(F.lit("Writer "), (n % 7).cast("string"), F.lit(",")).alias("author"), F.concat(F.lit("House "), (n % 5).cast("string")).alias("publisher"),
        pick(("Jerusalem :", "London ;", "Berlin", "Vilna")).alias("place"), (1880 + 5 * n).cast("string").alias("date"), pick(LANGUAGES).alias("language"),
        pick(CATALOGS).alias("source_catalog"), F.array(F.concat(F.lit("Subject "), (n % 6).cast("string"))).alias("subjects"),
        F.concat(F.lit("97800000"), F.lpad((n * 13).cast("string"), 5, "0")).alias("isbn"),
    )


def load(spark: SparkSession, existing: dict[str, DataFrame] | None = None, clear: bool = False) -> dict[str, DataFrame]:
    """The catalogue's tables with the demonstration in them.  Loaded twice, or over a catalogue that has
    some of it, nothing is there twice; ``clear`` starts from empty tables."""
    had = {} if clear else dict(existing or {})
    made = candidates(spark)
    records = ingest.records_from_candidates(made).withColumnRenamed("record_pk", "pk")
    if "record" in had:
        records = had["record"].unionByName(records.join(had["record"].select("pk"), "pk", "left_anti"), allowMissingColumns=True)
    out = {"record": records}
    for name, column in (("author", "author"), ("publisher", "publisher")):
        empty = spark.createDataFrame([], "pk long, name string")
        dimension = had.get(name, empty).select("pk", "name")
        names = made.select(F.regexp_replace(column, ",$", "").alias("name"))
        out[name] = dimension.unionByName(ingest.get_or_create(dimension, names, "name").select("pk", "name"))
    titles = spark.createDataFrame([(k + 1, title, total) for k, (title, total, _) in enumerate(SERIES)], "series_pk long, title string, total_volumes int")
    specs = spark.createDataFrame([(k + 1, f"all {total}") for k, (_, total, _) in enumerate(SERIES)], "series_pk long, spec string")
    held = spark.createDataFrame([(k + 1, spec) for k, (_, _, spec) in enumerate(SERIES)], "series_pk long, spec string")
    at_hand = held.select("series_pk", F.explode(series.volume_numbers(F.col("spec"))).alias("volume_number")).withColumn("record_pk", F.lit(1).cast("long"))
    volumes = had.get("series_volume", spark.createDataFrame([], "series_pk long, volume_number string, record_pk long, held boolean"))
    out["series"] = titles
    out["series_volume"] = volumes.unionByName(series.new_volumes(specs, volumes, at_hand))
    return out
