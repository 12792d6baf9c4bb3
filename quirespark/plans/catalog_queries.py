"""Browsing a catalogue: parts are records, suppliers authors, nations locations, orders series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import catalog
from quirespark.sources.tables import suggestions

from . import sql_text
from .registry import query, table

_BRIDGE = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"
_VOLUMES = "(SELECT l_orderkey, l_linenumber, min(l_returnflag) <> 'R' AS held, min(l_partkey) AS record_pk FROM lineitem GROUP BY ALL)"


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", "l_linenumber").agg((F.min("l_returnflag") != "R").alias("held"), F.min("l_partkey").alias("record_pk"))


@query(f"""SELECT s_suppkey, s_name, count(l_partkey) AS record_count FROM supplier JOIN {_BRIDGE} ON s_suppkey = l_suppkey
           GROUP BY ALL HAVING count(l_partkey) > 0""")
def facet_author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bridge(spark, sf_dir).withColumnRenamed("l_suppkey", "s_suppkey")
    return catalog.facet_counts(table(spark, sf_dir, "supplier"), pairs, "s_suppkey", "s_name", "l_partkey")


@query("SELECT p_type, count(*) AS record_count FROM part WHERE p_type <> '' GROUP BY ALL")
def facet_subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facet_of_column(table(spark, sf_dir, "part"), "p_type")


@query("SELECT p_brand, count(*) AS record_count FROM part WHERE p_brand <> '' GROUP BY ALL")
def facet_publisher_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facet_of_column(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS record_count FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def facet_location_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return catalog.facet_counts(table(spark, sf_dir, "nation"), pairs, "n_nationkey", "n_name", "s_suppkey")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS record_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def admin_counts_with_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return catalog.counts_with_zero(customers, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return catalog.orphans(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def linked_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return catalog.linked(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a relation that lack something: here, customers in debt that have ordered."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", "c_name")
    return catalog.linked(customers, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


_OPENING = "split_part(text, chr(10), 1)"


@query(f"""
  SELECT doc_id, title, CAST(row_number() OVER (ORDER BY regexp_matches(title, '[^\\x00-\\x7F]') DESC, title, doc_id) AS INTEGER) AS position,
         CAST(ceil(row_number() OVER (ORDER BY regexp_matches(title, '[^\\x00-\\x7F]') DESC, title, doc_id) / 25.0) AS INTEGER) AS page
  FROM (SELECT doc_id, {_OPENING} AS title FROM documents)""")
def title_script_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles with their pages, those in the other script first.  No document is in Hebrew: letters
    beyond ASCII stand for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    order = [*catalog.script_order("title", F.col("title").rlike(r"[^\x00-\x7F]")), F.col("doc_id")]
    return catalog.ranked_pages(docs, order).select("doc_id", "title", "position", "page")


@query("""SELECT CAST(CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade, count(*) AS record_count FROM orders
          WHERE o_orderdate IS NOT NULL GROUP BY ALL""")
def decade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.decades(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")), "year")


_PLACES = "(SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' :' WHEN 1 THEN ' ;' WHEN 2 THEN '.' ELSE '' END AS place FROM part)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.when(F.col("p_partkey") % 4 == 0, " :").when(F.col("p_partkey") % 4 == 1, " ;").when(F.col("p_partkey") % 4 == 2, ".").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", ends).alias("place"))


@query(f"SELECT {sql_text.strip_marc('place')} AS place, count(*) AS record_count FROM {_PLACES} WHERE place <> '' GROUP BY 1")
def place_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.places(_placed(spark, sf_dir), "place")


@query(f"SELECT p_partkey, place FROM {_PLACES} WHERE {sql_text.strip_marc('place')} = (SELECT p_name FROM part ORDER BY p_partkey LIMIT 1)")
def place_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "part").orderBy("p_partkey").select("p_name").first().p_name
    return catalog.in_place(_placed(spark, sf_dir), name, "place")


@query("""SELECT 'record' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'author', count(*) FROM supplier
          UNION ALL SELECT 'series', count(*) FROM orders UNION ALL SELECT 'location', count(*) FROM nation""")
def home_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"record": "part", "author": "supplier", "series": "orders", "location": "nation"}
    return catalog.table_counts({k: table(spark, sf_dir, t) for k, t in names.items()})


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return catalog.newest(orders, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("""
  WITH b AS (SELECT DISTINCT l_orderkey AS record_pk, l_partkey AS other_pk FROM lineitem),
  p AS (SELECT DISTINCT x.record_pk, y.record_pk AS related FROM b x JOIN b y USING (other_pk) WHERE x.record_pk <> y.record_pk),
  r AS (SELECT p.record_pk, p.related, CAST(row_number() OVER (PARTITION BY p.record_pk ORDER BY o_orderdate DESC, related DESC) AS INTEGER) AS position
        FROM p JOIN orders ON o_orderkey = related)
  SELECT record_pk, related, position FROM r WHERE position <= 10""")
def related_by_author_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_pk"), F.col("l_partkey").alias("other_pk")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_pk"), "o_orderdate")
    return catalog.related(pairs, orders, [F.col("o_orderdate").desc(), F.col("related").desc()])


@query(f"""
  SELECT a.record_pk, b.record_pk AS sibling, CAST(b.l_linenumber AS VARCHAR) AS volume_number
  FROM {_VOLUMES} a JOIN {_VOLUMES} b USING (l_orderkey) WHERE a.record_pk IS NOT NULL AND a.record_pk IS DISTINCT FROM b.record_pk""")
def sibling_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = volumes(spark, sf_dir).select("l_orderkey", "record_pk", F.col("l_linenumber").cast("string").alias("volume_number"))
    return catalog.siblings(rows, "l_orderkey")


@query(f"""
  SELECT p_partkey, p_name, coalesce(a.authors, '') AS authors, coalesce(a.nations, '') AS nations
  FROM part LEFT JOIN (
    SELECT l_partkey, string_agg(s_name, '|' ORDER BY s_name) AS authors, string_agg(n_name, '|' ORDER BY n_name) AS nations
    FROM {_BRIDGE} JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY l_partkey
  ) a ON l_partkey = p_partkey""")
def record_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bridge(spark, sf_dir).select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    relations = {
        "authors": catalog.gathered(pairs, suppliers, "s_suppkey", "s_name", "authors", "p_partkey"),
        "nations": catalog.gathered(pairs, suppliers, "s_suppkey", "n_name", "nations", "p_partkey"),
    }
    whole = catalog.record_details(table(spark, sf_dir, "part").select("p_partkey", "p_name"), relations, "p_partkey")
    return whole.withColumns({n: F.array_join(n, "|") for n in relations})


@query(f"""
  SELECT o_orderkey, count(held) AS volume_count, count(*) FILTER (held) AS held_count, count(*) FILTER (NOT held) AS gap_count
  FROM orders LEFT JOIN {_VOLUMES} ON l_orderkey = o_orderkey GROUP BY ALL""")
def series_held_gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return catalog.held_and_gaps(orders, volumes(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%n!_1%' ESCAPE '!' ORDER BY n_nationkey LIMIT 10")
def prefix_contains_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "N_1", ["n_name"], "n_nationkey")


@query("""
  SELECT p_partkey, p_name, p_type FROM part
  WHERE (lower(p_name) LIKE '%a%' OR lower(p_brand) LIKE '%a%' OR lower(p_type) LIKE '%a%')
    AND (lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%' OR lower(p_type) LIKE '%1%')""")
def admin_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.functions.text import all_words_contained

    columns = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    return table(spark, sf_dir, "part").where(all_words_contained(columns, "A 1")).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = (SELECT min(s_suppkey) FROM supplier))")
def author_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return catalog.with_member(parts, pairs, "l_suppkey", member, "p_partkey")
