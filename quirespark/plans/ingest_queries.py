"""Series, authority, cascades, ingest, quality and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.durable import scratch_path
from quirespark.functions import authority_xml, json_text, marc, text
from quirespark.operators import authority, cascade, catalog, covers, ingest, quality, series
from quirespark.sources import sru
from quirespark.streaming import scan_queue

from . import sql_text
from .catalog_queries import bridge
from .registry import query, spread, table

# --- Series ---------------------------------------------------------------------------------------


@query("""
  WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem),
  s AS (SELECT l_orderkey, min(n) AS low, max(n) AS high, list(n) AS had FROM v GROUP BY l_orderkey),
  g AS (SELECT l_orderkey, list_sort(list_filter(generate_series(low, high), lambda x: NOT list_contains(had, x))) AS missing FROM s)
  SELECT l_orderkey, array_to_string(missing, ',') AS missing FROM g WHERE len(missing) > 0""")
def series_gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.gaps(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("number")), "l_orderkey", "number")
    return found.select("l_orderkey", F.array_join("missing", ",").alias("missing"))


@query("""
  WITH v AS (SELECT DISTINCT CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE l_suppkey END AS series, l_partkey * 100000 % 2000000011 AS n FROM lineitem),
  g AS (SELECT series, n + 1 AS first, lead(n) OVER (PARTITION BY series ORDER BY n) - 1 AS last FROM v)
  SELECT series, first, last FROM g WHERE first <= last""")
def series_gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers up to two billion, and a series with a tenth of all rows."""
    volumes = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(F.col("l_suppkey")).alias("series"), (F.col("l_partkey") * 100000 % 2000000011).cast("string").alias("number")
    )
    return series.gap_ranges(volumes, "series", "number")


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    n = (k % 7).cast("string")
    spec = (
        F.when(k % 4 == 0, F.concat(F.lit("all "), n)).when(k % 4 == 1, F.concat((k % 5).cast("string"), F.lit(" - "), n))
        .when(k % 4 == 2, F.concat(n, F.lit(", ,x"), (k % 3).cast("string"))).otherwise(n)
    )
    return table(spark, sf_dir, "customer").select("c_custkey", spec.alias("spec"))


_SPECS = """(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'all ' || (c_custkey % 7) WHEN 1 THEN (c_custkey % 5) || ' - ' || (c_custkey % 7)
             WHEN 2 THEN (c_custkey % 7) || ', ,x' || (c_custkey % 3) ELSE CAST(c_custkey % 7 AS VARCHAR) END AS spec FROM customer)"""
_NUMBERS = """
  CASE WHEN regexp_matches(spec, '^all ') THEN list_transform(range(1, CAST(split_part(spec, ' ', 2) AS BIGINT) + 1), lambda x: CAST(x AS VARCHAR))
       WHEN regexp_matches(spec, '^[0-9]+ - [0-9]+$')
         THEN list_transform(range(CAST(split_part(spec, ' ', 1) AS BIGINT), CAST(split_part(spec, ' ', 3) AS BIGINT) + 1), lambda x: CAST(x AS VARCHAR))
       ELSE list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') END"""


@query(f"SELECT c_custkey, volume_number FROM (SELECT c_custkey, unnest({_NUMBERS}) AS volume_number FROM {_SPECS})")
def volume_spec_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.volume_rows(_specs(spark, sf_dir))


@query(f"""
  WITH asked AS (SELECT DISTINCT c_custkey AS series_pk, unnest({_NUMBERS}) AS volume_number FROM {_SPECS}),
  had AS (SELECT DISTINCT l_orderkey AS series_pk, CAST(l_linenumber AS VARCHAR) AS volume_number FROM lineitem WHERE l_returnflag = 'R'),
  at_hand AS (SELECT l_orderkey AS series_pk, CAST(l_linenumber AS VARCHAR) AS volume_number, min(l_partkey) AS record_pk FROM lineitem
              WHERE l_returnflag <> 'R' GROUP BY ALL)
  SELECT a.series_pk, a.volume_number, r.record_pk, r.record_pk IS NOT NULL AS held
  FROM asked a LEFT JOIN at_hand r USING (series_pk, volume_number)
  WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.series_pk = a.series_pk AND h.volume_number = a.volume_number)""")
def volume_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("series_pk"), F.col("l_linenumber").cast("string").alias("volume_number"), F.col("l_partkey").alias("record_pk"), "l_returnflag"
    )
    at_hand = lines.where("l_returnflag <> 'R'")
    specs = _specs(spark, sf_dir).withColumnRenamed("c_custkey", "series_pk")
    return series.new_volumes(specs, lines.where("l_returnflag = 'R'"), at_hand)


# --- Authority ------------------------------------------------------------------------------------


@query(f"""
  WITH a AS (SELECT c_custkey AS pk, c_name AS name, 'Rom ' || c_mktsegment AS rom, 'Var, ' || c_name || '.' AS v FROM customer),
  q AS (SELECT c_custkey AS query_id,
               CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'VAR ' || c_name ELSE 'nobody' END AS name,
               CASE WHEN c_custkey % 50 = 0 THEN 'Rom ' || c_mktsegment ELSE '' END AS rom FROM customer),
  hits AS (
    SELECT query_id, pk, 1 AS p FROM q JOIN a USING (name)
    UNION ALL SELECT query_id, pk, 2 FROM q JOIN a ON q.rom = a.rom WHERE q.rom <> ''
    UNION ALL SELECT query_id, pk, 3 FROM q JOIN a ON {sql_text.normalized('q.name')} = {sql_text.normalized('a.v')}
  )
  SELECT query_id, pk AS author_pk, CASE min(p) WHEN 1 THEN 'exact' WHEN 2 THEN 'romanized' ELSE 'variant' END AS match_type
  FROM hits GROUP BY query_id, pk""")
def author_match_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, romanized = F.col("c_custkey"), F.concat(F.lit("Rom "), F.col("c_mktsegment"))
    variants = F.array(F.concat(F.lit("Var, "), F.col("c_name"), F.lit(".")))
    authors = c.select(k.alias("pk"), F.col("c_name").alias("name"), romanized.alias("name_romanized"), variants.alias("variant_names"))
    name = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat(F.lit("VAR "), F.col("c_name"))).otherwise("nobody")
    queries = c.select(k.alias("query_id"), name.alias("name"), F.when(k % 50 == 0, romanized).otherwise("").alias("name_romanized"))
    return authority.author_matches(queries, authors)


@query(f"""
  WITH s AS (SELECT p_partkey AS pk, p_name AS title FROM part),
  q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) || '.' END AS asked FROM part),
  hits AS (SELECT query_id, pk, title, 1 AS p FROM q JOIN s ON title = asked
           UNION ALL SELECT query_id, pk, title, 2 FROM q JOIN s ON {sql_text.normalized('title')} = {sql_text.normalized('asked')})
  SELECT query_id, pk AS series_pk FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p, title, pk) = 1""")
def series_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    # Equal titles would all be paired: of each title the first is enough.
    firsts = parts.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("pk"))
    asked = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(".")))
    return authority.series_matches(parts.select(F.col("p_partkey").alias("query_id"), asked.alias("title")), firsts.select("pk", "title"))


_QUERY_NAMES = "(SELECT DISTINCT p_name FROM part)"


@query(f"""
  WITH q AS (SELECT DISTINCT p_name AS query, {sql_text.heading('p_name')} AS q FROM part),
  t AS (SELECT DISTINCT p_type || ' ' || p_name AS text, {sql_text.heading("p_type || ' ' || p_name")} AS t FROM part)
  SELECT query, text FROM q JOIN t ON contains(t, q) OR contains(q, t)
    OR (len(list_filter(string_split(q, ' '), lambda w: len(w) > 1)) >= 2
        AND len(list_filter(string_split(q, ' '), lambda w: len(w) > 1 AND NOT contains(t, w))) = 0)""")
def cluster_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    queries = parts.select(F.col("p_name").alias("query")).distinct().withColumn("query_id", F.col("query"))
    texts = parts.select(F.concat("p_type", F.lit(" "), "p_name").alias("text")).distinct().withColumn("text_id", F.col("text"))
    return authority.text_match_pairs(queries, texts).select(F.col("query_id").alias("query"), F.col("text_id").alias("text"))


@query("""
  WITH c AS (SELECT s_nationkey AS query_id, 'v' || s_suppkey AS viaf_id, s_suppkey AS position,
                    CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END
                    + CASE WHEN contains(s_name, CAST(s_nationkey AS VARCHAR)) THEN 5 ELSE 0 END AS score FROM supplier)
  SELECT query_id, viaf_id, CAST(score AS INTEGER) AS score FROM c
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) = 1 AND score >= 2""")
def cluster_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    sources = F.map_filter(
        F.create_map(F.lit("J9U"), F.when(k % 2 == 0, "x").otherwise(""), F.lit("LC"), F.when(k % 3 == 0, "y").otherwise("")), lambda _, v: v != ""
    )
    heading = F.array(F.struct(F.col("s_name").alias("text"), F.array().cast("array<string>").alias("sources")))
    cluster = F.struct(
        F.concat(F.lit("v"), k.cast("string")).alias("viaf_id"), heading.alias("main_headings"), sources.alias("source_ids"), F.array().cast("array<string>").alias("variants")
    )
    candidates = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("query_id"), F.col("s_nationkey").cast("string").alias("name"), F.lit("").alias("name_romanized"), k.alias("position"), cluster.alias("cluster")
    )
    return authority.best_clusters(candidates)


# --- Cascades -------------------------------------------------------------------------------------


@query("""
  WITH q AS (SELECT p_partkey AS query_id, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 20 = 0),
  h AS (SELECT query_id, p.p_partkey AS hit, 0 AS step FROM q JOIN part p ON p.p_brand = q.p_brand AND p.p_type = q.p_type AND p.p_size = q.p_size
          AND p.p_partkey <> query_id
        UNION ALL SELECT query_id, p.p_partkey, 1 FROM q JOIN part p ON p.p_brand = q.p_brand AND p.p_type = q.p_type AND p.p_partkey <> query_id
        UNION ALL SELECT query_id, p.p_partkey, 2 FROM q JOIN part p ON p.p_type = q.p_type AND p.p_partkey <> query_id)
  SELECT query_id, hit, CAST(step AS INTEGER) AS step FROM h QUALIFY step = min(step) OVER (PARTITION BY query_id)""")
def cascade_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches take every twentieth part as a query, against all parts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    size = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    queries = parts.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), "p_brand", "p_type", size.alias("p_size"))
    held = parts.withColumnRenamed("p_partkey", "hit")
    return cascade.first_equal(queries, held, [["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_type"]])


@query("""
  SELECT p_partkey, step_no, step, query FROM (
    SELECT p_partkey, 0 AS step_no, 'title+place+date' AS step, 'alma.title="' || p_name || '" AND alma.publisher_location="' || p_type || '" AND alma.main_pub_date=' || p_size AS query FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 1, 'title+publisher+date', 'alma.title="' || p_name || '" AND alma.publisher="' || p_brand || '" AND alma.main_pub_date=' || p_size FROM part
    UNION ALL SELECT p_partkey, 2, 'title+place', 'alma.title="' || p_name || '" AND alma.publisher_location="' || p_type || '"' FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 3, 'title+publisher', 'alma.title="' || p_name || '" AND alma.publisher="' || p_brand || '"' FROM part
    UNION ALL SELECT p_partkey, 4, 'title+date', 'alma.title="' || p_name || '" AND alma.main_pub_date=' || p_size FROM part
    UNION ALL SELECT p_partkey, 5, 'keywords+date', 'alma.all_for_ui="' || p_name || '" AND alma.main_pub_date=' || p_size FROM part
    UNION ALL SELECT p_partkey, 6, 'title', 'alma.title="' || p_name || '"' FROM part)""")
def keyword_query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")
    metadata = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), place.alias("place"), F.col("p_size").cast("string").alias("date"), F.col("p_brand").alias("publisher")
    )
    return cascade.step_queries(metadata).select("p_partkey", "step_no", "step", "query")


@query("""
  SELECT p_size AS query_id, p_partkey, source_catalog,
         CAST(row_number() OVER (PARTITION BY p_size ORDER BY k, p_partkey) - 1 AS INTEGER) AS ordinal
  FROM (SELECT p_size, p_partkey, p_partkey % 3 AS k, CASE p_partkey % 3 WHEN 0 THEN 'NLI' WHEN 1 THEN 'LC' ELSE 'DNB' END AS source_catalog FROM part)""")
def isbn_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), "p_partkey", F.col("p_partkey").alias("position"))
    thirds = {name: parts.where(F.col("p_partkey") % 3 == n) for n, name in enumerate(("NLI", "LC", "DNB"))}
    return cascade.union_of_catalogs(thirds).select("query_id", "p_partkey", "source_catalog", "ordinal")


@query("""
  SELECT p_partkey, md5('http://x/' || p_brand || '|maximumRecords=20|operation=searchRetrieve|query=alma.isbn = "' || p_partkey
         || '"|recordSchema=marcxml|version=1.2') AS cache_key FROM part""")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = text.quote_cql_values(F.concat(F.lit("alma.isbn="), F.col("p_partkey").cast("string")))
    key = text.cache_key(F.concat(F.lit("http://x/"), F.col("p_brand")), sru.parameters(asked, "1.2"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("cache_key"))


# --- Scalars --------------------------------------------------------------------------------------

_DIGIT = "('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')[CAST((n // {}) % 62 AS INTEGER) + 1]"
_BASE62 = "ltrim(" + " || ".join(_DIGIT.format(62**k) for k in range(7, -1, -1)) + ", '0')"


@query(f"SELECT n, CASE WHEN n = 0 THEN '0' ELSE {_BASE62} END AS code FROM (SELECT DISTINCT l_partkey * l_orderkey AS n FROM lineitem)")
def base62(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * F.col("l_orderkey")).alias("n")).distinct()
    return numbers.select("n", text.base62(F.col("n")).alias("code"))


_WEIGHTED = " + ".join(f"CAST(i[{k}] AS INTEGER) * {1 if k % 2 else 3}" for k in range(1, 13))


@query(f"""
  SELECT p_partkey, i AS isbn, CASE WHEN len(i) = 13 THEN (10 - ({_WEIGHTED}) % 10) % 10 = CAST(i[13] AS INTEGER) ELSE len(i) = 10 END AS valid
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '978' || lpad(CAST(p_partkey * 7919 % 10000000000 AS VARCHAR), 10, '0')
        ELSE lpad(CAST(p_partkey AS VARCHAR), CAST(9 + p_partkey % 3 AS INTEGER), '0') END AS i FROM part)""")
def isbn_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    long_ = F.concat(F.lit("978"), F.lpad((k * 7919 % 10_000_000_000).cast("string"), 10, "0"))
    short = F.expr("lpad(cast(p_partkey as string), cast(9 + p_partkey % 3 as int), '0')")
    made = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, long_).otherwise(short).alias("isbn"))
    return made.withColumn("valid", text.is_isbn(F.col("isbn")))


_DATE_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN '[' || year(o_orderdate) || '?]' WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR)
                WHEN 2 THEN 'c' || (year(o_orderdate) % 100) ELSE 'n.d.' END"""


@query(f"""
  SELECT o_orderkey, d AS date_text, CAST(nullif(regexp_replace(d, '[^0-9]', '', 'g')[1:4], '') AS INTEGER) AS year,
         CASE WHEN regexp_replace(d, '[^0-9]', '', 'g') = '' THEN d ELSE '' END AS display, TRY_CAST(d AS INTEGER) AS strict_year
  FROM (SELECT o_orderkey, {_DATE_TEXT} AS d FROM orders)""")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    made = (
        F.when(k % 4 == 0, F.concat(F.lit("["), y.cast("string"), F.lit("?]"))).when(k % 4 == 1, y.cast("string"))
        .when(k % 4 == 2, F.concat(F.lit("c"), (y % 100).cast("string"))).otherwise("n.d.")
    )
    d = F.col("date_text")
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("date_text")).select(
        "o_orderkey", d, text.year_of(d).alias("year"), text.date_display(d).alias("display"), text.strict_int(d).alias("strict_year")
    )


@query(f"""
  SELECT doc_id, {sql_text.normalized('text')} AS compared, {sql_text.heading('text')} AS heading, {sql_text.cleaned('text')} AS cleaned
  FROM documents""")
def normalize_for_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id", text.normalize_for_comparison(line).alias("compared"), text.normalize_heading(line).alias("heading"), text.clean_for_index(line).alias("cleaned")
    )


# --- Ingest ---------------------------------------------------------------------------------------


@query("""
  WITH had AS (SELECT max(c_custkey) AS highest FROM customer),
  n AS (SELECT DISTINCT 'Customer of ' || o_orderpriority || ' ' || year(o_orderdate) AS name FROM orders)
  SELECT name, highest + row_number() OVER (ORDER BY name) AS pk FROM n, had WHERE name NOT IN (SELECT c_name FROM customer)""")
def get_or_create_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("name"))
    name = F.concat(F.lit("Customer of "), "o_orderpriority", F.lit(" "), F.year("o_orderdate").cast("string"))
    return ingest.get_or_create(dimension, table(spark, sf_dir, "orders").select(name.alias("name")), "name").select("name", "pk")


@query("SELECT DISTINCT l_partkey AS record_pk, l_suppkey AS other_pk FROM lineitem")
def bridge_add_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("record_pk"), F.col("l_suppkey").alias("other_pk"), "l_returnflag")
    return ingest.add_pairs(lines.where("l_returnflag = 'R'").select("record_pk", "other_pk"), lines.where("l_returnflag <> 'R'"))


_IDENTIFIERS = """
  SELECT p_partkey, 'ISBN' AS identifier_type, p_name AS value FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 'LCCN', p_brand FROM part UNION ALL SELECT p_partkey, 'OCLC', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'LCC', p_type FROM part"""


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return ingest.identifiers(
        table(spark, sf_dir, "part").select(
            "p_partkey", F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("isbn"), F.concat(F.lit(" "), "p_brand").alias("lccn"),
            F.when(k % 3 == 0, F.col("p_size").cast("string")).alias("oclc"), F.col("p_type").alias("lc_classification"),
        ), "p_partkey",
    )


@query(f"SELECT * FROM ({_IDENTIFIERS})")
def identifier_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir)


@query(f"""
  WITH c AS (SELECT p_partkey, CASE identifier_type WHEN 'ISBN' THEN 1 WHEN 'OCLC' THEN 2 ELSE 3 END AS priority,
             'https://covers.example.org/b/' || lower(identifier_type) || '/' || value || '-M.jpg' AS url
             FROM ({_IDENTIFIERS}) WHERE identifier_type <> 'LCC')
  SELECT p_partkey, url AS cover_url FROM c WHERE len(url) % 3 > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority) = 1""")
def cover_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = covers.cover_candidates(_identified(spark, sf_dir), "p_partkey")
    sizes = candidates.select("url", F.when(F.length("url") % 3 > 0, 100).otherwise(99).alias("body_size"))
    return covers.best_covers(candidates, sizes, "p_partkey")


_ODD = """(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' /' WHEN 1 THEN p_name || '.' WHEN 2 THEN p_name || ' Inc.' WHEN 3 THEN p_name || ',' ELSE p_name END AS title,
                  CASE p_partkey % 3 WHEN 0 THEN p_brand || ' ;' WHEN 1 THEN p_brand || '...' ELSE p_brand END AS publisher FROM part)"""


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    end = F.when(k % 5 == 0, " /").when(k % 5 == 1, ".").when(k % 5 == 2, " Inc.").when(k % 5 == 3, ",").otherwise("")
    tail = F.when(k % 3 == 0, " ;").when(k % 3 == 1, "...").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", end).alias("title"), F.concat("p_brand", tail).alias("publisher"))


@query(f"SELECT p_partkey, {sql_text.strip_marc('title')} AS title, {sql_text.strip_marc('publisher')} AS publisher FROM {_ODD}")
def punctuation_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_punctuation(_odd(spark, sf_dir), ["title", "publisher"])


_CHANGES = " UNION ALL ".join(
    f"SELECT 'part' AS table_name, p_partkey AS key, '{f}' AS field, {f} AS old_value, {sql_text.strip_marc(f)} AS new_value FROM {_ODD}" for f in ("title", "publisher")
)


@query(f"SELECT * FROM ({_CHANGES}) WHERE old_value <> new_value")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.punctuation_changes(_odd(spark, sf_dir), "part", "p_partkey", ["title", "publisher"])


@query(f"""WITH c AS (SELECT * FROM ({_CHANGES}) WHERE old_value <> new_value)
           SELECT table_name, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM c""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.change_counts(quality.punctuation_changes(_odd(spark, sf_dir), "part", "p_partkey", ["title", "publisher"]))


@query(f"""
  SELECT p_partkey, {sql_text.strip_marc('title')} AS title, TRY_CAST(regexp_replace(d, '[^0-9]', '', 'g')[1:4] AS INTEGER) AS year_web,
         CASE WHEN regexp_matches(d, '^[0-9]+$') THEN CAST(d AS INTEGER) END AS year_queue
  FROM (SELECT o.*, CASE WHEN p_partkey % 2 = 0 THEN '19' || (10 + p_size % 80) || '.' ELSE '19' || (10 + p_size % 80) END AS d
        FROM {_ODD} o JOIN part USING (p_partkey))""")
def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of one candidate at once, and from the queue: their dates are read differently."""
    year = F.concat(F.lit("19"), (10 + F.col("p_size") % 80).cast("string"))
    date = F.concat(year, F.when(F.col("p_partkey") % 2 == 0, ".").otherwise(""))
    made = _odd(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(
        F.col("p_partkey").alias("record_pk"), "title", F.lit("").alias("title_alternate"), F.lit("").alias("place"), F.lit("").alias("language"), date.alias("date")
    )
    web = ingest.records_from_candidates(made).select("record_pk", "title", F.col("date_of_publication").alias("year_web"))
    queue = ingest.records_from_queue(made).select("record_pk", F.col("date_of_publication").alias("year_queue"))
    return web.join(queue, "record_pk").withColumnRenamed("record_pk", "p_partkey")


# --- Review queue ---------------------------------------------------------------------------------

_KIND = "CASE WHEN event_id % 5 = 0 THEN 'discarded' WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'pending' END"


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scan events: a scan for each seven numbers, its owner the smallest user among them."""
    n = F.col("event_id")
    status = F.when(n % 5 == 0, "discarded").when(n % 3 == 0, "confirmed").otherwise("pending")
    return table(spark, sf_dir, "events").select(
        F.floor(n / 7).alias("scan_id"), status.alias("status"), (n % 11).alias("scanned_by"), F.col("ts").cast("timestamp").alias("ts"), n.alias("event_id")
    )


_SCANS = f"(SELECT event_id // 7 AS scan_id, {_KIND} AS status, event_id % 11 AS scanned_by, ts, event_id FROM events)"
_LATEST = f"(SELECT * FROM {_SCANS} QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, event_id DESC) = 1)"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_state(scans(spark, sf_dir), "scan_id", "ts")


@query(f"SELECT scan_id, event_id FROM {_LATEST} WHERE status = 'pending'")
def review_queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.queue_of(_latest(spark, sf_dir), 0, staff=True).select("scan_id", "event_id")


@query(f"SELECT scan_id, event_id FROM {_LATEST} WHERE status = 'pending' AND scanned_by = 3")
def review_queue_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.queue_of(_latest(spark, sf_dir), 3, staff=False).select("scan_id", "event_id")


@query(f"""
  SELECT scan_id, status, event_id FROM {_LATEST}
  WHERE NOT (status = 'discarded' AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY)""")
def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    return quality.retained(_latest(spark, sf_dir), now, days=5, updated="ts").select("scan_id", "status", "event_id")


@query("SELECT event_type, user_id, count(*) AS calls, min(event_id) AS first_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL")
def api_usage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type")).first()[0]
    return events.where(F.col("event_type") == kind).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.min("event_id").alias("first_id"))


@query("""
  SELECT event_id, CASE WHEN event_id % 4 - 1 >= 0 AND event_id % 4 - 1 < 2 THEN CASE event_id % 4 WHEN 1 THEN event_type ELSE CAST(user_id AS VARCHAR) END END AS title,
         CAST(2 AS INTEGER) AS candidates FROM events""")
def json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates as JSON, read back, and one chosen by an index that may lie outside."""
    made = F.to_json(F.array(F.struct(F.col("event_type").alias("title")), F.struct(F.col("user_id").cast("string").alias("title"))))
    events = table(spark, sf_dir, "events").select("event_id", made.alias("json"))
    parsed = events.withColumn("c", F.from_json("json", "array<struct<title:string,author:string>>"))
    chosen = json_text.candidate_at(F.col("c"), (F.col("event_id") % 4 - 1).cast("int"))
    return parsed.select("event_id", chosen["title"].alias("title"), F.size("c").alias("candidates"))


@query("SELECT event_id, event_type AS title, CAST(user_id AS VARCHAR) AS publisher FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit('```json\n{"title": "'), "event_type", F.lit('", "publisher": '), F.col("user_id").cast("string"), F.lit("}\n```"))
    page = table(spark, sf_dir, "events").select("event_id", json_text.title_page(made).alias("p"))
    return page.select("event_id", "p.title", "p.publisher")


# --- XML ------------------------------------------------------------------------------------------


def _element(name: str, attributes: str, *content) -> F.Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), *content, F.lit(f"</{name}>"))


def _field(tag: str, **subfields) -> F.Column:
    inner = [_element("subfield", f' code="{c}"', v) for c, v in subfields.items()]
    return _element("datafield", f' tag="{tag}" ind1="1" ind2=" "', *inner)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.concat(F.lit("850101s19"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit("    is            000 0 heb  "))
    record = _element(
        "record", ' xmlns="http://www.loc.gov/MARC21/slim"', F.lit("<leader>00000nam</leader>"), _element("controlfield", ' tag="008"', fixed),
        _field("245", a=F.col("p_name"), b=F.col("p_type")), _field("264", b=F.col("p_brand")), _field("650", a=F.col("p_type")), _field("650", a=F.col("p_brand")),
        _field("830", a=F.col("p_brand"), v=F.col("p_size").cast("string")),
    )
    body = F.concat(
        F.lit('<zs:searchRetrieveResponse xmlns:zs="http://www.loc.gov/zing/srw/"><zs:numberOfRecords>'), F.col("p_partkey").cast("string"),
        F.lit("</zs:numberOfRecords><zs:records><zs:record><zs:recordData>"), record, F.lit("</zs:recordData></zs:record></zs:records></zs:searchRetrieveResponse>"),
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "down for repairs").otherwise(body).alias("data"))


_P = "FROM part WHERE p_partkey % 10 <> 0"


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey END AS hits, CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS INTEGER) AS records FROM part")
def sru_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _responses(spark, sf_dir).select("p_partkey", marc.envelope(F.col("data")).alias("e"))
    return found.select("p_partkey", F.col("e.numberOfRecords").alias("hits"), F.size("e.records").alias("records"))


@query(f"""
  SELECT p_partkey, p_name || ' ' || p_type AS title, p_brand AS publisher, '19' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS date, 'heb' AS language,
         p_type || '|' || p_brand AS subjects, p_brand AS series_title, CAST(p_size AS VARCHAR) AS series_volume {_P}""")
def marc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = marc.records(_responses(spark, sf_dir)).select("p_partkey", marc.bibliographic(F.col("marc")).alias("b"))
    return parsed.select(
        "p_partkey", "b.title", "b.publisher", "b.date", "b.language", F.array_join("b.subjects", "|").alias("subjects"), "b.series_title", "b.series_volume"
    )


@query(f"""
  SELECT p_partkey, tag, code, value FROM (
    SELECT p_partkey, '245' AS tag, 'a' AS code, p_name AS value {_P} UNION ALL SELECT p_partkey, '245', 'b', p_type {_P}
    UNION ALL SELECT p_partkey, '264', 'b', p_brand {_P} UNION ALL SELECT p_partkey, '650', 'a', p_type {_P} UNION ALL SELECT p_partkey, '650', 'a', p_brand {_P}
    UNION ALL SELECT p_partkey, '830', 'a', p_brand {_P} UNION ALL SELECT p_partkey, '830', 'v', CAST(p_size AS VARCHAR) {_P}
    UNION ALL SELECT p_partkey, '008', '', '850101s19' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || '    is            000 0 heb  ' {_P})""")
def marc_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_json = marc.records(_responses(spark, sf_dir)).select("p_partkey", marc.to_marc_json(F.col("marc")).alias("json"))
    return marc.tagged_rows(as_json, "json").select("p_partkey", "tag", "code", "value")


@query("""SELECT s_suppkey, 'v' || s_suppkey AS viaf_id, s_name AS heading, 'n ' || s_suppkey AS lc, s_name || ' alias|' || lower(s_name) AS variants
          FROM supplier WHERE s_suppkey % 10 <> 0""")
def viaf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    cluster = _element(
        "v:VIAFCluster", ' xmlns:v="http://viaf.org/viaf/terms#"', _element("v:viafID", "", F.lit("v"), k),
        _element("v:sources", "", _element("v:source", ' nsid="a"', F.lit("LC|n "), k)),
        _element("v:mainHeadings", "", _element("v:data", "", _element("v:text", "", F.col("s_name")), F.lit("<v:sources><v:s>LC</v:s></v:sources>"))),
        _element("v:x400s", "", _element("v:x400", "", _element("v:datafield", "", _element("v:subfield", ' code="a"', F.col("s_name"), F.lit(" alias"))), _element("v:normalized", "", F.lower("s_name")))),
    )
    body = F.concat(
        F.lit('<searchRetrieveResponse xmlns="http://www.loc.gov/zing/srw/"><records><record><recordData>'), cluster,
        F.lit("</recordData></record></records></searchRetrieveResponse><html>"),
    )
    answers = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, "<html>").otherwise(body).alias("xml"))
    found = answers.select("s_suppkey", F.explode(authority_xml.clusters(F.col("xml"))).alias("c"))
    return found.select(
        "s_suppkey", "c.viaf_id", F.get("c.main_headings", F.lit(0))["text"].alias("heading"), F.try_element_at("c.source_ids", F.lit("LC")).alias("lc"),
        F.array_join("c.variants", "|").alias("variants"),
    )


@query("""
  SELECT p_partkey, p_partkey % 10 <> 0 AS success, CASE WHEN p_partkey % 10 = 0 THEN 'Response does not appear to be XML' ELSE '' END AS error
  FROM part""")
def sru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a catalogue, answered from stored responses."""
    catalogs, query = sru.endpoints(spark), F.concat(F.lit("alma.isbn="), F.col("p_partkey").cast("string")).alias("query")
    requested = sru.requests(table(spark, sf_dir, "part").select("p_partkey", F.lit("NLI").alias("catalog"), query), catalogs)
    answers = sru.requests(_responses(spark, sf_dir).select("data", F.lit("NLI").alias("catalog"), query), catalogs)
    return sru.replayed(requested, answers).select("p_partkey", "success", "error")


# --- Streaming ------------------------------------------------------------------------------------


@query(f"""SELECT scan_id, status FROM {_SCANS} QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, status DESC) = 1""")
def scan_queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each scan from a stream over all events."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a file or a folder
    n = F.col("event_id")
    status = F.when(n % 5 == 0, "discarded").when(n % 3 == 0, "confirmed").otherwise("pending")
    events = stream.select(F.floor(n / 7).alias("scan_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    root = scratch_path(spark, "scan_queue")
    scan_queue.upsert_states(events, f"{root}/states", f"{root}/progress").awaitTermination()
    states = scan_queue.current_states(spark, f"{root}/states")
    return states.select("scan_id", "status") if states is not None else events.where("false").select("scan_id", "status")
