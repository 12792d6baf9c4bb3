"""The written index, cascades in Hebrew and step by step, records from scan to deletion, caches and pages."""

from __future__ import annotations

import urllib.error
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark import schemas
from quirespark.durable import scratch_path
from quirespark.functions import authority_xml, json_text, marc, text
from quirespark.operators import authority, cascade, catalog, covers, ingest, quality, search, series
from quirespark.sources import demo, response_cache, sru, tables, vision
from quirespark.sources.catalogue import Catalogue
from quirespark.streaming import retention, scan_queue

from . import sql_text
from .catalog_queries import volumes
from .ingest_queries import _element, _IDENTIFIERS, _identified, _LATEST, _latest
from .registry import query, spread, table

# --- The written index ----------------------------------------------------------------------------


def _hits_sql(docs: str) -> str:
    """Documents with both words, by rank, of a query that gives ``doc_id, text``."""
    found = "len(list_filter(terms, lambda t: t = '{}'))"
    split = f"SELECT doc_id, {sql_text.terms(sql_text.cleaned('text'))} AS terms FROM ({docs})"
    measured = f"SELECT doc_id, len(terms) AS length, {found.format('licensed')} AS f0, {found.format('version')} AS f1 FROM ({split})"
    return sql_text.bm25(measured, ["f0", "f1"], "doc_id", 50)


def _index(spark: SparkSession, sf_dir: str) -> search.SearchIndex:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.SearchIndex(spark, scratch_path(spark, "index")).build(docs, "doc_id", {"text": F.col("text")})


def _hits(index: search.SearchIndex, asked: str = "Licensed, version") -> DataFrame:
    return index.search(asked).select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(_hits_sql("SELECT doc_id, text FROM documents"))
def index_build_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_index(spark, sf_dir))


@query(_hits_sql("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Licensed: version ' || doc_id ELSE text END AS text FROM documents"))
def index_replace_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document is edited, and its rows of the index are replaced."""
    edited = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(
        "doc_id", F.concat(F.lit("Licensed: version "), F.col("doc_id").cast("string")).alias("text")
    )
    return _hits(_index(spark, sf_dir).replace(edited, "doc_id", {"text": F.col("text")}))


@query(_hits_sql("SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0"))
def index_remove_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_index(spark, sf_dir).remove(table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id")))


@query(_hits_sql("""
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'version licensed again' WHEN doc_id % 7 = 0 THEN 'licensed version' ELSE text END AS text
  FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 11 = 0"""))
def index_three_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are edited, removed, and some of either edited again, from handles that know nothing of each other."""
    docs, index = table(spark, sf_dir, "documents"), _index(spark, sf_dir)
    other, text_of = search.SearchIndex(spark, index.path), {"text": F.col("text")}
    other.replace(docs.where("doc_id % 7 = 0").select("doc_id", F.lit("licensed version").alias("text")), "doc_id", text_of)
    index.remove(docs.where("doc_id % 5 = 0").select("doc_id"))
    other.replace(docs.where("doc_id % 11 = 0").select("doc_id", F.lit("version licensed again").alias("text")), "doc_id", text_of)
    return _hits(index)


@query(sql_text.bm25(
    "SELECT doc_id, len(terms) AS length, len(list_filter(terms, lambda t: t = 'licensed')) AS f0 "
    f"FROM (SELECT doc_id, {sql_text.terms(sql_text.cleaned('text'))} AS terms FROM documents)", ["f0"], "doc_id", 50
))
def index_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty by a word that many documents hold; blocks that can't reach them aren't read."""
    return _hits(_index(spark, sf_dir), "licensed")


@query(_hits_sql("SELECT doc_id, text FROM documents"))
def search_unbalanced_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote that isn't closed parts words like any other mark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.scan_search(docs, "doc_id", {"text": F.col("text")}, 'licensed"version').select("doc_id", F.round("rank", 6).alias("rank"))


# --- Cascades -------------------------------------------------------------------------------------

_HEBREW_TITLE = "CASE p_partkey % 3 WHEN 0 THEN 'ספר תולדות ' || p_name WHEN 1 THEN 'אב שלום של ' || p_type || ' תשובה' ELSE p_name END"


def _hebrew_title() -> Column:
    k = F.col("p_partkey") % 3
    return F.when(k == 0, F.concat(F.lit("ספר תולדות "), "p_name")).when(k == 1, F.concat(F.lit("אב שלום של "), "p_type", F.lit(" תשובה"))).otherwise(F.col("p_name"))


@query(f"""
  WITH m AS (SELECT p_partkey, {_HEBREW_TITLE} AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE '' END AS rom,
                    CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS date FROM part)
  SELECT * FROM (
    SELECT p_partkey, 0 AS step_no, 'romanized_title+date' AS step, 'dc.title="' || rom || '" AND dc.date=' || date AS query FROM m WHERE rom <> '' AND date <> ''
    UNION ALL SELECT p_partkey, 1, 'hebrew_title+date', 'cql.anywhere="' || title || '" AND dc.date=' || date FROM m WHERE date <> ''
    UNION ALL SELECT p_partkey, 2, 'romanized_title', 'dc.title="' || rom || '"' FROM m WHERE rom <> ''
    UNION ALL SELECT p_partkey, 3, 'keywords', CASE p_partkey % 3 WHEN 0 THEN 'cql.anywhere="ספר" AND cql.anywhere="תולדות"'
                ELSE 'cql.anywhere="שלום" AND cql.anywhere="תשובה"' END FROM m WHERE p_partkey % 3 < 2)""")
def lc_step_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    metadata = table(spark, sf_dir, "part").select(
        "p_partkey", _hebrew_title().alias("title"), F.when(k % 4 != 0, F.col("p_name")).otherwise("").alias("title_romanized"),
        F.when(k % 5 != 0, F.col("p_size").cast("string")).otherwise("").alias("date"),
    )
    return cascade.step_queries(metadata, cascade.LC_STEPS).select("p_partkey", "step_no", "step", "query")


@query("""
  WITH q AS (SELECT p_partkey AS query_id, p_brand, p_type, p_size FROM part WHERE p_partkey % 20 = 0),
  h AS (SELECT query_id, p.p_partkey AS hit, 0 AS step_no FROM q JOIN part p USING (p_brand, p_type, p_size)
        UNION ALL SELECT query_id, p.p_partkey, 1 FROM q JOIN part p USING (p_brand, p_type)
        UNION ALL SELECT query_id, p.p_partkey, 2 FROM q JOIN part p USING (p_brand))
  SELECT query_id, hit, CAST(step_no AS INTEGER) AS step_no FROM h WHERE hit <> query_id QUALIFY step_no = min(step_no) OVER (PARTITION BY query_id)""")
def cascade_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth part is searched for among all others, a step at a time, while it has no hit."""
    parts = table(spark, sf_dir, "part")
    keys = (("p_brand", "p_type", "p_size"), ("p_brand", "p_type"), ("p_brand",))
    asked = F.array(*(F.struct(F.lit(n).alias("step_no"), F.concat_ws("|", F.lit(n), *k).alias("query")) for n, k in enumerate(keys)))
    steps = parts.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.inline(asked)).withColumn("step", F.col("step_no").cast("string"))
    held = parts.select(F.col("p_partkey").alias("hit"), F.inline(asked)).drop("step_no")
    return cascade.run_steps(steps, lambda now: now.join(held, "query").where("hit <> query_id"), len(keys)).select("query_id", "hit", "step_no")


_AUTHORS = """(SELECT c_custkey AS query_id,
  CASE c_custkey % 4 WHEN 0 THEN 'שלום בן אברהם ' || c_custkey || ' המלך' WHEN 1 THEN c_name WHEN 2 THEN 'אבג' ELSE '' END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS rom FROM customer)"""


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("שלום בן אברהם "), k.cast("string"), F.lit(" המלך"))).when(k % 4 == 1, F.col("c_name"))
        .when(k % 4 == 2, "אבג").otherwise("")
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("query_id"), name.alias("name"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("name_romanized")
    )


_AUTHOR_STEPS = f"""
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS INTEGER) AS step_no, query FROM (
    SELECT query_id, 1 AS n, 'local.personalNames all "' || name || '"' AS query FROM {_AUTHORS} WHERE query_id % 4 IN (0, 2)
    UNION ALL SELECT query_id, 2, 'local.personalNames all "' || rom || '"' FROM {_AUTHORS} WHERE rom <> ''
    UNION ALL SELECT query_id, 3, 'local.personalNames all "' || name || '"' FROM {_AUTHORS} WHERE query_id % 4 = 1 AND rom = ''
    UNION ALL SELECT query_id, 4, 'cql.any all "' || name || '"' FROM {_AUTHORS} WHERE name <> ''
    UNION ALL SELECT query_id, 5, 'cql.any all "אברהם" AND cql.any all "שלום" AND cql.any all "המלך"' FROM {_AUTHORS} WHERE query_id % 4 = 0)"""


@query(_AUTHOR_STEPS)
def author_query_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries to an authority file, the last by the three longest words, words of one length in their order."""
    return authority.author_steps(_authors(spark, sf_dir)).select("query_id", "step_no", "query")


@query(f"""
  WITH s AS ({_AUTHOR_STEPS}), h AS (SELECT *, 'v' || CAST(query_id % 6 AS VARCHAR) AS viaf_id FROM s WHERE (query_id + step_no) % 3 = 0)
  SELECT query_id, step_no, viaf_id FROM h QUALIFY step_no = min(step_no) OVER (PARTITION BY query_id)""")
def author_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step that finds anything counts; the file stands in for a remote one."""
    k = F.col("query_id")

    def answer(now: DataFrame) -> DataFrame:
        return now.where((k + F.col("step_no")) % 3 == 0).withColumn("viaf_id", F.concat(F.lit("v"), (k % 6).cast("string")))

    return cascade.run_steps(authority.author_steps(_authors(spark, sf_dir)), answer, 5).select("query_id", "step_no", "viaf_id")


@query("""
  SELECT query, nation % 3 <> 2 AND nation % 3 <> 1 AS success, CASE WHEN nation % 3 = 0 THEN '<r>' || nation || '</r>' ELSE '' END AS data,
         CASE nation % 3 WHEN 0 THEN '' WHEN 1 THEN 'Response does not appear to be XML' ELSE 'HTTP error: <urlopen error no stored answer>' END AS error
  FROM (SELECT n_nationkey AS nation, 'alma.isbn=' || n_nationkey AS query FROM nation)""")
def sru_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source itself, with stored answers: a cataloguer's few queries, one a nation."""
    import json

    keys = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # a row for each nation
    answers = {f"alma.isbn={k}": f"<r>{k}</r>" if k % 3 == 0 else "busy" for k in keys if k % 3 < 2}
    sru.register(spark)
    options = {"base_url": "http://x", "queries": json.dumps([f"alma.isbn={k}" for k in keys]), "answers": json.dumps(answers), "partitions": "2"}
    return spark.read.format("sru").options(**options).load()


# --- Parsing --------------------------------------------------------------------------------------


def _full_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, part = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")

    def field(tag: str, *subfields: tuple[str, Column | str]) -> Column:
        inner = [_element("subfield", f' code="{c}"', v if isinstance(v, Column) else F.lit(v)) for c, v in subfields]
        return _element("datafield", f' tag="{tag}" ind1=" " ind2=" "', *inner)

    only = lambda every, c: F.when(F.col("p_partkey") % every == 0, c).otherwise("")
    record = _element(
        "record", ' xmlns="http://www.loc.gov/MARC21/slim"', F.lit("<leader>00000nam</leader>"),
        field("010", ("a", F.concat(F.lit("lc"), part))), field("020", ("a", F.concat(F.lit("978"), part))),
        field("035", ("a", "(XX)1")), only(2, field("035", ("a", F.concat(F.lit("(OCoLC)"), part)))),
        field("050", ("a", "PJ"), ("b", size)), field("082", ("a", size)), field("100", ("a", F.col("p_name"))),
        field("245", ("b", F.col("p_type")), ("a", F.col("p_name"))), only(3, field("260", ("a", "Vilna :"), ("b", F.col("p_brand")), ("c", size))),
        field("264", ("a", "London ;"), ("b", F.col("p_type"))), field("490", ("a", F.col("p_brand")), ("v", size)),
        field("700", ("a", "Second"), ("a", "not this")), field("700", ("b", "nor this")), field("700", ("a", F.col("p_brand"))),
        field("880", ("6", "700-09"), ("a", "אחר")), only(2, field("880", ("6", "245-01/r"), ("a", "שם"), ("b", F.col("p_type")))), only(5, field("880", ("6", "100-02"), ("a", "מחבר"))),
    )
    body = F.concat(
        F.lit('<searchRetrieveResponse xmlns="http://www.loc.gov/zing/srw/"><numberOfRecords>1</numberOfRecords><records><record><recordData>'), record,
        F.lit("</recordData></record></records></searchRetrieveResponse>"),
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", body.alias("data"))


@query("""
  SELECT p_partkey, p_name || ' ' || p_type AS title, CASE WHEN p_partkey % 2 = 0 THEN 'שם ' || p_type END AS title_alternate, p_name AS author,
         CASE WHEN p_partkey % 5 = 0 THEN 'מחבר' END AS author_alternate, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS publisher,
         CASE WHEN p_partkey % 3 = 0 THEN 'Vilna :' ELSE 'London ;' END AS place, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS date,
         CAST(NULL AS VARCHAR) AS language, '978' || p_partkey AS isbn, 'Second|' || p_brand AS additional_authors, '' AS subjects, 'lc' || p_partkey AS lccn,
         CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS oclc, 'PJ ' || p_size AS lc_classification, CAST(p_size AS VARCHAR) AS dewey_classification,
         p_brand AS series_title, CAST(p_size AS VARCHAR) AS series_volume
  FROM part""")
def marc_parse_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 17 fields, with linked fields in another script."""
    parsed = marc.records(_full_responses(spark, sf_dir)).select("p_partkey", marc.bibliographic(F.col("marc")).alias("b")).select("p_partkey", "b.*")
    return parsed.withColumns({c: F.array_join(c, "|") for c in ("additional_authors", "subjects")})


@query("""
  SELECT s_suppkey, CAST(least(20, s_suppkey % 30 + 1) AS INTEGER) AS kept, s_name || ' ' || least(20, s_suppkey % 30 + 1) AS last FROM supplier""")
def viaf_twenty_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    def variant(n: Column) -> Column:
        return F.concat(F.lit("<x400><normalized>"), "s_name", F.lit(" "), n.cast("string"), F.lit("</normalized></x400>"))

    x400s = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 30 + 1).cast("int")), variant), "")
    body = F.concat(
        F.lit("<searchRetrieveResponse><records><record><recordData><VIAFCluster><viafID>1</viafID><x400s>"), x400s,
        F.lit("</x400s></VIAFCluster></recordData></record></records></searchRetrieveResponse>"),
    )
    found = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(authority_xml.clusters(body)).alias("c"))
    return found.select("s_suppkey", F.size("c.variants").alias("kept"), F.element_at("c.variants", -1).alias("last"))


@query("SELECT event_id, event_type || ' רש״י' AS title, CASE WHEN event_id % 2 = 0 THEN 'תש״ך' ELSE '' END AS date FROM events WHERE event_id % 3 <> 0")
def gershayim_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes between Hebrew letters that would end a JSON text; every third answer is beyond repair."""
    n = F.col("event_id")
    date = F.when(n % 2 == 0, 'תש"ך').otherwise("")
    made = F.when(n % 3 == 0, '{"title": "x').otherwise(F.concat(F.lit('{"title": "'), "event_type", F.lit(' רש"י", "date": "'), date, F.lit('"}')))
    page = table(spark, sf_dir, "events").select("event_id", json_text.title_page(made).alias("p")).where("p IS NOT NULL")
    return page.select("event_id", "p.title", "p.date")


@query("""
  SELECT item_id, CASE WHEN len(text) % 7 <> 0 THEN left(text, 20) END AS title, CASE WHEN len(text) % 7 <> 0 THEN CAST(len(text) AS VARCHAR) END AS date
  FROM benchmark""")
def vision_title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as images, read by a stand-in for a vision model, some of whose answers can't be parsed."""

    def model(content: bytes) -> str:
        import json

        read = content.decode()
        fields = json.dumps({"title": read[:20], "date": str(len(read))}, ensure_ascii=False)
        return f"```json\n{fields}\n```" if len(read) % 7 else f"The page says {fields[:-1]}"

    images = table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return vision.read_title_pages(images, model).select("item_id", "ocr_output.title", "ocr_output.date")


# --- Text that is shown ---------------------------------------------------------------------------


@query("""
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' / ' || p_type ELSE p_name END AS author, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' (' || p_type || ')' ELSE p_brand END AS publisher,
         p_name || ' vol. ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' (not held)' END AS volume,
         CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS date,
         p_size % 3 || CASE WHEN p_size % 3 = 1 THEN ' volume' ELSE ' volumes' END AS counted FROM part""")
def display_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    given = lambda every, c: F.when(k % every == 0, F.col(c)).otherwise("")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.with_romanized(F.col("p_name"), given(2, "p_type")).alias("author"), text.publisher_shown(F.col("p_brand"), given(3, "p_type")).alias("publisher"),
        text.volume_shown(F.col("p_name"), size.cast("string"), k % 2 == 0).alias("volume"),
        text.shown_date(given(3, "p_type"), F.when(size % 4 != 0, size).otherwise(0)).alias("date"), text.counted(size % 3, "volume", "volumes").alias("counted"),
    )


@query("""
  WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM conversations)
  SELECT conv_id, turn, array_to_string(words[1:12], ' ') || CASE WHEN len(words) > 12 THEN ' …' ELSE '' END AS opening FROM w""")
def first_twelve_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_words(F.col("text")).alias("opening"))


@query("""
  WITH s AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts)) AS BIGINT) AS s FROM events)
  SELECT event_id, CASE WHEN s < 60 THEN '0 minutes'
    WHEN s >= 2592000 THEN CAST(s // 2592000 AS BIGINT) || CASE WHEN s // 2592000 = 1 THEN ' month' ELSE ' months' END
    WHEN s >= 604800 THEN CAST(s // 604800 AS BIGINT) || CASE WHEN s // 604800 = 1 THEN ' week' ELSE ' weeks' END
    WHEN s >= 86400 THEN CAST(s // 86400 AS BIGINT) || CASE WHEN s // 86400 = 1 THEN ' day' ELSE ' days' END
    WHEN s >= 3600 THEN CAST(s // 3600 AS BIGINT) || CASE WHEN s // 3600 = 1 THEN ' hour' ELSE ' hours' END
    ELSE CAST(s // 60 AS BIGINT) || CASE WHEN s // 60 = 1 THEN ' minute' ELSE ' minutes' END END AS ago FROM s""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.time_since(F.col("ts"), F.lit("2024-02-01 00:00:00")).alias("ago"))


@query(f"""
  SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'rtl' ELSE 'ltr' END AS direction,
         '<span dir="' || CASE WHEN p_partkey % 3 < 2 THEN 'rtl' ELSE 'ltr' END || '">' || {_HEBREW_TITLE} || ' &lt;&amp;&gt;</span>' AS shown FROM part""")
def bidi_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(_hebrew_title(), F.lit(" <&>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.direction(title).alias("direction"), text.bidi_span(title).alias("shown"))


@query("SELECT p_partkey, 'q=' || replace(p_name, ' ', '+') || '&page=' || p_size || '&brand=' || replace(p_brand, '#', '%23') AS query FROM part")
def query_string_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.create_map(F.lit("q"), "p_name", F.lit("page"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.query_string(params).alias("query"))


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CODE = "rtrim(ltrim(" + " || ".join(f"('{_DIGITS}')[CAST((p_partkey // {62**k}) % 62 AS INTEGER) + 1]" for k in range(4, -1, -1)) + ", '0'))"


@query(f"""
  SELECT p_partkey AS pk, 'rec-' || CASE WHEN p_partkey = 0 THEN '0' ELSE {_CODE} END AS record_id,
         CASE p_partkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN replace(lower(p_name), ' ', '-') || '-1st'
              WHEN 2 THEN 'é-' || lower(p_type) || '_x' ELSE 'ספר-' || replace(p_name, ' ', '-') END AS slug FROM part""")
def public_ids_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's id from its key, and a slug where it has none, of the romanised title or the title."""
    k = F.col("p_partkey")
    romanized = F.when(k % 4 == 1, F.concat(F.lit("  "), F.initcap("p_name"), F.lit(": 1st!"))).when(k % 4 == 2, F.concat(F.lit("É -"), "p_type", F.lit("_X--"))).otherwise("")
    made = table(spark, sf_dir, "part").select(
        k.alias("pk"), romanized.alias("title_romanized"), F.concat(F.lit("ספר "), "p_name").alias("title"), F.when(k % 4 == 0, "kept").otherwise("").alias("slug")
    )
    return ingest.with_public_ids(made).select("pk", "record_id", "slug")


# --- Orders and pages -----------------------------------------------------------------------------


@query(f"""
  WITH t AS (SELECT p_partkey, {_HEBREW_TITLE} AS title FROM part),
  n AS (SELECT *, row_number() OVER (ORDER BY p_partkey % 3 < 2 DESC, title, p_partkey) AS n FROM t)
  SELECT p_partkey, CAST(n AS INTEGER) AS position, CAST(ceil(n / 25.0) AS INTEGER) AS page FROM n""")
def hebrew_titles_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").select("p_partkey", _hebrew_title().alias("title"))
    return catalog.ranked_pages(titles, [*catalog.script_order("title"), F.col("p_partkey")]).select("p_partkey", "position", "page")


@query("""
  WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer), t AS (SELECT count(*) AS rows, greatest(1, ceil(count(*) / 25.0)) AS last FROM customer),
  asked AS (SELECT unnest(['x', '2', '0', '100000']) AS asked),
  shown AS (SELECT asked, CASE WHEN asked = 'x' THEN 1 WHEN CAST(asked AS INTEGER) BETWEEN 1 AND last THEN CAST(asked AS INTEGER) ELSE last END AS page, rows
            FROM (SELECT asked, CASE WHEN asked = 'x' THEN '1' ELSE asked END AS number FROM asked), t, (SELECT 1)
            WHERE asked <> 'x' UNION ALL SELECT 'x', 1, rows FROM t)
  SELECT asked, CAST(page AS INTEGER) AS page, rows, c_custkey, CAST(n AS INTEGER) AS position FROM shown JOIN n ON ceil(n / 25.0) = page""")
def page_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't a number gives the first page, what lies outside the last."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    rows = customers.count()
    out = None
    for asked in ("x", "2", "0", "100000"):
        number = catalog.page_number(asked, rows)
        shown = catalog.page(customers, [F.col("c_acctbal"), F.col("c_custkey")], number)
        numbered = catalog.ranked_pages(shown, [F.col("c_acctbal"), F.col("c_custkey")])
        part = numbered.select(
            F.lit(asked).alias("asked"), F.lit(number).alias("page"), F.lit(rows).cast("long").alias("rows"), "c_custkey",
            (F.col("position") + (number - 1) * catalog.PAGE_SIZE).cast("int").alias("position"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("""
  WITH v AS (SELECT DISTINCT l_orderkey AS series_pk, CAST(l_linenumber * 5 AS VARCHAR) AS volume_number FROM lineitem)
  SELECT series_pk, volume_number, CAST(row_number() OVER (PARTITION BY series_pk ORDER BY volume_number) AS INTEGER) AS position FROM v""")
def volumes_in_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of a series by number as text: 10 and 15 before 5."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series_pk"), (F.col("l_linenumber") * 5).cast("string").alias("volume_number")).distinct()
    return catalog.volume_positions(rows)


@query("""
  SELECT 'author' AS model, s_suppkey AS pk, CAST(row_number() OVER (ORDER BY s_name, s_suppkey) AS INTEGER) AS position FROM supplier
  UNION ALL SELECT 'record', o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) FROM orders""")
def default_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by name, records newest first; the key decides between equals."""
    authors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), "s_name")
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk"), "o_orderdate")
    placed = [
        ("author", catalog.ranked_pages(authors, [F.col("s_name"), F.col("pk")])),
        ("record", catalog.ranked_pages(records, [F.col("o_orderdate").desc(), F.col("pk").desc()])),
    ]
    first, second = (df.select(F.lit(model).alias("model"), "pk", "position") for model, df in placed)
    return first.unionByName(second)


# --- Records from candidate to deletion -----------------------------------------------------------


@query("""
  SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS volume
  FROM customer""")
def series_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    info = series.series_info(F.when(k % 3 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit("\t"))).otherwise("  "), F.when(k % 2 == 0, F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", info.alias("i")).select("c_custkey", F.col("i.title").alias("title"), F.col("i.volume").alias("volume"))


@query("""
  SELECT DISTINCT p_partkey AS record_pk, name FROM (
    SELECT p_partkey, p_type AS name FROM part UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0)""")
def relations_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of candidates, cleaned; blanks and repeats go."""
    subjects = F.array(F.concat("p_type", F.lit(" ;")), F.col("p_type"), F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(","))))
    return ingest.relations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_pk"), subjects.alias("subjects")), "subjects")


@query("""
  SELECT p_partkey AS pk, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title, p_type AS place FROM part
  UNION ALL SELECT p_partkey + 10000000, upper(p_name), NULL FROM part WHERE p_partkey % 30 = 0""")
def record_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited titles take their place, new records are added, other columns stay."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("title"), F.col("p_type").alias("place"))
    edited = parts.where("pk % 3 = 0").select("pk", F.upper("title").alias("title"))
    added = edited.where("pk % 30 = 0").select((F.col("pk") + 10_000_000).alias("pk"), "title")
    return ingest.upsert(parts, edited.unionByName(added), "pk")


@query(f"""
  SELECT 'identifier' AS table_name, p_partkey AS record_pk, value AS what FROM ({_IDENTIFIERS}) WHERE p_partkey % 4 <> 1
  UNION ALL SELECT 'record', p_partkey, p_name FROM part WHERE p_partkey % 4 <> 1
  UNION ALL SELECT 'image', CASE WHEN p_partkey % 4 <> 1 THEN p_partkey END, p_brand FROM part""")
def record_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records go with their identifiers; images stay without a record."""
    parts = table(spark, sf_dir, "part")
    whole = {
        "record": parts.select(F.col("p_partkey").alias("record_pk"), F.col("p_name").alias("what")),
        "identifier": _identified(spark, sf_dir).select(F.col("p_partkey").alias("record_pk"), F.col("value").alias("what")),
        "image": parts.select(F.col("p_partkey").alias("record_pk"), F.col("p_brand").alias("what")),
    }
    left = ingest.delete_records(whole["record"].where("record_pk % 4 = 1").select("record_pk"), whole, ("record", "identifier"), ("image",))
    parts_ = [df.select(F.lit(name).alias("table_name"), "record_pk", "what") for name, df in left.items()]
    return parts_[0].unionByName(parts_[1]).unionByName(parts_[2])


@query("""
  SELECT 'supplier' AS table_name, s_suppkey AS pk, s_nationkey AS link, CASE WHEN s_suppkey % 5 = 0 THEN upper(s_name) ELSE s_name END AS what
    FROM supplier WHERE s_suppkey % 4 <> 1
  UNION ALL SELECT DISTINCT 'line', l_orderkey * 10 + l_linenumber, l_suppkey, l_shipmode FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE l_suppkey % 4 <> 1
  UNION ALL SELECT 'part', p_partkey, CASE WHEN p_partkey % 100 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 1) THEN p_partkey % 100 END, p_brand FROM part""")
def catalogue_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are deleted with their lines, parts lose their link to them, and others are edited, in two
    changes each of which is published over all three tables at once."""
    rows = {
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_nationkey").cast("long").alias("link"), F.col("s_name").alias("what")),
        "line": table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk"), F.col("l_suppkey").alias("link"), F.col("l_returnflag").alias("what")).distinct(),
        "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), (F.col("p_partkey") % 100).alias("link"), F.col("p_brand").alias("what")),
    }
    held = Catalogue(spark, scratch_path(spark, "catalogue"))

    def fill(draft) -> None:
        for name, df in rows.items():
            draft.create(name, df, "pk")

    held.change(fill)
    held.delete_records(rows["supplier"].where("pk % 4 = 1").select("pk"), {"supplier": "pk", "line": "link"}, {"part": "link"})
    held.change(lambda draft: draft.upsert("supplier", draft.read("supplier").where("pk % 5 = 0").select("pk", F.upper("what").alias("what"))))
    parts = [held.read(name).select(F.lit(name).alias("table_name"), "pk", "link", "what") for name in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
  WITH first AS (SELECT name, row_number() OVER (ORDER BY name) AS pk FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_partkey % 2 = 0)),
  later AS (SELECT name, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY name) AS pk
            FROM (SELECT p_brand AS name FROM part UNION SELECT p_type FROM part) WHERE name NOT IN (SELECT name FROM first))
  SELECT name, pk FROM first UNION ALL SELECT name, pk FROM later""")
def name_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are claimed by two runs that share some; each has one number in the end."""
    parts = table(spark, sf_dir, "part")
    held = Catalogue(spark, scratch_path(spark, "registry"))
    held.change(lambda draft: draft.create("name", spark.createDataFrame([], "name string, pk long"), "name", "pk"))
    held.change(lambda draft: draft.get_or_create("name", parts.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("name"))) and None)
    held.change(lambda draft: draft.get_or_create("name", parts.select(F.explode(F.array("p_brand", "p_type")).alias("name"))) and None)
    return held.read("name").select("name", "pk")


_HELD_FOR = "INTERVAL 5 DAY"


@query(f"""
  WITH e AS (SELECT event_id // 7 AS scan_id, event_id, ts,
                    CASE WHEN event_id % 5 = 0 THEN 'discarded' WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM events),
  a AS (SELECT * FROM e WHERE event_id % 4 <> 3), b AS (SELECT * FROM e WHERE event_id % 4 = 3),
  mark AS (SELECT (SELECT max(ts) FROM a) - INTERVAL 1 HOUR AS before, (SELECT max(ts) FROM e) - INTERVAL 1 HOUR AS after),
  first AS (SELECT scan_id, status, ts FROM a QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, status DESC) = 1),
  kept AS (SELECT scan_id, status, ts FROM first, mark WHERE NOT (status = 'discarded' AND ts + {_HELD_FOR} <= before)
           UNION ALL SELECT scan_id, status, ts FROM b, mark WHERE ts > before),
  last AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, status DESC) = 1)
  SELECT scan_id, status FROM last, mark WHERE NOT (status = 'discarded' AND ts + {_HELD_FOR} <= after)""")
def scan_retention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discarded scans go five days after, by timers on the stream's state; a quarter of the events come in
    a second run, most of them too late."""
    n = F.col("event_id")
    status = F.when(n % 5 == 0, "discarded").when(n % 3 == 0, "confirmed").otherwise("pending")
    root = scratch_path(spark, "retention")
    events = table(spark, sf_dir, "events").select(n, F.floor(n / 7).alias("scan_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    for part in (events.where(n % 4 != 3), events.where(n % 4 == 3)):
        part.drop("event_id").write.mode("append").parquet(f"{root}/events")
        stream = spark.readStream.schema("scan_id long, status string, ts timestamp").parquet(f"{root}/events")
        states = retention.expiring_states(stream, timedelta(days=5))
        scan_queue.write_changes(states, f"{root}/states", f"{root}/progress", gone="expired").awaitTermination()
    return scan_queue.current_states(spark, f"{root}/states", gone="expired").select("scan_id", "status")


@query("""
  SELECT CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    return schemas.violations(table(spark, sf_dir, "part").select(key.alias("key")), ["key"])


@query(f"""
  WITH c AS (SELECT p_partkey, CASE identifier_type WHEN 'ISBN' THEN 1 WHEN 'OCLC' THEN 2 ELSE 3 END AS priority,
             'https://covers.example.org/b/' || lower(identifier_type) || '/' || value || '-M.jpg' AS url
             FROM ({_IDENTIFIERS}) WHERE identifier_type <> 'LCC' AND p_partkey % 5 <> 0)
  SELECT p_partkey AS record_pk, url AS cover_url FROM c WHERE len(url) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority) = 1""")
def cover_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a cover get the first image that is large enough; sizes come from the cover source."""
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_pk"), F.when(F.col("p_partkey") % 5 == 0, "has one").otherwise("").alias("cover_url"))
    found = _identified(spark, sf_dir).withColumnRenamed("p_partkey", "record_pk")

    def fetch(url: str) -> int:
        if "lccn" in url and len(url) % 2:
            raise TimeoutError
        return 99 + (len(url) + 1) % 2

    return sru.first_covers(covers.wanted_covers(records, found), fetch, delay=0)  # the stand-in needs no pause


@query("""
  SELECT n_nationkey, catalog, query, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'HTTP error: <urlopen error refused>' END AS error,
         CASE WHEN n_nationkey % 3 = 0 THEN CASE catalog WHEN 'VIAF' THEN '<r>maximumRecords,query,recordSchema=VIAF</r>'
           ELSE '<r>maximumRecords,operation,query,recordSchema,version=marcxml</r>' END ELSE '' END AS data
  FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'VIAF' ELSE 'LC' END AS catalog, 'local.names all ' || n_name AS query FROM nation)""")
def sru_over_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of requests to two catalogues, asked by tasks that take turns; the answers tell the parameters."""
    nations = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "VIAF").otherwise("LC").alias("catalog"), F.concat(F.lit("local.names all "), "n_name").alias("query")
    )
    refused = {r.query for r in nations.where("n_nationkey % 3 <> 0").select("query").collect()}  # of a row for each nation

    def answer(base_url: str, params: dict[str, str]) -> str:
        if params["query"] in refused:
            raise urllib.error.URLError("refused")
        return f"<r>{','.join(sorted(params))}={params['recordSchema']}</r>"

    asked = sru.requests(nations, sru.endpoints(spark)).repartition(4)
    return sru.fetched(asked, delay=0.01, get=answer).select("n_nationkey", "catalog", "query", "error", "data")


@query("""
  SELECT record_pk, relation, name FROM (
    SELECT p_partkey AS record_pk, 'record' AS relation, p_name AS name FROM part
    UNION ALL SELECT p_partkey, 'authors', p_brand FROM part UNION ALL SELECT p_partkey, 'authors', p_type FROM part WHERE p_type <> p_brand
    UNION ALL SELECT p_partkey, 'subjects', p_type FROM part WHERE p_partkey % 2 = 0)""")
def manual_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled-in forms, relations with a name a line, as records and pairs."""
    k = F.col("p_partkey")
    entries = schemas.conform(
        table(spark, sf_dir, "part").select(
            k.alias("record_pk"), F.concat("p_name", F.lit(" /")).alias("title"), F.concat("p_brand", F.lit(" ;\n\n"), "p_type", F.lit("\n"), "p_type").alias("authors"),
            F.when(k % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise("\n").alias("subjects"),
        ),
        schemas.MANUAL_ENTRY,
    )
    made = ingest.from_forms(entries)
    out = made["record"].select("record_pk", F.lit("record").alias("relation"), F.col("title").alias("name"))
    for relation in ("authors", "subjects", "publishers", "locations", "isbns"):
        out = out.unionByName(made[relation].select("record_pk", F.lit(relation).alias("relation"), "name"))
    return out


@query("""
  SELECT 'record' AS table_name, count(*) + min(p_partkey) + 10 AS n FROM part UNION ALL SELECT 'author', count(*) + 7 FROM supplier
  UNION ALL SELECT 'publisher', count(*) + 5 FROM nation UNION ALL SELECT 'series', 3 UNION ALL SELECT 'series_volume', 47 UNION ALL SELECT 'held', 39""")
def demo_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demonstration, loaded twice over a catalogue that has all but ten of its numbers: nothing is there twice."""
    existing = {
        "record": table(spark, sf_dir, "part").select((F.col("p_partkey") + 11).alias("pk"), F.col("p_name").alias("title")),
        "author": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_name").alias("name")),
        "publisher": table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("pk"), F.col("n_name").alias("name")),
    }
    loaded = demo.load(spark, demo.load(spark, existing))
    return catalog.table_counts(loaded | {"held": loaded["series_volume"].where("held")})


@query(f"""
  SELECT scan_id, status, CASE WHEN status = 'confirmed' THEN scan_id + 500 END AS created_record_pk,
         CASE WHEN status = 'confirmed' THEN CAST(scanned_by % 2 AS INTEGER) END AS selected_candidate_index FROM {_LATEST}""")
def scan_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that are created, and then confirmed with the chosen candidate and the record made of it."""
    scans = _latest(spark, sf_dir)
    created = ingest.upsert(
        scans.where("false").select("scan_id", "status", F.lit(None).cast("long").alias("created_record_pk"), F.lit(None).cast("int").alias("selected_candidate_index")),
        scans.select("scan_id", F.when(F.col("status") == "confirmed", "pending").otherwise(F.col("status")).alias("status")), "scan_id",
    )
    confirmed = scans.where("status = 'confirmed'").select(
        "scan_id", "status", (F.col("scan_id") + 500).alias("created_record_pk"), (F.col("scanned_by") % 2).cast("int").alias("selected_candidate_index")
    )
    return ingest.upsert(created, confirmed, "scan_id")


# --- JSON, images, caches -------------------------------------------------------------------------


@query("""SELECT json FROM (SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation WHERE contains(lower(n_name), '_2') ORDER BY n_nationkey LIMIT 10)""")
def suggestions_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    found = tables.suggestions(nations, "_2", ["n_name"], "n_nationkey")
    everything = tables.suggestions(nations, "2", ["n_name"], "n_nationkey")  # below two letters nothing is suggested
    return tables.as_json(found.unionByName(everything))


@query("SELECT p_partkey, p_name AS title, p_type || '|' || p_brand AS subjects, CAST(NULL AS VARCHAR) AS author FROM part")
def candidates_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates to JSON and back; what a candidate lacks is null."""
    made = F.array(F.struct(F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("subjects")))
    written = tables.candidates_to_json(table(spark, sf_dir, "part").select("p_partkey", made.alias("c")), "c")
    back = tables.candidates_from_json(written, "c").select("p_partkey", F.get("c", F.lit(0)).alias("c"))
    return back.select("p_partkey", "c.title", F.array_join("c.subjects", "|").alias("subjects"), "c.author")


@query("SELECT url AS name, sha256(html) || '.jpg' AS image FROM pages")
def image_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as images, written under their content's digest."""
    images = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.encode("html", "UTF-8").alias("content"))
    named = images.withColumn("name", F.concat("name", F.lit(".JPG")))
    staged = tables.stage_images(named, scratch_path(spark, "images"))
    return staged.select(F.expr("left(name, length(name) - 4)").alias("name"), "image")


@query("SELECT 'f' || event_id AS path FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY")
def stale_staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").cast("timestamp")).first()[0]
    files = events.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"), F.lit(1).alias("length"))
    return quality.stale_files(files, now, days=20).select("path")


@query("""
  SELECT 'k' || p_partkey AS cache_key, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS data FROM part
  WHERE p_partkey % 5 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 2 = 0)""")
def response_cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd keys have outlived their time, every third was stored again since, every fifth was taken back."""
    key, k = F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("cache_key"), F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    cache = response_cache.ResponseCache(spark, scratch_path(spark, "cache"))
    first, later, now = datetime(2024, 1, 1), datetime(2024, 1, 20), datetime(2024, 2, 1)
    cache.put(parts.where(k % 2 == 1).select(key, F.col("p_name").alias("data")), first)
    cache.put(parts.where(k % 2 == 0).select(key, F.col("p_name").alias("data")), first, ttl_seconds=90 * 86_400)
    cache.put(parts.where(k % 3 == 0).select(key, F.upper("p_name").alias("data")), later)
    cache.invalidate(parts.where(k % 5 == 0).select(key), datetime(2024, 1, 25))
    return cache.entries(now)


@query("""SELECT l_orderkey AS series_pk, count(*) AS volume_count FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY ALL""")
def series_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a series where all pairs of siblings would be many."""
    rows = volumes(spark, sf_dir).select(F.col("l_orderkey").alias("series_pk"), F.col("l_linenumber").cast("string").alias("volume_number"))
    placed = catalog.volume_positions(rows)
    return placed.groupBy("series_pk").agg(F.max("position").cast("long").alias("volume_count"))
