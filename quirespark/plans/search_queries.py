"""Full-text search over documents and over a catalogue of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import search

from . import sql_text
from .registry import query, table

_TERM = "len(list_filter(terms, lambda t: t = '{}'))"
_DOCS = f"SELECT doc_id, {sql_text.terms(sql_text.cleaned('text'))} AS terms FROM documents"
_AND = sql_text.bm25(
    f"SELECT doc_id, len(terms) AS length, {_TERM.format('licensed')} AS f0, {_TERM.format('version')} AS f1 FROM ({_DOCS})", ["f0", "f1"], "doc_id", 50
)
_PHRASE_COUNT = "len(list_filter(generate_series(1, len(terms) - 1), lambda i: terms[i] = 'apache' AND terms[i + 1] = 'license'))"
_PHRASE = sql_text.bm25(
    f"SELECT doc_id, len(terms) AS length, {_PHRASE_COUNT} AS f0, {_TERM.format('under')} AS f1 FROM ({_DOCS})", ["f0", "f1"], "doc_id", 50
)


def _rounded(hits: DataFrame, *names: str) -> DataFrame:
    return hits.select(*names, F.round("rank", 6).alias("rank"))


def _search_documents(spark: SparkSession, sf_dir: str, asked: str, limit: int = 50) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.scan_search(docs, "doc_id", {"text": F.col("text")}, asked, limit)


@query(_AND)
def search_bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_search_documents(spark, sf_dir, "Licensed, version"), "doc_id")


@query(_PHRASE)
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_search_documents(spark, sf_dir, "apache-license under"), "doc_id")


_PART_DOCS = f"""
  SELECT p_partkey, {sql_text.terms(sql_text.cleaned('p_name'))} AS a, {sql_text.terms(sql_text.cleaned('p_type'))} AS b,
         {sql_text.terms(sql_text.cleaned("coalesce(names, '')"))} AS c
  FROM part LEFT JOIN (
    SELECT l_partkey, string_agg({sql_text.cleaned('s_name')}, ' ' ORDER BY s_name) AS names
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey
  ) ON l_partkey = p_partkey"""


def _multi(term: str) -> str:
    return " + ".join(f"len(list_filter({c}, lambda t: t = '{term}'))" for c in "abc")


def part_terms(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A word of the first part's type and one of its name."""
    row = table(spark, sf_dir, "part").orderBy("p_partkey").select("p_name", "p_type").first()
    return row.p_name.split()[0].lower(), row.p_type.split()[0].lower()


_FIRST = "(SELECT lower(split_part({c}, ' ', 1)) FROM part ORDER BY p_partkey LIMIT 1)"
_MULTI = sql_text.bm25(
    "SELECT p_partkey, len(a) + len(b) + len(c) AS length, "
    + ", ".join(
        " + ".join(f"len(list_filter(list_transform({c}, lambda t: t = w{i}), lambda x: x))" for c in "abc") + f" AS f{i}" for i in (0, 1)
    )
    + f" FROM ({_PART_DOCS}), (SELECT {_FIRST.format(c='p_name')} AS w0, {_FIRST.format(c='p_type')} AS w1)",
    ["f0", "f1"], "p_partkey", 500,
)


@query(_MULTI)
def search_multicolumn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over name, type and the gathered names of a part's suppliers."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    named = pairs.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").withColumn("rom", F.lit(None).cast("string"))
    names = search.joined_names(named, "l_partkey", "s_name", "rom", "names")
    parts = table(spark, sf_dir, "part").join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
    columns = {"name": F.col("p_name"), "type": F.col("p_type"), "names": F.col("names")}
    return _rounded(search.scan_search(parts, "p_partkey", columns, " ".join(part_terms(spark, sf_dir)), 500), "p_partkey")


@query(f"""
  WITH hits AS ({_AND}), paged AS (SELECT *, row_number() OVER (ORDER BY rank, doc_id) AS n FROM hits)
  SELECT doc_id, lang, rank, CAST(ceil(n / 25.0) AS INTEGER) AS page FROM paged JOIN documents USING (doc_id)""")
def search_hydrate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    hits = _rounded(_search_documents(spark, sf_dir, "Licensed, version"), "doc_id")
    from quirespark.operators.catalog import ranked_pages

    return ranked_pages(search.hydrate(hits, docs, "doc_id"), [F.col("rank"), F.col("doc_id")]).select("doc_id", "lang", "rank", "page")


@query("""
  WITH gone AS (SELECT item_id AS doc_id FROM benchmark)
  SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)""")
def index_remove_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(gone, "doc_id", "left_anti")
