"""Operators on small tables."""

import math
import random
import re
import sqlite3
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirespark import schemas
from quirespark.operators import authority, cascade, catalog, covers, ingest, joins, quality, search, series
from quirespark.sources.versions import Conflict, Versions


@pytest.fixture(scope="module")
def tables(spark):
    records = spark.createDataFrame([(i, f"Title {i:03d}", 1950 + i) for i in range(30)], "record_pk long, title string, date_of_publication int")
    authors = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Nobody")], "author_pk long, name string")
    bridge = spark.createDataFrame([(i, 1) for i in range(10)] + [(0, 2), (11, 2)], "record_pk long, author_pk long")
    return records, authors, bridge


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_facets_and_counts(tables):
    records, authors, bridge = tables
    assert rows(catalog.facet_counts(authors, bridge, "author_pk", "name").select("name", "record_count")) == [("Ann", 10), ("Bob", 2)]
    zero = catalog.counts_with_zero(authors, bridge, "author_pk", "author_pk", "record_pk")
    assert rows(zero.select("name", "record_count")) == [("Ann", 10), ("Bob", 2), ("Nobody", 0)]
    assert rows(catalog.orphans(authors, bridge, "author_pk").select("name")) == [("Nobody",)]
    assert rows(catalog.linked(authors, bridge, "author_pk").select("name")) == [("Ann",), ("Bob",)]
    assert catalog.with_member(records, bridge, "author_pk", 2).count() == 2


def test_decades(spark):
    df = spark.createDataFrame([(1950,), (1959,), (1960,), (None,), (-5,), (800,)], "date_of_publication int")
    assert rows(catalog.decades(df)) == [("-10s", 1), ("1950s", 2), ("1960s", 1), ("800s", 1)]


def test_places(spark):
    df = spark.createDataFrame([("Boston",), ("Boston :",), ("New York ;",), ("New York",), ("",), (" : ",)], "place_of_publication string")
    assert rows(catalog.places(df)) == [(":", 1), ("Boston", 2), ("New York", 2)]
    assert catalog.in_place(df, "Boston").count() == 2


def test_script_order_and_pages(spark):
    df = spark.createDataFrame([("b",), ("שלום",), ("a",), ("אב",)], "title string")
    assert [r.title for r in df.orderBy(*catalog.script_order("title")).collect()] == ["אב", "שלום", "a", "b"]
    numbers = spark.range(30)
    page = lambda n: [r.id for r in catalog.page(numbers, [F.col("id")], n).collect()]
    assert page(1) == list(range(25)) and page(2) == list(range(25, 30)) and page(9) == page(2) == page(0)
    assert catalog.page(numbers.where("false"), [F.col("id")], 1).count() == 0
    ranked = catalog.ranked_pages(numbers, [F.col("id")]).where("page = 2")
    assert ranked.count() == 5


def test_related_and_siblings(spark, tables):
    records, _, bridge = tables
    newest = [F.col("date_of_publication").desc(), F.col("related")]
    found = catalog.related(bridge, records, newest, other="author_pk", most=3).where("record_pk = 0").orderBy("position")
    assert [r.related for r in found.collect()] == [11, 9, 8]
    volumes = spark.createDataFrame([(1, 10, "1"), (1, 11, "10"), (1, None, "2"), (2, 12, "1")], "series_pk long, record_pk long, volume_number string")
    assert rows(catalog.siblings(volumes)) == [(10, 11, "10"), (10, None, "2"), (11, 10, "1"), (11, None, "2")]
    assert [r.volume_number for r in volumes.where("series_pk = 1").orderBy("volume_number").collect()] == ["1", "10", "2"]


def test_held_and_gaps(spark):
    s = spark.createDataFrame([(1,), (2,)], "series_pk long")
    v = spark.createDataFrame([(1, n, n <= 3) for n in range(1, 6)], "series_pk long, n int, held boolean")
    assert rows(catalog.held_and_gaps(s, v, "series_pk")) == [(1, 5, 3, 2), (2, 0, 0, 0)]


def test_record_details(tables):
    records, authors, bridge = tables
    relation = catalog.gathered(bridge, authors, "author_pk", "name", "authors")
    whole = catalog.record_details(records.select("record_pk"), {"authors": relation})
    found = {r.record_pk: r.authors for r in whole.collect()}
    assert found[0] == ["Ann", "Bob"] and found[29] == []


def test_home(tables):
    records, authors, _ = tables
    assert rows(catalog.table_counts({"record": records, "author": authors})) == [("author", 3), ("record", 30)]
    assert [r.record_pk for r in catalog.newest(records, [F.col("date_of_publication").desc()]).collect()] == [29, 28, 27, 26, 25]


# --- Search ---------------------------------------------------------------------------------------

TEXTS = [
    (1, "Torah studies", "Moses ben Maimon", "old-book 123-456"), (2, "The Torah of Moses", "Rashi", "x"), (3, "Café life", "Ann Lee", "old book"),
    (4, "ספר התורה", "משה", "book old"), (5, "Moses Moses Moses", "", None), (6, "", "", ""), (7, "A long title with many more words than most others have", "Lee", "torah"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "record_id long, title string, authors string, identifiers string")


def columns():
    return {c: F.col(c) for c in ("title", "authors", "identifiers")}


def sqlite_hits(query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(record_id UNINDEXED, title, authors, identifiers)")
    clean = lambda t: "".join(" " if c in ",;:!?@#$%^&*()[]{}<>=/\\|~`" else c for c in t or "").strip()
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [(i, clean(a), clean(b), c) for i, a, b, c in TEXTS])
    asked = " ".join(f'"{w}"' for w in clean(query).split())
    return [(i, round(r, 6)) for i, r in con.execute("SELECT record_id, rank FROM f WHERE f MATCH ? ORDER BY rank, record_id", (asked,))]


@pytest.mark.parametrize("query", ["torah", "Torah, moses", "cafe", "old-book", "old-book torah", "moses", "התורה", "unknown", "torah unknown", "lee long"])
def test_search_ranks_as_sqlite_does(spark, docs, tmp_path, query):
    want = sorted(sqlite_hits(query))
    got = search.scan_search(docs, "record_id", columns(), query).collect()
    assert sorted((r.record_id, round(r["rank"], 6)) for r in got) == want
    assert [r["rank"] for r in got] == sorted(r["rank"] for r in got)
    index = search.SearchIndex(spark, f"{tmp_path}/index", 4).build(docs, "record_id", columns())
    assert sorted((r.doc, round(r["rank"], 6)) for r in index.search(query).collect()) == want


def test_empty_and_unbalanced_queries(docs):
    assert search.scan_search(docs, "record_id", columns(), " , ").count() == 0
    assert search.query_phrases('רש"י x') == [["רש"], ["י"], ["x"]]


def test_removal_from_the_index(spark, docs, tmp_path):
    index = search.SearchIndex(spark, f"{tmp_path}/index", 4).build(docs, "record_id", columns())
    left = index.remove(spark.createDataFrame([(2,)], "id long"))
    assert sorted(r.doc for r in left.search("torah").collect()) == [1, 7]
    assert left.lengths().count() == 6


def test_hydration_drops_missing_records(spark, docs):
    hits = search.scan_search(docs, "record_id", columns(), "torah")
    assert [r.record_id for r in search.hydrate(hits, docs.where("record_id <> 1"), "record_id").collect()] == [i for i, _ in sqlite_hits("torah") if i != 1]


def test_joined_names(spark):
    names = spark.createDataFrame([(1, "b", "B,"), (1, "a", None), (2, "c", "")], "record_pk long, name string, rom string")
    got = {r.record_pk: r.t.split() for r in search.joined_names(names, "record_pk", "name", "rom", "t").collect()}
    assert got == {1: ["a", "b", "B"], 2: ["c"]}


def test_postings_reads_only_needed_buckets(spark, docs, tmp_path):
    index = search.SearchIndex(spark, f"{tmp_path}/index", 4).build(docs, "record_id", columns())
    plan = index.search("old book-old")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan and "PushedFilters" in plan


def brute_bm25(rows, terms, limit=50):
    """(doc, rank) of documents, a dict, that hold all terms."""
    lists = {i: re.findall(r"\w+", t.lower()) for i, t in rows.items()}
    average = sum(map(len, lists.values())) / len(lists)
    out = []
    for i, words in lists.items():
        total = 0.0
        for t in terms:
            n = sum(t in w for w in lists.values())
            f = words.count(t)
            total += search.idf(len(lists), n) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / average)) if f else -math.inf
        out.append((i, -total))
    return [(i, round(r, 6)) for i, r in sorted((x for x in out if x[1] < math.inf), key=lambda x: (round(x[1], 13), x[0]))[:limit]]


def shown_hits(hits):
    return [(r.doc, round(r["rank"], 6)) for r in hits.collect()]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(5)
    return {i: " ".join(rng.choice(["rare", "often", "often", *(f"w{k}" for k in range(30))]) for _ in range(rng.randrange(1, 60))) if i % 3 else f"filler {i}" for i in range(2000)}


def test_early_stop_reads_few_blocks_and_gives_the_whole_ranking(spark, many, tmp_path, monkeypatch):
    monkeypatch.setattr(search.SearchIndex, "BLOCK", 8)
    index = search.SearchIndex(spark, f"{tmp_path}/index", 4).build(spark.createDataFrame(list(many.items()), "id long, t string"), "id", {"t": F.col("t")})
    for asked, limit in (("rare", 10), ("often rare", 10), ("w3 w4 w4", 5), ("often", 5000)):
        assert shown_hits(index.search(asked, limit)) == brute_bm25(many, asked.split(), limit), asked
        if asked == "rare":
            assert 0 < index.last_read["read"] < index.last_read["postings"] / 4
    assert index.search("often nowhere").collect() == [] and index.search("").collect() == []


def test_index_after_changes_in_any_order_from_any_handle(spark, many, tmp_path, monkeypatch):
    monkeypatch.setattr(search.SearchIndex, "BLOCK", 8)
    monkeypatch.setattr(search.SearchIndex, "SEGMENTS", 3)
    rng, held = random.Random(6), dict(list(many.items())[:300])
    frame = lambda items: spark.createDataFrame(list(items), "id long, t string")
    path, columns_ = f"{tmp_path}/index", {"t": F.col("t")}
    first = search.SearchIndex(spark, path, 4).build(frame(held.items()), "id", columns_)
    handles = [first, search.SearchIndex(spark, path, 4)]
    handles[0].versions.kept = handles[1].versions.kept = 2
    for step in range(5):
        index = handles[step % 2]
        if step % 2:
            ids = rng.sample(sorted(held), 20)
            index.remove(spark.createDataFrame([(i,) for i in [*ids, 10**6]], "id long"))
            held = {i: t for i, t in held.items() if i not in ids}
        else:
            changed = {i: f"often rare w{i % 30} " * (1 + step) for i in [*rng.sample(sorted(held), 15), 5000 + step]}
            index.replace(frame(changed.items()), "id", columns_)
            held |= changed
        asked = ("often", "rare w3")[step % 2]
        assert shown_hits(handles[1 - step % 2].search(asked, 20)) == brute_bm25(held, asked.split(), 20), (step, asked)
    fresh = search.SearchIndex(spark, f"{tmp_path}/fresh", 4).build(frame(held.items()), "id", columns_)
    assert shown_hits(first.search("often-rare", 500)) == shown_hits(fresh.search("often-rare", 500))
    assert rows(first.lengths()) == rows(fresh.lengths()) and rows(first.postings()) == rows(fresh.postings())
    number, state = first.versions.current()
    assert len(state["segments"]) <= 4 and number >= 6  # merges are versions, too
    for segment in state["segments"]:
        for file in Path(path, segment["name"], "postings").rglob("*.parquet"):
            terms = pq.read_table(file, columns=["term"])["term"].to_pylist()
            assert terms == sorted(terms, key=str.encode)
    before = first.vacuum(0)
    assert before > 0 and shown_hits(first.search("often")) == brute_bm25(held, ["often"])


def test_a_small_change_writes_little(spark, many, tmp_path):
    path = f"{tmp_path}/index"
    index = search.SearchIndex(spark, path, 4).build(spark.createDataFrame(list(many.items()), "id long, t string"), "id", {"t": F.col("t")})
    size = lambda: sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))
    built = size()
    index.replace(spark.createDataFrame([(4, "quite new")], "id long, t string"), "id", {"t": F.col("t")})
    assert size() - built < built / 5
    assert shown_hits(index.search("quite new"))[0][0] == 4


def test_two_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    versions = Versions(spark, f"{tmp_path}/v")

    def add(k):
        return Versions(spark, f"{tmp_path}/v").change(lambda state: {"seen": [*state.get("seen", []), k]}, tries=60)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(8)))
    number, state = versions.current()
    assert number == 8 and sorted(state["seen"]) == list(range(8))
    with pytest.raises(Conflict):
        versions.publish(8, {})


def test_index_of_documents_without_terms(spark, tmp_path):
    index = search.SearchIndex(spark, f"{tmp_path}/index").build(spark.createDataFrame([(1, ""), (2, None)], "id long, t string"), "id", {"t": F.col("t")})
    assert index.search("word").collect() == [] and index.lengths().count() == 2
    index.replace(spark.createDataFrame([(2, "word")], "id long, t string"), "id", {"t": F.col("t")})
    assert [r.doc for r in index.search("word").collect()] == [2]
    index.remove(spark.createDataFrame([(1,), (2,)], "id long"))
    assert index.search("word").collect() == []


# --- Authority ------------------------------------------------------------------------------------


def test_author_matches(spark):
    authors = spark.createDataFrame(
        [(1, "Rashi", "", ["Shlomo Yitzhaki"]), (2, "רש״י", "Rashi", []), (3, "X", "", ["Rashi.", "y"]), (4, "Rashi", "Rashi", ["Rashi"]), (5, "", "", ["..."])],
        "pk long, name string, name_romanized string, variant_names array<string>",
    )
    queries = spark.createDataFrame([(1, "Rashi", "Rashi"), (2, "Shlomo, Yitzhaki", ""), (3, "", ""), (4, None, None)], "query_id long, name string, name_romanized string")
    assert rows(authority.author_matches(queries, authors)) == [(1, 1, "exact"), (1, 2, "romanized"), (1, 3, "variant"), (1, 4, "exact"), (2, 1, "variant")]


def test_series_matches(spark):
    held = spark.createDataFrame([(1, "B series"), (2, "b Series."), (3, "Other")], "pk long, title string")
    queries = spark.createDataFrame([(1, "b Series."), (2, "B SERIES"), (3, "none"), (4, "")], "query_id long, title string")
    assert rows(authority.series_matches(queries, held)) == [(1, 2), (2, 1)]


def test_text_matches_equal_all_pairs(spark):
    import itertools
    import random

    from quirespark.functions.authority_xml import text_matches

    rng = random.Random(1)
    words = ["ab", "abc", "a", "xyz", "yz", "moses", "ben", "x.y"]
    make = lambda: " ".join(rng.choices(words, k=rng.randint(0, 3)))
    queries = [(i, make()) for i in range(40)]
    texts = [(i, make()) for i in range(60)]
    q = spark.createDataFrame(queries, "query_id long, query string")
    t = spark.createDataFrame(texts, "text_id long, text string")
    every = q.crossJoin(t).where(text_matches(F.col("text"), F.col("query"))).select("query_id", "text_id")
    assert rows(authority.text_match_pairs(q, t)) == rows(every)
    assert rows(authority.text_match_pairs(q, t, automaton_bytes=0)) == rows(every)
    assert len(list(itertools.product(queries, texts))) == 2400


def test_containment_without_queries_or_with_hot_runs(spark):
    from quirespark.functions.authority_xml import text_matches

    schema = "query_id long, query string"
    texts = spark.createDataFrame([(i, f"a {i % 7}" if i % 3 else "the same heading") for i in range(900)], "text_id long, text string")
    for asked in ([], [(1, "")], [(1, "."), (2, None)]):
        queries = spark.createDataFrame(asked, schema)
        assert authority.text_match_pairs(queries, texts).count() == authority.text_match_pairs(queries, texts, 0).count() == 0
    queries = spark.createDataFrame([(1, "a"), (2, "same"), (3, "heading the"), (4, "a 3 and more")], schema)
    every = queries.crossJoin(texts).where(text_matches(F.col("text"), F.col("query"))).select("query_id", "text_id")
    assert rows(authority.text_match_pairs(queries, texts)) == rows(authority.text_match_pairs(queries, texts, 0)) == rows(every)


# --- Cascades -------------------------------------------------------------------------------------


def test_cascade_skips_steps_and_stops_at_hits(spark):
    metadata = spark.createDataFrame([(1, "t", "", "1999", ""), (2, "u", "p", "", ""), (3, "", "p", "1", "x")], "query_id long, title string, place string, date string, publisher string")
    steps = cascade.step_queries(metadata)
    assert [r.step for r in steps.where("query_id = 1").orderBy("step_no").collect()] == ["title+date", "keywords+date", "title"]
    assert [r.step for r in steps.where("query_id = 2").orderBy("step_no").collect()] == ["title+place", "title"]
    assert steps.where("query_id = 3").count() == 0
    asked = []

    def answer(now):
        asked.append(sorted(r.step for r in now.collect()))
        return now.where("step IN ('keywords+date', 'title')").withColumn("record", F.lit("r"))

    found = cascade.run(metadata, answer)
    assert rows(found.select("query_id", "step")) == [(1, "keywords+date"), (2, "title")]
    assert ["title"] == asked[-1] or asked[-1] == []
    hebrew = spark.createDataFrame([(1, "שלום עולם", "")], "query_id long, title string, date string")
    assert [r.step for r in cascade.step_queries(hebrew, cascade.LC_STEPS).collect()] == ["keywords"]


def test_first_hits_and_union(spark):
    hits = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (1, 1, "c"), (2, 5, "d")], "query_id long, step_no int, record string")
    assert rows(cascade.first_hits(hits).select("record")) == [("b",), ("c",), ("d",)]
    one = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "query_id long, position int, title string")
    none = one.where("false")
    union = cascade.union_of_catalogs({"NLI": one, "LC": none, "DNB": one})
    assert [(r.source_catalog, r.ordinal) for r in union.orderBy("ordinal").collect()] == [("NLI", 0), ("NLI", 1), ("DNB", 2), ("DNB", 3)]


# --- Series and ingest ----------------------------------------------------------------------------


def test_wide_gaps_are_ranges(spark):
    v = spark.createDataFrame([(1, "1"), (1, "2000000000"), (1, "x"), (2, "-3"), (2, "+1"), (2, "4096"), (2, "4096"), (3, "7"), (4, "99999999999")], "series_pk int, volume_number string")
    assert rows(series.gap_ranges(v)) == [(1, 2, 1999999999), (2, -2, 0), (2, 2, 4095)]
    assert rows(series.gaps(v, most=4097)) == [(1, None), (2, [-2, -1, 0, *range(2, 4096)])]


def test_gaps_of_a_hot_series(spark):
    rng = random.Random(8)
    held = {k: sorted({rng.randrange(-50_000, 50_000) for _ in range(n)}) for k, n in ((1, 20_000), (2, 50), (3, 1))}
    v = spark.createDataFrame([(k, str(n)) for k, ns in held.items() for n in ns], "series_pk int, volume_number string").repartition(6)
    want = [(k, x + 1, y - 1) for k, ns in held.items() for x, y in zip(ns, ns[1:], strict=False) if y - x > 1]
    assert rows(series.gap_ranges(v)) == sorted(want, key=str)


def test_wide_specs(spark):
    specs = spark.createDataFrame([(1, "5-30004"), (2, "1-2"), (3, "9-2"), (4, "a,b"), (5, None), (6, "1-2000000000")], "series_pk int, spec string")
    got = series.volume_rows(specs.where("series_pk < 6"))
    assert rows(got.groupBy("series_pk").agg(F.count("volume_number"), F.countDistinct("volume_number"))) == [(1, 30000, 30000), (2, 2, 2), (4, 2, 2)]
    assert series.volume_rows(specs.where("series_pk = 6")).limit(3).count() == 3  # no array holds them
    assert specs.select(series.volume_numbers(F.col("spec")).alias("n")).where("n IS NULL").count() == 2


def test_gaps(spark):
    v = spark.createDataFrame([(1, "1"), (1, "4"), (1, "supplement"), (2, "1"), (2, "2"), (3, "x"), (1, "2.")], "series_pk long, volume_number string")
    assert rows(series.gaps(v)) == [(1, [2, 3])]


def test_new_volumes(spark):
    specs = spark.createDataFrame([(1, "1-5"), (1, "5"), (2, "all 1")], "series_pk long, spec string")
    had = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3")], "series_pk long, volume_number string")
    at_hand = spark.createDataFrame([(1, "4", 77)], "series_pk long, volume_number string, record_pk long")
    assert rows(series.new_volumes(specs, had, at_hand)) == [(1, "4", 77, True), (1, "5", None, False), (2, "1", None, False)]
    assert series.new_volumes(specs, had).where("held").count() == 0


def test_get_or_create(spark):
    dimension = spark.createDataFrame([(5, "a"), (9, "b")], "pk long, name string")
    incoming = spark.createDataFrame([("c", "z"), ("a", "q"), ("d", "y"), ("c", "x"), ("", "w"), (None, "v")], "name string, place string")
    assert rows(ingest.get_or_create(dimension, incoming, "name").select("pk", "name", "place")) == [(10, "c", "x"), (11, "d", "y")]
    assert ingest.get_or_create(dimension.where("false"), incoming.select("name"), "name").count() == 3


def test_numbered_is_dense(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009).repartition(7)
    got = [r.n for r in ingest.numbered(df, [F.col("k")], "n").orderBy("k").collect()]
    assert got == list(range(1, 1001))


CANDIDATE = ("1", "Title /", "כותר", "Place :", "Pub,", "heb", "2007.", " 123 ", "", "77", "PJ1", None, ["Sub.", "", "Two"])
SCHEMA = ("record_pk string, title string, title_alternate string, place string, publisher string, language string, date string, isbn string, lccn string, oclc string, "
          "lc_classification string, dewey_classification string, subjects array<string>")  # fmt: skip


def test_records_from_candidates(spark):
    df = spark.createDataFrame([CANDIDATE], SCHEMA)
    web, queue = ingest.records_from_candidates(df).first(), ingest.records_from_queue(df).first()
    assert (web.title, web.title_romanized, web.place_of_publication, web.date_of_publication, web.date_of_publication_display) == ("Title", "כותר", "Place", 2007, "")
    assert (queue.title, queue.date_of_publication) == ("Title", None)
    assert rows(ingest.identifiers(df)) == [("1", "ISBN", "123"), ("1", "LCC", "PJ1"), ("1", "OCLC", "77")]
    assert rows(ingest.relations(df, "subjects")) == [("1", "Sub"), ("1", "Two")]


def test_public_ids(spark):
    df = spark.createDataFrame([(62, "A b", "", ""), (1, "x", "", "kept")], "pk long, title string, title_romanized string, slug string")
    assert rows(ingest.with_public_ids(df).select("record_id", "slug")) == [("rec-1", "kept"), ("rec-10", "a-b")]


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "record_pk long, x string, y int")
    changes = spark.createDataFrame([(2, "B"), (3, "c")], "record_pk long, x string")
    assert rows(ingest.upsert(t, changes, "record_pk")) == [(1, "a", 1), (2, "B", 2), (3, "c", None)]
    tables = {"record": t, "identifier": t, "scan": t}
    out = ingest.delete_records(spark.createDataFrame([(1,)], "record_pk long"), tables, ("record", "identifier"), ("scan",))
    assert rows(out["record"]) == [(2, "b", 2)] and rows(out["scan"]) == [(2, "b", 2), (None, "a", 1)]
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert ingest.add_pairs(pairs, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).count() == 2


def test_states_and_queue(spark):
    events = spark.createDataFrame([(1, "pending", 1, 7), (1, "confirmed", 2, 7), (2, "pending", 1, 8), (3, "pending", 5, 7)], "scan_id long, status string, ts int, scanned_by long")
    last = ingest.latest_state(events, "scan_id", "ts")
    assert rows(last.select("scan_id", "status")) == [(1, "confirmed"), (2, "pending"), (3, "pending")]
    assert rows(ingest.queue_of(last, 7, False).select("scan_id")) == [(3,)] and ingest.queue_of(last, 7, True).count() == 2


# --- Quality, covers, schemas ---------------------------------------------------------------------


def test_punctuation_report(spark):
    df = spark.createDataFrame([(1, "a /", "b"), (2, "c", None), (3, "d.", "e,")], "pk long, title string, place string")
    changes = quality.punctuation_changes(df, "record", "pk", ["title", "place"])
    assert rows(changes) == [("record", 1, "title", "a /", "a"), ("record", 3, "place", "e,", "e"), ("record", 3, "title", "d.", "d")]
    assert rows(quality.change_counts(changes)) == [("record", 3), ("total", 3)]
    assert rows(quality.clean_punctuation(df, ["title", "place"])) == [(1, "a", "b"), (2, "c", ""), (3, "d", "e")]


def test_retention(spark):
    now = datetime(2024, 3, 1)
    df = spark.createDataFrame(
        [(1, "discarded", datetime(2024, 1, 30)), (2, "discarded", datetime(2024, 2, 20)), (3, "pending", datetime(2023, 1, 1)), (4, "discarded", None), (5, "discarded", datetime(2024, 1, 31))],
        "pk long, status string, updated_at timestamp",
    )
    assert rows(quality.retained(df, now).select("pk")) == [(2,), (3,), (4,), (5,)]


def test_covers(spark):
    ids = spark.createDataFrame([(1, "LCCN", "9"), (1, "ISBN", "2"), (1, "ISBN", "1"), (2, "OCLC", "5"), (3, "DDC", "x")], "record_pk long, identifier_type string, value string")
    candidates = covers.cover_candidates(ids, base_url="b")
    assert rows(candidates) == [(1, 1, "b/isbn/1-M.jpg"), (1, 3, "b/lccn/9-M.jpg"), (2, 2, "b/oclc/5-M.jpg")]
    sizes = spark.createDataFrame([("b/isbn/1-M.jpg", 99), ("b/lccn/9-M.jpg", 100)], "url string, body_size long")
    assert rows(covers.best_covers(candidates, sizes)) == [(1, "b/lccn/9-M.jpg")]
    records = spark.createDataFrame([(1, ""), (2, "u"), (4, "")], "record_pk long, cover_url string")
    assert rows(covers.without_cover(records, ids)) == [(1, "")]


def test_schemas(spark):
    old = spark.createDataFrame([(1, "x", None)], "pk long, title string, notes string")
    whole = schemas.conform(old, schemas.RECORD).first()
    assert (whole.title, whole.notes, whole.cover_url, whole.date_of_publication) == ("x", "", "", None)
    assert schemas.conform(old, schemas.RECORD).schema.simpleString() == schemas.RECORD.simpleString()
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert rows(schemas.violations(pairs, ["k", "v"])) == [(1, "a", 2)]
    assert schemas.out_of_range(pairs, "v", ("a",)).count() == 1


def test_author_cascade(spark):
    authors = spark.createDataFrame([(1, "Moses", ""), (2, "משה מימון", "Mosheh"), (3, "", "")], "query_id long, name string, name_romanized string")
    steps = authority.author_steps(authors)
    assert [r.query for r in steps.where("query_id = 1").orderBy("step_no").collect()] == ['local.personalNames all "Moses"', 'cql.any all "Moses"']
    found = cascade.run_steps(steps, lambda now: now.where(F.col("query").startswith("cql")).withColumn("record", F.lit("r")), 5)
    assert rows(found.select("query_id", "step_no")) == [(1, 1), (2, 2)]


def test_cover_backfill(spark):
    ids = spark.createDataFrame([(1, "ISBN", "1"), (2, "OCLC", "5")], "record_pk long, identifier_type string, value string")
    records = spark.createDataFrame([(1, ""), (2, "had")], "record_pk long, cover_url string")
    sizes = spark.createDataFrame([("b/isbn/1-M.jpg", 100), ("b/oclc/5-M.jpg", 100)], "url string, body_size long")
    assert rows(covers.backfill(records, ids, sizes, base_url="b")) == [(1, "b/isbn/1-M.jpg")]


def test_index_replaces_documents(spark, docs, tmp_path):
    index = search.SearchIndex(spark, f"{tmp_path}/index", 4).build(docs, "record_id", columns())
    changed = spark.createDataFrame([(1, "Quite different", "", ""), (99, "torah anew", "", "")], docs.schema)
    out = index.replace(changed, "record_id", columns())
    assert sorted(r.doc for r in out.search("torah").collect()) == [2, 7, 99] and [r.doc for r in out.search("different").collect()] == [1]
    assert out.lengths().count() == len(TEXTS) + 1


def test_forms(spark):
    entry = (1, "T /", "", "s", "1999", "", "Place :", "eng", None, "Ann,\nBob", "x.", "", None, " 978 ")
    tables = ingest.from_forms(spark.createDataFrame([entry], schemas.MANUAL_ENTRY))
    assert (tables["record"].first().title, tables["record"].first().date_of_publication) == ("T", 1999)
    assert rows(tables["authors"]) == [(1, "Ann"), (1, "Bob")] and rows(tables["isbns"]) == [(1, "978")] and tables["locations"].count() == 0
    minimal = spark.createDataFrame([(2, "Only", *[None] * 12)], schemas.MANUAL_ENTRY)
    assert ingest.from_forms(minimal)["record"].first().place_of_publication == ""


def test_related_of_a_hot_member(spark):
    """One member has a third of all records; the rows are those of a plain self-join."""
    pairs = [(i, 0) for i in range(0, 600, 3)] + [(i, i % 40 + 1) for i in range(600)]
    bridge = spark.createDataFrame(pairs, "record_pk long, other_pk long")
    records = spark.createDataFrame([(i, i % 7) for i in range(600)], "record_pk long, year long")
    got = catalog.related(bridge, records, [F.col("year").desc(), F.col("related")], most=5)
    members = {}
    for r, o in pairs:
        members.setdefault(o, set()).add(r)
    want = []
    for i in range(600):
        mine = {x for o, rs in members.items() if i in rs for x in rs} - {i}
        want += [(i, x, k + 1) for k, x in enumerate(sorted(mine, key=lambda x: (-(x % 7), x))[:5])]
    assert rows(got) == sorted(want, key=str)


def test_related_are_merged_from_lists(spark):
    """Lists of one record come in many batches, some records share several members, ids are texts, some are null;
    no row is dealt or sorted for each pair."""
    pairs = [("r000", m) for m in range(120)] + [(f"r{i:03}", m) for i in range(1, 200) for m in (i % 120, i % 7, i % 11 + 50)] + [(None, 3), ("r005", None), ("alone", 999)]
    bridge = spark.createDataFrame([*pairs, *pairs[:40]], "record_pk string, other_pk long")
    records = spark.createDataFrame([(f"r{i:03}", i % 9) for i in range(190)], "record_pk string, year long")  # some are in the bridge alone
    members = {}
    for r, o in pairs:
        if r is not None and o is not None:
            members.setdefault(o, set()).add(r)
    year = {f"r{i:03}": i % 9 for i in range(190)}
    want = []
    for i in {r for r, _ in pairs if r is not None}:
        mine = {x for rs in members.values() if i in rs for x in rs if x in year} - {i}
        want += [(i, x, k + 1) for k, x in enumerate(sorted(mine, key=lambda x: (-year[x], x))[:4])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = catalog.related(bridge, records, [F.col("year").desc(), F.col("related")], most=4)
        assert rows(found) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "HashAggregate(keys=[record_pk" not in plan


def test_join_in_blocks(spark):
    """Keys of many rows on either side, on one only, and nulls, as a plain join has them."""
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "left").otherwise(F.col("id").cast("string")).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, 1), ("hot", 0)], "k string, id long"))
    right = left.where("k IS NULL OR k <> 'left'").withColumnRenamed("id", "other")
    want = rows(left.join(right, "k"))
    assert rows(joins.join_blocks(left, right, ["k"], 7)) == want == rows(joins.join_blocks(left, right, ["k"]))


def test_author_matches_shuffle_no_pairs(spark):
    """A name that many share; each pair once, and only shuffled together again if ids repeat."""
    authors = spark.range(40).select(
        F.col("id").alias("pk"), F.when(F.col("id") % 2 == 0, "Same").alias("name"), F.lit("Rom").alias("name_romanized"),
        F.array(F.lit("Rom."), F.lit("same"), F.lit(None).cast("string")).alias("variant_names"),
    )
    queries = spark.createDataFrame([(1, "Same", "Rom"), (2, "SAME,", "rom"), (3, None, "Rom")], "query_id int, name string, name_romanized string")
    found = authority.author_matches(queries, authors)
    kind = lambda q, k: "variant" if q == 2 else "exact" if q == 1 and k % 2 == 0 else "romanized"
    assert rows(found) == sorted(((q, k, kind(q, k)) for q in (1, 2, 3) for k in range(40)), key=str)
    assert "keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(authority.author_matches(queries.withColumn("query_id", F.lit(1)), authors)) == sorted(((1, k, "romanized" if k % 2 else "exact") for k in range(40)), key=str)


def test_pairs_have_tasks(spark, monkeypatch):
    """Adaptive execution would give the few bytes of keys that make many pairs to one task."""
    monkeypatch.setattr(joins, "TASK_PAIRS", 1000, raising=False)
    left = spark.range(120).select(F.when(F.col("id") >= 0, "hot").alias("k"), "id")
    found = joins.join_blocks(left, left.withColumnRenamed("id", "other"), ["k"], 10)
    sizes = sorted(r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    assert sum(sizes) == 120 * 120 and len(sizes) >= 8 and sizes[-1] < sum(sizes) // 2


def test_author_matches_list_authors(spark, monkeypatch):
    """Pairs come from arrays, those of two authors apart only where an earlier kind of match tells them apart."""
    monkeypatch.setattr(joins, "TASK_PAIRS", 100, raising=False)
    monkeypatch.setattr(authority, "dealt_blocks", lambda asked, held, on: joins.dealt_blocks(asked, held, on, 10), raising=False)
    name = F.concat(F.lit("n"), (F.col("id") % 7).cast("string"))
    variants = F.when(F.col("id") % 5 > 0, F.array(F.concat(F.lit("V. "), name), F.when(F.col("id") % 2 == 0, "Rom."), F.lit("-")))
    authors = spark.range(90).select(
        F.when(F.col("id") < 89, F.col("id")).alias("pk"), F.when(F.col("id") % 11 > 0, name).alias("name"), F.when(F.col("id") % 3 > 0, "Rom").alias("name_romanized"),
        variants.alias("variant_names"),
    )
    asked = [(None, "n1", "Rom"), (2, "v n2", "Rom"), (3, None, "Rom"), (4, "rom", "ROM"), (5, "n3", None), (6, "V n4", "v, n4"), (7, "", ""), (8, "Rom", "V n5")]
    found = authority.author_matches(spark.createDataFrame(asked, "query_id int, name string, name_romanized string"), authors)

    def kind(a, n, r):
        forms = {"".join(c for c in v.lower() if c not in ".-,").strip() for v in a.variant_names or [] if v} - {""}
        form = lambda x: "".join(c for c in (x or "").lower() if c not in ".-,").strip()
        if n and a.name == n:
            return "exact"
        return "romanized" if r and a.name_romanized == r else "variant" if {form(n), form(r)} & forms else None

    want = [(q, a.pk, kind(a, n, r)) for q, n, r in asked for a in authors.collect() if kind(a, n, r)]
    assert rows(found) == sorted(want, key=str) and {k for *_, k in want} == {"exact", "romanized", "variant"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(pks") < plan.index("Join Inner") and "Union" not in plan


def test_first_equal_steps(spark):
    """Steps of which each counts only for queries without a hit so far; a row is no hit of its own."""
    held = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", None), (5, "b", 3), (6, "c", 4)], "hit int, x string, y int")
    queries = held.withColumnRenamed("hit", "query_id")
    found = cascade.first_equal(queries, held, [["x", "y"], ["x"]])
    assert rows(found) == [(1, 2, 0), (2, 1, 0), (3, 1, 1), (3, 2, 1), (4, 5, 1), (5, 4, 1)]
    # An id in two rows, of which one has a hit in the first step.
    again = cascade.first_equal(queries.where("query_id IN (1, 5)").withColumn("query_id", F.lit(1)), held, [["x", "y"], ["x"]])
    assert rows(again) == [(1, 2, 0), (1, 5, 0)]


def test_postings_are_dealt_by_document(spark, tmp_path):
    """Neither a row for each posting nor a document's terms more than once is shuffled."""
    texts = F.array(F.split(F.lit("b a b"), " "), F.split(F.lit("a"), " "), F.array().cast("array<string>"))
    (bucket, packed), = spark.range(1).select(F.inline(search._postings(texts, 1))).collect()
    assert (bucket, packed) == (0, f"a:1,{1 << 40} b:0,2")
    one = spark.createDataFrame([(packed,)], "p string").select(F.inline(search._unpacked(F.col("p"))))
    assert rows(one) == [("a", [1, 1 << 40]), ("b", [0, 2])]
    docs = spark.range(50).select(F.col("id").alias("doc"), F.when(F.col("id") > 0, F.concat(F.lit("same Word "), F.col("id").cast("string"))).alias("text"))
    index = search.SearchIndex(spark, f"file://{tmp_path}/index").build(docs, "doc", {"a": F.col("text"), "b": F.lit("word")})
    want = [("word", 0, 1, [1 << 40])] + [r for k in range(1, 50) for r in (("same", k, 4, [0]), ("word", k, 4, [1, 1 << 40]), (str(k), k, 4, [2]))]
    assert rows(index.postings().select("term", "doc", "length", "positions")) == sorted(want, key=str)
    _, held = index._texts(docs, "doc", {"a": F.col("text")})
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()


def test_new_volumes_read_no_patterns_into_what_is_held(spark):
    """Volumes that exist aren't held against the patterns that part specifications."""
    specs = spark.range(3).select(F.col("id").alias("series_pk"), F.concat(F.lit("1-"), (F.col("id") % 3).cast("string")).alias("spec"))
    held = spark.range(4).select((F.col("id") % 3).alias("series_pk"), F.lit("1").alias("volume_number"), F.col("id").alias("record_pk"))
    found = series.new_volumes(specs, held.where("series_pk = 1"), held)
    assert rows(found) == [(2, "1", 2, True), (2, "2", None, False)]
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
