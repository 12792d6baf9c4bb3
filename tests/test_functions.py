"""Scalar, MARC, authority and JSON functions, case by case."""

import pytest
from pyspark.sql import functions as F

from quirespark.functions import authority_xml, json_text, marc, text
from quirespark.operators import series

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


CASES = {
    text.strip_marc_punctuation: [
        ("Title /", "Title"), ("Title:", "Title:"), ("Jerusalem :", "Jerusalem"), ("New York ;", "New York"), ("Smith,", "Smith"),
        ("Smith, John A.", "Smith, John A."), ("Foo Inc.", "Foo Inc."), ("ed.", "ed."), ("wait...", "wait..."), ("Boston.", "Boston"),
        ("  x  ", "x"), (None, ""), ("", ""), ("   ", ""), (".", ""), ("A.B.", "A.B"), ("Rabbi.", "Rabbi"), ("a b. ", "a b"),
        ("שלום /", "שלום"), ("x , ", "x"), ("etc.", "etc."), ("J.", "J."),
    ],
    text.normalize_for_comparison: [("Shlomo, Yitzhaki", "shlomo yitzhaki"), ("A-B  (c)!", "ab c!"), ("רש״י", "רשי"), (None, ""), ("  ", ""), ("O'Neil", "oneil")],
    text.normalize_heading: [("Moses, ben  X.", "moses ben  x"), ("", ""), (None, ""), (" A ", "a")],
    text.clean_for_index: [("a:b/c", "a b c"), ("x-y'z", "x-y'z"), (None, ""), ("(a)", "a")],
    text.year_of: [("1998", 1998), ("[1998?]", 1998), ("c1998-2001", 1998), ("98", 98), ("n.d.", None), (None, None), ("", None)],
    text.strict_int: [("2007", 2007), ("2007.", None), (" 12 ", 12), ("", None), (None, None), ("-3", -3)],
    text.date_display: [("n.d.", "n.d."), ("1999", ""), (None, "")],
    text.is_isbn: [("9780306406157", True), ("9780306406158", False), ("0306406152", True), ("97803064061", False), ("9770306406157", False), (None, False), ("", False)],
    text.has_hebrew: [("abc", False), ("abג", True), ("", False), (None, False), ("é", False), ("֐", True)],
    text.direction: [("שלום", "rtl"), ("a", "ltr"), (None, "ltr")],
    text.quote_cql_values: [
        ("alma.title = Talmud Bavli", 'alma.title = "Talmud Bavli"'), ('alma.title = "quoted"', 'alma.title = "quoted"'), ("dc.title=x", "dc.title=x"),
        ("alma.title=a b AND alma.isbn=1", 'alma.title = "a b" AND alma.isbn = "1"'), ("ALMA.x=yes or z", 'ALMA.x = "yes" or z'),
    ],
    text.keyword_query: [("שלום עולם", 'cql.anywhere="שלום" AND cql.anywhere="עולם"'), ("של עולם", None), ("Hello there world", None), (None, None)],
    text.first_words: [("a b c", "a b c"), (" ".join("abcdefghijklmn"), "a b c d e f g h i j k l …"), (None, "")],
}


@pytest.mark.parametrize(("function", "given", "wanted"), [(f, g, w) for f, cases in CASES.items() for g, w in cases], ids=lambda x: getattr(x, "__name__", None))
def test_scalar(spark, function, given, wanted):
    assert value(spark, function(L(given).cast("string"))) == wanted


@pytest.mark.parametrize("n", [0, 1, 61, 62, 1000, 3844, 2**53 + 1, 2**62, 2**63 - 1])
def test_base62(spark, n):
    plain, k = "", n
    while k:
        k, d = divmod(k, 62)
        plain = text.BASE62[d] + plain
    assert value(spark, text.base62(L(n).cast("long"))) == (plain or "0")


def test_base62_fixed_values(spark):
    assert [value(spark, text.base62(L(n))) for n in (0, 61, 62, 1000, 3844)] == ["0", "Z", "10", "g8", "100"]


def test_record_id_and_slug(spark):
    assert value(spark, text.record_id(L(62).cast("long"), "x-")) == "x-10"
    assert value(spark, text.slug(L(""), L("Café  Déjà vu—שלום!"))) == "café-déjà-vuשלום"
    assert value(spark, text.slug(L("Rom Title"), L("x"))) == "rom-title"
    assert len(value(spark, text.slug(L(""), L("a" * 400)))) == 255


def test_shown(spark):
    assert value(spark, text.shown_date(L("n.d."), L(1))) == "n.d."
    assert value(spark, text.shown_date(L(""), L(1990))) == "1990"
    assert value(spark, text.shown_date(L(""), L(0))) == ""
    assert value(spark, text.with_romanized(L("a"), L("b"))) == "a / b"
    assert value(spark, text.with_romanized(L("a"), L(""))) == "a"
    assert value(spark, text.publisher_shown(L("p"), L("x"))) == "p (x)"
    assert value(spark, text.volume_shown(L("s"), L("2"), L(False))) == "s vol. 2 (not held)"


def test_author_queries(spark):
    assert value(spark, text.author_queries(L("Moses"), L(""))) == ['local.personalNames all "Moses"', 'cql.any all "Moses"']
    assert value(spark, text.author_queries(L("Moses"), L("Mosheh"))) == ['local.personalNames all "Mosheh"', 'cql.any all "Moses"']
    assert value(spark, text.author_queries(L("משה מימון הגדול"), L(None).cast("string"))) == [
        'local.personalNames all "משה מימון הגדול"', 'cql.any all "משה מימון הגדול"', 'cql.any all "מימון" AND cql.any all "הגדול" AND cql.any all "משה"',
    ]
    assert value(spark, text.author_queries(L(""), L(""))) == []


def test_cql_templates(spark):
    t = 'alma.title="{title}" AND alma.main_pub_date={date}'
    assert value(spark, text.cql(t, title=L("x"), date=L("1999"))) == 'alma.title="x" AND alma.main_pub_date=1999'
    assert value(spark, text.cql(t, title=L("x"), date=L(""))) is None
    assert value(spark, text.cql(t, title=L("x"))) is None


def test_cache_key_sorts_parameters(spark):
    import hashlib

    params = F.create_map(L("b"), L("2"), L("a"), L("1"))
    assert value(spark, text.cache_key(L("u"), params)) == hashlib.md5(b"u|a=1|b=2").hexdigest()
    assert value(spark, text.query_string(F.create_map(L("q"), L("a b&c")))) == "q=a+b%26c"


def test_tokens(spark):
    assert value(spark, text.tokens(L("Café-Bar שלום 12, x"))) == ["cafe", "bar", "שלום", "12", "x"]
    assert value(spark, text.tokens(L("שָׁלוֹם"))) != ["שלום"]
    assert value(spark, text.tokens(L(None).cast("string"))) == []


@pytest.mark.parametrize(("spec", "wanted"), [
    ("1-5", list("12345")), ("all 3", list("123")), ("ALL  2", list("12")), ("5-1", []), ("all 0", []), ("1, 3,7,", ["1", "3", "7"]), ("2 - 4", list("234")),
    ("supplement", ["supplement"]), ("", []), (None, []), ("7", ["7"]),
])
def test_volume_numbers(spark, spec, wanted):
    assert value(spark, series.volume_numbers(L(spec).cast("string"))) == wanted


# --- MARC -----------------------------------------------------------------------------------------


def sub(**codes):
    return "".join(f'<subfield code="{c.strip("_")}">{v}</subfield>' for c, v in codes.items())


def field(tag, inner, ind1="1", ind2=" "):
    return f'<datafield ind2="{ind2}" tag="{tag}" ind1="{ind1}">{inner}</datafield>'


def response(*records, hits=None, prefix="zs:"):
    ns = 'xmlns:zs="http://www.loc.gov/zing/srw/"' if prefix else 'xmlns="http://www.loc.gov/zing/srw/"'
    count = f"<{prefix}numberOfRecords>{hits}</{prefix}numberOfRecords>" if hits is not None else ""
    body = "".join(
        f'<{prefix}record><{prefix}recordData><record xmlns="http://www.loc.gov/MARC21/slim"><leader>00000nam</leader>{r}</record></{prefix}recordData></{prefix}record>' for r in records
    )
    return f"<{prefix}searchRetrieveResponse {ns}>{count}<{prefix}records>{body}</{prefix}records></{prefix}searchRetrieveResponse>"


F008 = '<controlfield tag="008">850101s1985    is            000 0 heb  </controlfield>'
LINKED = response(
    F008 + field("245", sub(_6="880-01", a="Shalom :", b="sub"), ind2="4") + field("100", sub(a="Author, A."))
    + field("880", sub(_6="100-02/(2", a="מחבר")) + field("880", sub(_6="245-01/(2", a="שלום", b="עוד"))
    + field("650", sub(a="Jews", x="History")) + field("650", sub(x="none")) + field("650", sub(a="Law")) + field("490", sub(a="Series", v="3"))
    + field("700", sub(a="Second")) + field("035", sub(a="(X)1")) + field("035", sub(a="(OCoLC) 77 ")) + field("050", sub(b="B1", a="PJ"))
    + field("082", sub(a="892.4")) + field("010", sub(a="85000001")) + field("020", sub(a="9650000000")),
    hits=42,
)
PLAIN = response(F008 + field("245", sub(a="ספר")) + field("264", sub(a="תל אביב", b="הוצאה", c="2001")) + field("830", sub(a="סדרה", v="1")), prefix="")
NO_DATE = response('<controlfield tag="008">850101s1985</controlfield>' + field("245", sub(b="only b")))


def parsed(spark, xml):
    df = spark.createDataFrame([(xml,)], "data string")
    return [r.b.asDict(True) | {"hits": r.total_hits} for r in marc.records(df).select("total_hits", marc.bibliographic(F.col("marc")).alias("b")).collect()]


def test_record_with_linked_script(spark):
    (r,) = parsed(spark, LINKED)
    assert (r["title"], r["title_alternate"], r["author"], r["author_alternate"]) == ("Shalom : sub", "שלום עוד", "Author, A.", "מחבר")
    assert (r["subjects"], r["additional_authors"], r["series_title"], r["series_volume"]) == (["Jews", "Law"], ["Second"], "Series", "3")
    assert (r["oclc"], r["lc_classification"], r["dewey_classification"], r["lccn"], r["isbn"]) == ("77", "PJ B1", "892.4", "85000001", "9650000000")
    assert (r["language"], r["date"], r["publisher"], r["hits"]) == ("heb", "1985", None, 42)


def test_record_in_its_own_script(spark):
    (r,) = parsed(spark, PLAIN)
    assert (r["title"], r["title_alternate"], r["place"], r["publisher"], r["date"]) == ("ספר", "ספר", "תל אביב", "הוצאה", "2001")
    assert (r["series_title"], r["series_volume"], r["hits"], r["subjects"]) == ("סדרה", "1", 0, [])


def test_short_fixed_field(spark):
    (r,) = parsed(spark, NO_DATE)
    assert (r["date"], r["language"], r["title"]) == ("1985", None, "only b")


@pytest.mark.parametrize("xml", ["not xml", "", None, "<searchRetrieveResponse/>", response(hits=0)])
def test_no_records(spark, xml):
    df = spark.createDataFrame([(xml,)], "data string").select(marc.envelope(F.col("data")).alias("e"))
    e = df.first().e
    assert (e.numberOfRecords, list(e.records)) == (0, [])


def test_marc_json_round_trip(spark):
    import json

    df = marc.records(spark.createDataFrame([(LINKED,)], "data string")).select(marc.to_marc_json(F.col("marc")).alias("j"))
    whole = json.loads(df.first().j)
    assert whole["fields"][0] == {"008": "850101s1985    is            000 0 heb  "}
    assert whole["fields"][1]["245"] == {"ind1": "1", "ind2": "4", "subfields": [{"6": "880-01"}, {"a": "Shalom :"}, {"b": "sub"}]}
    rows = marc.tagged_rows(df, "j").orderBy("field_no", "subfield_no").collect()
    assert (rows[0].tag, rows[0].ind1, rows[0].code) == ("008", " ", "") and [r.value for r in rows if r.tag == "245"] == ["880-01", "Shalom :", "sub"]


# --- Authority files ------------------------------------------------------------------------------


def cluster(number, headings, sources=(), variants=()):
    data = "".join(f"<v:data><v:text>{t}</v:text><v:sources>{''.join(f'<v:s>{s}</v:s>' for s in ss)}</v:sources></v:data>" for t, ss in headings)
    source = "".join(f'<v:source nsid="q">{s}</v:source>' for s in sources)
    x = "".join(f'<v:x400><v:datafield><v:subfield code="a">{a}</v:subfield><v:subfield code="d">{d}</v:subfield></v:datafield><v:normalized>{n}</v:normalized></v:x400>' for a, d, n in variants)
    return f'<v:VIAFCluster xmlns:v="http://viaf.org/viaf/terms#"><v:viafID>{number}</v:viafID><v:sources>{source}</v:sources><v:mainHeadings>{data}</v:mainHeadings><v:x400s>{x}</v:x400s></v:VIAFCluster>'


def clusters(*inside, tail=""):
    body = "".join(f"<record><recordData>{c}</recordData></record>" for c in inside)
    return f'<searchRetrieveResponse xmlns="http://www.loc.gov/zing/srw/"><records>{body}</records></searchRetrieveResponse>{tail}'


FIRST = cluster("1", [("Maimonides, Moses", ["LC", "DNB"]), ("רמב״ם", ["J9U"])], ["LC|n 79", "J9U|98700", "odd"], [("Moses", "ben Maimon", "rambam")])
SECOND = cluster("2", [("Other, One", [])])


def test_clusters(spark):
    found = value(spark, authority_xml.clusters(L(clusters(FIRST, cluster("", []), SECOND, tail="<html>x"))))
    assert [c.viaf_id for c in found] == ["1", "2"]
    assert [(h.text, h.sources) for h in found[0].main_headings] == [("Maimonides, Moses", ["LC", "DNB"]), ("רמב״ם", ["J9U"])]
    assert found[0].source_ids == {"LC": "n 79", "J9U": "98700"}
    assert found[0].variants == ["Moses ben Maimon", "rambam"] and found[1].variants == []
    many = clusters(cluster("3", [], [], [("a", "b", "c")] * 15))
    assert len(value(spark, authority_xml.clusters(L(many)))[0].variants) == 20
    for bad in ("no xml", "", "<a><b></a>"):
        assert value(spark, authority_xml.clusters(L(bad))) == []


@pytest.mark.parametrize(("query", "wanted"), [
    ("Maimonides", True), ("moses MAIMONIDES", True), ("Rambam", True), ("Moses, ben Maimon", True), ("", False), ("Nobody", False), ("rambam the great", True), ("x", False),
])
def test_cluster_matches(spark, query, wanted):
    found = authority_xml.clusters(L(clusters(FIRST)))
    assert value(spark, authority_xml.cluster_matches(F.get(found, L(0)), L(query))) == wanted


def test_best_cluster(spark):
    def best(*inside, name="Maimonides", rom=""):
        found = value(spark, authority_xml.best(authority_xml.clusters(L(clusters(*inside))), L(name), L(rom)))
        return found and found.viaf_id

    third = cluster("9", [("x", [])], ["LC|1", "J9U|2"])
    assert best(SECOND, FIRST) == "1" and best(third, FIRST) == "1" and best(SECOND) is None
    assert best(third, cluster("8", [("y", [])], ["LC|3", "J9U|4"]), name="zz") == "9"
    assert best(cluster("5", [("MOSES", [])]), name="", rom="moses") == "5" and best() is None


# --- JSON -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("given", "title"), [
    ('{"title": "x"}', "x"), ('```json\n{"title": "x"}\n```', "x"), ('```\n{"title": "x"}```', "x"), ('{"title": "רש"י"}', "רש״י"), ('{"author": null}', None),
])
def test_title_page(spark, given, title):
    assert value(spark, json_text.title_page(L(given))).title == title


@pytest.mark.parametrize("given", ["oops", "", None, '{"title": '])
def test_title_page_that_can_not_be_read(spark, given):
    assert value(spark, json_text.title_page(L(given).cast("string"))) is None


@pytest.mark.parametrize(("index", "wanted"), [(0, "a"), (1, "b"), (2, None), (-1, None)])
def test_candidate_at(spark, index, wanted):
    assert value(spark, json_text.candidate_at(F.array(L("a"), L("b")), L(index))) == wanted
