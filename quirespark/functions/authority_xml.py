"""Authority clusters in SRU envelopes: parsing, matching, scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank_if_null, normalize_heading, trimmed

#: How many variants a cluster keeps; what a source and a heading count; the least score.
MOST_VARIANTS, SOURCE_SCORE, HEADING_SCORE, LEAST_SCORE = 20, 2, 5, 2
_END = "</searchRetrieveResponse>"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_texts = T.ArrayType(T.StringType())
_CLUSTER = _struct(
    viafID=T.StringType(),
    mainHeadings=_struct(data=T.ArrayType(_struct(text=T.StringType(), sources=_struct(s=_texts)))),
    sources=_struct(source=T.ArrayType(_struct(_VALUE=T.StringType(), _nsid=T.StringType()))),
    x400s=_struct(x400=T.ArrayType(_struct(datafield=T.ArrayType(_struct(subfield=T.ArrayType(_struct(_VALUE=T.StringType(), _code=T.StringType())))), normalized=T.StringType()))),
)
_ENVELOPE = _struct(records=_struct(record=T.ArrayType(_struct(recordData=_struct(VIAFCluster=_CLUSTER)))))
CLUSTERS = "array<struct<viaf_id:string,main_headings:array<struct<text:string,sources:array<string>>>,source_ids:map<string,string>,variants:array<string>>>"


def clusters(xml: Column) -> Column:
    """Clusters of a response, as an array of structs.

    What follows the response's end tag is cut off first; a text that isn't XML gives none; a cluster
    without an id is passed over; of two ids from one source the later counts.
    """
    whole = F.when(F.instr(xml, _END) > 0, F.concat(F.substring_index(xml, _END, 1), F.lit(_END))).otherwise(xml)
    found = F.from_xml(whole, _ENVELOPE, {"ignoreNamespace": "true", "valueTag": "_VALUE"})["records"]["record"]
    none = F.array().cast("array<string>")

    def heading(d: Column) -> Column:
        return F.struct(d["text"].alias("text"), F.coalesce(F.filter(d["sources"]["s"], lambda s: s != ""), none).alias("sources"))

    def ids(c: Column) -> Column:
        texts = F.filter(F.transform(c["sources"]["source"], lambda s: s["_VALUE"]), lambda s: F.contains(s, F.lit("|")))
        pairs = F.transform(texts, lambda s: F.struct(F.substring_index(s, "|", 1).alias("key"), s.alias("whole")))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
        after = F.transform(last, lambda p: F.struct(p["key"].alias("key"), trimmed(F.substr(p["whole"], F.length(p["key"]) + 2)).alias("value")))
        return F.coalesce(F.map_from_entries(after), F.create_map().cast("map<string,string>"))

    def variants(c: Column) -> Column:
        def of(x: Column) -> Column:
            fields = F.filter(x["datafield"], lambda d: F.size(d["subfield"]) > 0)
            joined = F.transform(fields, lambda d: F.array_join(F.transform(d["subfield"], lambda s: blank_if_null(s["_VALUE"])), " "))
            own = F.when(x["normalized"] != "", F.array(x["normalized"])).otherwise(none)
            return F.concat(F.coalesce(joined, none), own)

        return F.slice(F.coalesce(F.flatten(F.transform(c["x400s"]["x400"], of)), none), 1, MOST_VARIANTS)

    held = F.filter(F.transform(found, lambda r: r["recordData"]["VIAFCluster"]), lambda c: c["viafID"] != "")
    shaped = F.transform(
        held,
        lambda c: F.struct(
            c["viafID"].alias("viaf_id"),
            F.coalesce(F.transform(F.filter(c["mainHeadings"]["data"], lambda d: d["text"] != ""), heading), F.array().cast("array<struct<text:string,sources:array<string>>>")).alias("main_headings"),
            ids(c).alias("source_ids"),
            variants(c).alias("variants"),
        ),
    )
    return F.coalesce(shaped, F.array().cast(CLUSTERS))


def text_matches(text: Column, query: Column) -> Column:
    """Whether one normalised text contains the other, or all of the query's words of two letters and
    more, if there are at least two."""
    t, q = normalize_heading(text), normalize_heading(query)
    words = F.filter(F.split(q, r"(?U)\s+"), lambda w: F.length(w) > 1)
    all_in = (F.size(words) >= 2) & F.forall(words, lambda w: F.contains(t, w))
    return (t != "") & (q != "") & (F.contains(t, q) | F.contains(q, t) | all_in)


def cluster_matches(cluster: Column, query: Column) -> Column:
    texts = F.concat(F.transform(cluster["main_headings"], lambda h: h["text"]), cluster["variants"])
    return F.exists(texts, lambda t: text_matches(t, query))


def score(cluster: Column, name: Column, romanized: Column) -> Column:
    """Points for two sources and for a heading that holds the name (or, in any case, its romanisation)."""
    name, romanized = blank_if_null(name), blank_if_null(romanized)

    def has(source: str) -> Column:
        return F.when(blank_if_null(F.try_element_at(cluster["source_ids"], F.lit(source))) != "", SOURCE_SCORE).otherwise(0)

    def holds(heading: Column) -> Column:
        exact = (name != "") & F.contains(heading["text"], name)
        return exact | ((romanized != "") & F.contains(F.lower(heading["text"]), F.lower(romanized)))

    return has("J9U") + has("LC") + F.when(F.exists(cluster["main_headings"], holds), HEADING_SCORE).otherwise(0)


def best(found: Column, name: Column, romanized: Column) -> Column:
    """The cluster of the highest score, the first of equals; null below the least score."""
    scored = F.transform(found, lambda c, i: F.struct((-score(c, name, romanized)).alias("minus"), i.alias("at"), c.alias("cluster")))
    top = F.array_min(F.transform(scored, lambda x: F.struct(x["minus"].alias("minus"), x["at"].alias("at"))))
    return F.when(top["minus"] <= -LEAST_SCORE, F.get(found, top["at"]))
