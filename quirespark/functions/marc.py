"""MARC records in SRU envelopes: parsing, field access, bibliographic fields, tagged rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank_if_null, has_hebrew, trimmed

_SUBFIELD = T.StructType([T.StructField("_code", T.StringType()), T.StructField("_VALUE", T.StringType())])
MARC_RECORD = T.StructType([
    T.StructField("leader", T.StringType()),
    T.StructField("controlfield", T.ArrayType(T.StructType([T.StructField("_tag", T.StringType()), T.StructField("_VALUE", T.StringType())]))),
    T.StructField("datafield", T.ArrayType(T.StructType([
        T.StructField("_tag", T.StringType()), T.StructField("_ind1", T.StringType()), T.StructField("_ind2", T.StringType()),
        T.StructField("subfield", T.ArrayType(_SUBFIELD)),
    ]))),
])
ENVELOPE = T.StructType([
    T.StructField("numberOfRecords", T.LongType()),
    T.StructField("records", T.StructType([T.StructField("record", T.ArrayType(T.StructType([
        T.StructField("recordData", T.StructType([T.StructField("record", MARC_RECORD)])),
    ])))])),
])
_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}


def envelope(xml: Column) -> Column:
    """``struct(numberOfRecords, records)`` of an SRU response.

    A missing count is 0; record data without a MARC record is passed over; a text that isn't XML gives
    0 and no records.
    """

    def of(parsed: Column) -> Column:
        all_ = F.coalesce(F.transform(parsed["records"]["record"], lambda r: r["recordData"]["record"]), F.array().cast(T.ArrayType(MARC_RECORD)))
        held = F.filter(all_, lambda r: r.isNotNull() & (r["datafield"].isNotNull() | r["controlfield"].isNotNull()))
        return F.struct(F.coalesce(parsed["numberOfRecords"], F.lit(0)).alias("numberOfRecords"), held.alias("records"))

    return F.get(F.transform(F.array(F.from_xml(xml, ENVELOPE, _XML)), of), F.lit(0))  # bound to a name, so that it is parsed once


def records(responses: DataFrame, xml_col: str = "data") -> DataFrame:
    """One row for each MARC record of each response: its columns, ``total_hits``, ``position``, ``marc``."""
    found = responses.select("*", F.explode(F.array(envelope(F.col(xml_col)))).alias("__envelope"))  # parsed once, used twice
    return (
        found.select("*", F.col("__envelope.numberOfRecords").alias("total_hits"), F.posexplode("__envelope.records").alias("position", "marc"))
        .drop("__envelope")
    )


def _subfields(field: Column, codes: Sequence[str]) -> Column:
    """Values of the codes, one code after another, joined by spaces; null if there are none."""

    def of(code: str) -> Column:
        return F.transform(F.filter(field["subfield"], lambda s: s["_code"] == code), lambda s: s["_VALUE"])

    values = F.filter(F.flatten(F.array(*map(of, codes))), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.array_join(values, " "))


def _fields(marc: Column, tag: str) -> Column:
    return F.filter(marc["datafield"], lambda f: f["_tag"] == tag)


def control(marc: Column, tag: str) -> Column:
    value = F.get(F.filter(marc["controlfield"], lambda f: f["_tag"] == tag), F.lit(0))["_VALUE"]
    return F.when(value != "", value)


def value(marc: Column, tag: str, codes: Sequence[str]) -> Column:
    """Values of the codes in the first field of the tag."""
    return _value(_fields(marc, tag), codes)


def _value(fields: Column, codes: Sequence[str]) -> Column:
    return _subfields(F.get(fields, F.lit(0)), codes)


def linked(marc: Column, tag: str, codes: Sequence[str]) -> Column:
    """The same from the first field 880 that is linked to the tag and has any of the codes."""
    return _linked(_fields(marc, "880"), tag, codes)


def _linked(fields: Column, tag: str, codes: Sequence[str]) -> Column:
    def link(field: Column) -> Column:
        return F.get(F.filter(field["subfield"], lambda s: s["_code"] == "6"), F.lit(0))["_VALUE"]

    own = F.filter(fields, lambda f: F.startswith(link(f), F.lit(f"{tag}-")))
    return F.get(F.filter(F.transform(own, lambda f: _subfields(f, codes)), lambda v: v.isNotNull()), F.lit(0))


def each_first(marc: Column, tag: str, code: str) -> Column:
    """The first value of a code in every field of the tag that has one."""
    return _each_first(_fields(marc, tag), code)


def _each_first(fields: Column, code: str) -> Column:
    firsts = F.transform(fields, lambda f: F.get(F.filter(f["subfield"], lambda s: s["_code"] == code), F.lit(0))["_VALUE"])
    return F.coalesce(F.filter(firsts, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def oclc_number(marc: Column) -> Column:
    return _oclc_number(_fields(marc, "035"))


def _oclc_number(fields: Column) -> Column:
    own = F.filter(_each_first(fields, "a"), lambda v: F.contains(v, F.lit("OCoLC")))
    return trimmed(F.replace(F.get(own, F.lit(0)), F.lit("(OCoLC)"), F.lit("")))


#: Tags that ``bibliographic`` reads.
_TAGS = ("010", "020", "035", "050", "082", "100", "245", "260", "264", "490", "650", "700", "830", "880")


def bibliographic(marc: Column) -> Column:
    """The fields that a catalogue keeps of a record, as a struct of 17.  Each tag's fields are found once."""
    fields = F.struct(control(marc, "008").alias("fixed"), *(_fields(marc, tag).alias(f"f{tag}") for tag in _TAGS))
    return F.get(F.transform(F.array(fields), _bibliographic), F.lit(0))


def _bibliographic(fields: Column) -> Column:
    of = {tag: fields[f"f{tag}"] for tag in _TAGS}
    title, author = _value(of["245"], ["a", "b"]), _value(of["100"], ["a"])
    fixed = fields["fixed"]

    def alternate(tag: str, codes: Sequence[str], primary: Column) -> Column:
        return F.coalesce(_linked(of["880"], tag, codes), F.when(has_hebrew(primary), primary))

    def either(code: str, *tags: str) -> Column:
        return F.coalesce(*(_value(of[tag], [code]) for tag in tags))

    return F.struct(
        title.alias("title"),
        alternate("245", ["a", "b"], title).alias("title_alternate"),
        author.alias("author"),
        alternate("100", ["a"], author).alias("author_alternate"),
        either("b", "260", "264").alias("publisher"),
        either("a", "260", "264").alias("place"),
        F.coalesce(either("c", "260", "264"), F.when(F.length(fixed) >= 11, F.substring(fixed, 8, 4))).alias("date"),
        F.when(F.length(fixed) >= 38, F.substring(fixed, 36, 3)).alias("language"),
        _value(of["020"], ["a"]).alias("isbn"),
        _each_first(of["700"], "a").alias("additional_authors"),
        _each_first(of["650"], "a").alias("subjects"),
        _value(of["010"], ["a"]).alias("lccn"),
        _oclc_number(of["035"]).alias("oclc"),
        _value(of["050"], ["a", "b"]).alias("lc_classification"),
        _value(of["082"], ["a"]).alias("dewey_classification"),
        either("a", "490", "830").alias("series_title"),
        either("v", "490", "830").alias("series_volume"),
    )


def to_marc_json(marc: Column) -> Column:
    """MARC-in-JSON: a leader and a list of one-key objects, control fields as text."""
    quoted = lambda c: F.to_json(F.struct(c.alias("x")))

    def text(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(quoted(blank_if_null(c)), r'^\{"x":', ""), r"\}$", "")

    controls = F.transform(marc["controlfield"], lambda f: F.concat(F.lit("{"), text(f["_tag"]), F.lit(":"), text(f["_VALUE"]), F.lit("}")))
    subfield = lambda s: F.concat(F.lit("{"), text(s["_code"]), F.lit(":"), text(s["_VALUE"]), F.lit("}"))
    data = F.transform(
        marc["datafield"],
        lambda f: F.concat(
            F.lit("{"), text(f["_tag"]), F.lit(':{"ind1":'), text(f["_ind1"]), F.lit(',"ind2":'), text(f["_ind2"]),
            F.lit(',"subfields":['), F.array_join(F.transform(f["subfield"], subfield), ","), F.lit("]}}"),
        ),
    )
    none = F.array().cast("array<string>")
    fields = F.array_join(F.concat(F.coalesce(controls, none), F.coalesce(data, none)), ",")
    return F.concat(F.lit('{"leader":'), text(marc["leader"]), F.lit(',"fields":['), fields, F.lit("]}"))


def tagged_rows(df: DataFrame, json_col: str) -> DataFrame:
    """One row for each subfield of MARC-in-JSON: the columns of ``df``, ``field_no, tag, ind1, ind2,
    subfield_no, code, value``.  Missing indicators are blanks; a plain value has the empty code."""
    fields = F.from_json(F.get_json_object(F.col(json_col), "$.fields"), "array<map<string,string>>")
    flat = df.select("*", F.posexplode(fields).alias("field_no", "__field")).select(
        *df.columns, "field_no", F.explode("__field").alias("tag", "__content")
    )
    nested = F.from_json("__content", "struct<ind1:string,ind2:string,subfields:array<map<string,string>>>")
    is_nested = F.col("__content").startswith("{")
    plain = F.array(F.create_map(F.lit(""), F.col("__content")))
    parts = F.when(is_nested, nested["subfields"]).otherwise(plain)
    split = flat.select(
        *df.columns, "field_no", "tag",
        F.when(is_nested, F.coalesce(nested["ind1"], F.lit(" "))).otherwise(F.lit(" ")).alias("ind1"),
        F.when(is_nested, F.coalesce(nested["ind2"], F.lit(" "))).otherwise(F.lit(" ")).alias("ind2"),
        F.posexplode(F.flatten(F.transform(parts, F.map_entries))).alias("subfield_no", "__part"),
    )
    return split.withColumns({"code": F.col("__part.key"), "value": F.col("__part.value")}).drop("__part")
