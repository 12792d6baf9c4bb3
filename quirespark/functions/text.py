"""Scalar text, identifier and date expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations after which a final full stop stays.
ABBREVIATIONS = (
    "Jr", "Sr", "Inc", "Ltd", "ed", "Rev", "Dr", "Mr", "Mrs", "Ms", "Prof", "Vol", "vol", "No", "no", "Dept",
    "dept", "Assn", "Bros", "Co", "Corp", "Dist", "Div", "Est", "Gen", "Gov", "Sgt", "St", "Univ", "etc",
)
#: The Hebrew block; marks dropped in comparisons; marks dropped before indexing.
HEBREW = "[֐-׿]"
COMPARED_AWAY = "[\"\\-,.:;/\\\\'()|׳״]"
INDEXED_AWAY = r"[,;:!?@#$%^&*()\[\]{}<>=/\\|~`]"
#: What ends a catalogue field; an unquoted value of an index, up to a boolean or the end.
FIELD_END = r"(?U)\s+[;:/]$|,$"
UNQUOTED_VALUE = r'(?i)(alma\.\w+)\s*=\s*(?!"[^"]*")(\S(?:[^"]*?\S)?)(?=\s+\b(?:AND|OR|NOT|PROX|SORTBY)\b|\s*$)'
#: Fixed value: digits of base 62, lowest first.
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

_GERSHAYIM = "״"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _right_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def has_hebrew(c: Column) -> Column:
    return F.coalesce(c.rlike(HEBREW), F.lit(False))


def strip_marc_punctuation(c: Column) -> Column:
    """Without the delimiter that ends a catalogue field, and without a final full stop unless it belongs
    to an ellipsis, an initial or an abbreviation.  Null gives the empty string."""
    text = _right_trimmed(F.regexp_replace(trimmed(blank_if_null(c)), FIELD_END, ""))
    last = F.regexp_extract(F.regexp_replace(text, r"\.$", ""), r"(?U)(\S+)\s*$", 1)
    stays = text.endswith("...") | last.rlike(r"^\p{Lu}$") | last.isin(*ABBREVIATIONS)
    return F.when(text.endswith(".") & ~stays, _right_trimmed(F.regexp_replace(text, r"\.$", ""))).otherwise(text)


def normalize_for_comparison(c: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    kept = F.lower(F.regexp_replace(blank_if_null(c), COMPARED_AWAY, ""))
    return trimmed(F.regexp_replace(kept, r"(?U)\s+", " "))


def normalize_heading(c: Column) -> Column:
    """Like ``normalize_for_comparison``, but inner white space stays as it is."""
    return F.lower(trimmed(F.regexp_replace(blank_if_null(c), COMPARED_AWAY, "")))


def clean_for_index(c: Column) -> Column:
    return trimmed(F.regexp_replace(blank_if_null(c), INDEXED_AWAY, " "))


def _latin_folds() -> tuple[str, str]:
    """Accented Latin letters in lower case and their base letters, from their decompositions."""
    pairs = {}
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and "a" <= parts[0] <= "z":
            pairs[char] = parts[0]
    return "".join(pairs), "".join(pairs.values())


_FOLD_FROM, _FOLD_TO = _latin_folds()


def tokens(c: Column) -> Column:
    """Words of letters and digits, in lower case, Latin accents dropped."""
    folded = F.translate(F.lower(blank_if_null(c)), _FOLD_FROM, _FOLD_TO)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def quote_cql_values(c: Column) -> Column:
    """Quote the unquoted values of ``alma.*`` indexes, up to the next boolean or the end."""
    return F.regexp_replace(c, UNQUOTED_VALUE, '$1 = "$2"')


def cql(template: str, **values: Column) -> Column:
    """``template`` with its ``{name}`` places filled; null if a value is null or empty."""
    parts, rest, needed = [], template, []
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        value = values.get(name, F.lit(None).cast("string")).cast("string")
        parts += [F.lit(before), value]
        needed.append(F.coalesce(value != "", F.lit(False)))
    whole = F.concat(*parts, F.lit(rest)) if parts else F.lit(template)
    for condition in needed:
        whole = F.when(condition, whole)
    return whole


def hebrew_words(c: Column) -> Column:
    """Words of more than two letters with Hebrew in them."""
    return F.filter(F.split(trimmed(blank_if_null(c)), r"(?U)\s+"), lambda w: (F.length(w) > 2) & w.rlike(HEBREW))


def keyword_query(title: Column) -> Column:
    """Hebrew words of a title, joined by AND; null with fewer than two."""
    words = hebrew_words(title)
    asked = F.transform(words, lambda w: F.concat(F.lit('cql.anywhere="'), w, F.lit('"')))
    return F.when(F.size(words) >= 2, F.array_join(asked, " AND "))


def author_queries(name: Column, romanized: Column) -> Column:
    """Queries for an author, the narrowest first, as an array."""
    name, romanized = blank_if_null(name), blank_if_null(romanized)
    hebrew, given, also = has_hebrew(name), name != "", romanized != ""

    def personal(x: Column) -> Column:
        return F.concat(F.lit('local.personalNames all "'), x, F.lit('"'))

    def broad(x: Column) -> Column:
        return F.concat(F.lit('cql.any all "'), x, F.lit('"'))

    words = hebrew_words(name)
    # Longest first; words of one length keep their order.
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("at"), w.alias("word"))))
    longest = F.transform(F.slice(ranked, 1, 3), lambda x: broad(x["word"]))
    return F.array_compact(
        F.array(
            F.when(given & hebrew, personal(name)),
            F.when(also, personal(romanized)),
            F.when(given & ~hebrew & ~also, personal(name)),
            F.when(given, broad(name)),
            F.when(hebrew & (F.size(words) >= 2), F.array_join(longest, " AND ")),
        )
    )


def year_of(c: Column) -> Column:
    """The first four digits of a date text, taken together, as a year; null if there are fewer."""
    digits = F.substring(F.regexp_replace(blank_if_null(c), "[^0-9]", ""), 1, 4)
    return F.when(F.length(digits) > 0, digits.try_cast("int"))


def date_display(c: Column) -> Column:
    """The date text, where no year can be read from it."""
    return F.when(year_of(c).isNull(), blank_if_null(c)).otherwise(F.lit(""))


def strict_int(c: Column) -> Column:
    return F.when(trimmed(c).rlike(r"^[+-]?[0-9]+$"), trimmed(c).try_cast("int"))


def shown_date(display: Column, year: Column) -> Column:
    """The display text, else the year, else nothing; year 0 counts as none."""
    return F.when(blank_if_null(display) != "", display).otherwise(F.when(year != 0, year.cast("string")).otherwise(F.lit("")))


def base62(n: Column) -> Column:
    """A number that isn't negative in base 62."""
    powers = F.array(*(F.lit(62**k) for k in range(10, -1, -1)))  # 62 ** 11 exceeds 64 bits
    whole = "decimal(20,0)"  # the remainder is taken off before dividing, and no digit is rounded
    digits = F.transform(powers, lambda p: F.substr(F.lit(BASE62), (((n - n % p).cast(whole) / p.cast(whole)).cast("long") % 62).cast("int") + 1, F.lit(1)))
    return F.when(n == 0, F.lit("0")).otherwise(F.regexp_replace(F.array_join(digits, ""), "^0+", ""))


def record_id(n: Column, prefix: str = "rec-") -> Column:
    return F.concat(F.lit(prefix), base62(n))


def direction(c: Column) -> Column:
    return F.when(has_hebrew(c), F.lit("rtl")).otherwise(F.lit("ltr"))


def is_isbn(c: Column) -> Column:
    """Ten digits, or thirteen that begin with 978 or 979 and whose check digit is right."""
    digit = lambda i: F.substr(c, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda s, i: s + digit(i) * F.when(i % 2 == 1, 1).otherwise(3))
    right = ((F.lit(10) - total % 10) % 10) == digit(F.lit(13))
    return F.coalesce(F.when(c.rlike("^97[89][0-9]{10}$"), right).otherwise(c.rlike("^[0-9]{10}$")), F.lit(False))


def cache_key(base_url: Column, params: Column) -> Column:
    """MD5 of the address and the parameters, a map, in order of their names."""
    ordered = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.md5(F.concat(base_url, F.lit("|"), F.array_join(ordered, "|")))


def query_string(params: Column) -> Column:
    pairs = F.transform(F.map_entries(params), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
    return F.array_join(pairs, "&")


def cover_url(kind: Column, value: Column, base_url: str = "https://covers.example.org/b") -> Column:
    return F.concat(F.lit(base_url + "/"), F.lower(kind), F.lit("/"), value, F.lit("-M.jpg"))


def slug(title_romanized: Column, title: Column) -> Column:
    """Letters, digits and underscores of any script, lower case, joined by hyphens; at most 255."""
    source = F.when(blank_if_null(title_romanized) != "", title_romanized).otherwise(blank_if_null(title))
    composed = F.coalesce(_nfkc(F.when(source.rlike(r"[^\x00-\x7F]"), source)), source)  # ASCII stays as it is
    kept = F.regexp_replace(F.lower(composed), r"(?U)[^\w\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), r"^[-_]+|[-_]+$", "")
    return F.substring(joined, 1, 255)


@F.pandas_udf(T.StringType())
def _nfkc(texts):
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def with_romanized(name: Column, romanized: Column, sep: str = " / ") -> Column:
    """``name / romanized``, or the name alone."""
    return F.when(blank_if_null(romanized) != "", F.concat(name, F.lit(sep), romanized)).otherwise(name)


def publisher_shown(name: Column, place: Column) -> Column:
    return F.when(blank_if_null(place) != "", F.concat(name, F.lit(" ("), place, F.lit(")"))).otherwise(name)


def volume_shown(series: Column, number: Column, held: Column) -> Column:
    missing = F.when(held, F.lit("")).otherwise(F.lit(" (not held)"))
    return F.concat(series, F.lit(" vol. "), number, missing)


def first_words(c: Column, count: int = 12) -> Column:
    words = F.split(trimmed(blank_if_null(c)), r"(?U)\s+")
    return F.when(F.size(words) > count, F.concat(F.array_join(F.slice(words, 1, count), " "), F.lit(" …"))).otherwise(F.array_join(words, " "))


def counted(n: Column, one: str, many: str) -> Column:
    """A number with its noun: "1 volume", "0 volumes"."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


#: Units of a relative time with their seconds, largest first.
UNITS = (("year", 31_536_000), ("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60))


def time_since(then: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit; "0 minutes" for less than one and for what is to come."""
    seconds = F.greatest(now.cast("timestamp").cast("long") - then.cast("timestamp").cast("long"), F.lit(0).cast("long"))
    shown = F.lit("0 minutes")
    for unit, size in reversed(UNITS):
        n = F.floor(seconds / size)
        shown = F.when(n >= 1, counted(n, unit, unit + "s")).otherwise(shown)
    return shown


def escaped(c: Column) -> Column:
    """With the signs that mean something in HTML as entities."""
    out = F.replace(blank_if_null(c), F.lit("&"), F.lit("&amp;"))
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def bidi_span(c: Column) -> Column:
    """The escaped text in an element that says its direction."""
    return F.concat(F.lit('<span dir="'), direction(c), F.lit('">'), escaped(c), F.lit("</span>"))


def repair_gershayim(c: Column) -> Column:
    """A double quote between Hebrew letters as the mark it stands for."""
    return F.regexp_replace(c, f'(?<={HEBREW})"(?={HEBREW})', _GERSHAYIM)


def any_contains(columns: Sequence[Column], asked: str) -> Column:
    """Whether one of the columns contains ``asked``, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(blank_if_null(c)), F.lit(asked.lower()))
    return found


def all_words_contained(columns: Sequence[Column], query: str) -> Column:
    """Whether each word of the query is contained in one of the columns."""
    found = F.lit(True)
    for word in query.split():
        found = found & any_contains(columns, word)
    return found
