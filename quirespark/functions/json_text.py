"""JSON from recognised text: tolerant parsing, candidate lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_if_null, repair_gershayim, trimmed

#: What is read from a title page.
TITLE_PAGE = "title string, subtitle string, publisher string, place string, date string, title_romanized string, author string, author_romanized string"
#: Marks of a code block at the beginning and at the end.
FENCE_BEFORE, FENCE_AFTER = r"^```\w*\n?", r"\n?```$"


def unfenced(c: Column) -> Column:
    """Without the marks of a code block around it."""
    text = trimmed(blank_if_null(c))
    inner = F.regexp_replace(F.regexp_replace(text, FENCE_BEFORE, ""), FENCE_AFTER, "")
    return F.when(text.startswith("```"), inner).otherwise(text)


def tolerant_json(c: Column) -> Column:
    """The text of a JSON value, unfenced and, if need be, with quotes between Hebrew letters repaired;
    null if it can't be parsed even so."""
    plain = unfenced(c)
    repaired = repair_gershayim(plain)
    return F.coalesce(F.when(F.try_parse_json(plain).isNotNull(), plain), F.when(F.try_parse_json(repaired).isNotNull(), repaired))


def title_page(c: Column) -> Column:
    """A struct of the fields of a title page; null if the text can't be parsed."""
    text = tolerant_json(c)
    return F.when(text.isNotNull(), F.from_json(text, TITLE_PAGE))


def candidate_at(candidates: Column, index: Column) -> Column:
    """The candidate at an index from 0; null beyond the list or below 0."""
    return F.when(index >= 0, F.get(candidates, index))
