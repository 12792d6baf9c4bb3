"""DuckDB expressions for the scalar text functions, in a regular-expression dialect without lookaround."""

from __future__ import annotations

from quirespark.functions.text import ABBREVIATIONS


def strip_marc(x: str) -> str:
    text = f"rtrim(regexp_replace(trim(coalesce({x}, '')), '\\s+[;:/]$|,$', ''))"
    words = "|".join(ABBREVIATIONS)
    stays = f"({text} LIKE '%...' OR regexp_matches({text}, '(^|\\s)(\\p{{Lu}}|{words})\\s*\\.$'))"
    return f"CASE WHEN {text} LIKE '%.' AND NOT {stays} THEN rtrim({text}[:-2]) ELSE {text} END"


_MARKS = "[\"\\-,.:;/\\\\''()|\u05f3\u05f4]"


def normalized(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '{_MARKS}', '', 'g')), '\\s+', ' ', 'g'))"


def heading(x: str) -> str:
    return f"trim(lower(regexp_replace(coalesce({x}, ''), '{_MARKS}', '', 'g')))"


def cleaned(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[,;:!?@#$%^&*()\\[\\]{{}}<>=/\\\\|~`]', ' ', 'g'))"


def terms(x: str) -> str:
    """Without folding: for text whose letters with accents don't matter to a query."""
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def bm25(measured: str, frequencies: list[str], id_col: str, limit: int) -> str:
    """Rank of ``measured`` (id, length and the named frequencies)."""
    score = " + ".join(
        f"greatest(ln((documents - n_{f} + 0.5) / (n_{f} + 0.5)), 1e-6) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * length / average))" for f in frequencies
    )
    containing = ", ".join(f"count(*) FILTER ({f} > 0) AS n_{f}" for f in frequencies)
    found = " AND ".join(f"{f} > 0" for f in frequencies)
    return f"""
      WITH measured AS ({measured}),
      totals AS (SELECT count(*) AS documents, avg(length) AS average, {containing} FROM measured)
      SELECT {id_col}, round(-({score}), 6) AS rank FROM measured, totals WHERE {found} ORDER BY -({score}), {id_col} LIMIT {limit}"""
