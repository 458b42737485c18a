"""Column helpers for whole texts: stripping, blank tests, previews, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import LINE_BREAK, SPACE_CHARS, SPACE_CLASS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Unicode strip.  Spark's plain ``trim`` only removes U+0020."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and whitespace-only text; stops at the first other character."""
    return F.coalesce(F.ltrim(_col(c), F.lit(SPACE_CHARS)), F.lit("")) == ""


def squeeze_spaces(c: Column | str) -> Column:
    """Every run of Unicode whitespace becomes one space; ends are stripped.

    Single spaces, the common case, are not matched.
    """
    run = SPACE_CLASS + "{2,}|[" + SPACE_CLASS + "&&[^ ]]"
    return F.btrim(F.regexp_replace(_col(c), run, " "))


def drop_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), SPACE_CLASS + "+", "")


def lines(c: Column | str) -> Column:
    """Split on newline only, keeping empty lines (paragraph boundaries)."""
    return F.split(F.coalesce(_col(c), F.lit("")), "\n")


def universal_lines(c: Column | str) -> Column:
    """Split on every Unicode line boundary (reference files)."""
    return F.split(F.coalesce(_col(c), F.lit("")), LINE_BREAK)


def preview(c: Column | str, width: int, mark: str) -> Column:
    c = _col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit(mark))).otherwise(c)


def round2(c: Column) -> Column:
    return F.round(c, 2)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` as whole per cent text, e.g. ``20%``."""
    return F.concat(F.round(part / whole * 100, 0).cast("bigint").cast("string"), F.lit("%"))
