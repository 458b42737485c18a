"""Model replies as column expressions: clean, parse into items, align with the inputs.

A cleaned line never holds a newline, so newline serves as the item separator: heads are
written after a newline, continuation lines after a space, and one split gives the items.
That keeps the parser linear in the reply and inside one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DROPPED_LINE_STARTS, LEAD_INS, METADATA_KEYWORDS, SPACE_CHARS, SPACE_CLASS
from .text import is_blank, strip

_LEAD_IN = "(?i)^(?:" + "|".join(LEAD_INS) + ")"
_ITEM_START = r"^\p{Nd}+\."
_ITEM_LABEL = _ITEM_START + SPACE_CLASS + "*"


def drop_lead_in(raw: Column) -> Column:
    """Strip, remove at most one known lead-in at the very start, strip again."""
    return strip(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), _LEAD_IN, ""))


def _without_lead_in(raw: Column) -> Column:
    """``drop_lead_in`` for a text whose lines are stripped anyway: trimming ends costs a pass over the text."""
    return F.regexp_replace(F.ltrim(F.coalesce(raw, F.lit("")), F.lit(SPACE_CHARS)), _LEAD_IN, "")


def _strip_line(line: Column) -> Column:
    """``strip`` of a short expression; most lines need no trimming at the end."""
    loose = F.contains(F.lit(SPACE_CHARS), F.right(line, F.lit(1)))
    return F.when(loose, strip(line)).otherwise(F.ltrim(line, F.lit(SPACE_CHARS)))


def _keep_line(line: Column) -> Column:
    def any_of(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, tests)

    dropped = any_of([F.startswith(line, F.lit(p)) for p in DROPPED_LINE_STARTS])
    # Every keyword holds "=", so most lines need no lower-casing.
    metadata = F.contains(line, F.lit("=")) & any_of(
        [F.contains(F.lower(line), F.lit(k)) for k in METADATA_KEYWORDS]
    )
    return (line != "") & ~dropped & ~metadata


def reply_lines(text: Column) -> Column:
    """Stripped lines without metadata, headings and empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), _strip_line), _keep_line)


def clean_reply(raw: Column) -> Column:
    return F.array_join(reply_lines(_without_lead_in(raw)), "\n")


def _mark(line: Column) -> Column:
    return F.when(
        F.rlike(line, F.lit(_ITEM_START)),
        F.concat(F.lit("\n"), F.regexp_replace(line, _ITEM_LABEL, "")),
    ).otherwise(F.concat(F.lit(" "), line))


def parse_items(raw: Column) -> Column:
    """Numbered items of a raw reply, in reply order; their labels are ignored.

    Text before the first number is lost, and so is an item without text on its first
    line, together with its continuation lines.
    """
    marked = F.array_join(F.transform(reply_lines(_without_lead_in(raw)), _mark), "")
    return F.filter(
        F.split(marked, "\n"), lambda p, i: (i > 0) & (p != "") & ~F.startswith(p, F.lit(" "))
    )


def align_items(items: Column, parsed: Column) -> Column:
    """Give the k-th parsed text to the k-th non-blank input of a batch.

    Blank inputs pass through; inputs without a reply keep their own text and are
    flagged; surplus replies are dropped.  The result is in the order of the batch.
    """
    live = F.filter(items, lambda i: ~is_blank(i["text"]))
    blank = F.filter(items, lambda i: is_blank(i["text"]))

    def row(item: Column, reply: Column) -> Column:
        return F.struct(
            item["pos"].alias("pos"),
            item["index"].alias("index"),
            item["text"].alias("source_text"),
            F.coalesce(reply, item["text"]).alias("text"),
            (~is_blank(item["text"]) & reply.isNull()).alias("is_fallback"),
        )

    # Zipping visits each side once; a lookup per item would parse the reply per item.
    answered = F.zip_with(live, F.slice(parsed, 1, F.size(live)), row)
    passed = F.transform(blank, lambda item: row(item, F.lit(None).cast("string")))
    return F.array_sort(F.concat(answered, passed))
