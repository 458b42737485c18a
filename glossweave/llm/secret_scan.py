"""Secrets told apart from examples by how many owners hold them.

Three base patterns are matched in every whole text.  Positions come from the text between
the matches: ``split`` and ``regexp_extract_all`` walk the same matches, so the lengths of the
pieces and of the matches, summed in turn, give every start and end in code points.

Beyond the base, a wider pattern yields candidates (long mixed tokens that no base span
covers).  Every candidate and base value is hashed, and the hashes are counted over the
corpus: how many distinct repositories and owners hold them.  A value that many owners or many
repositories hold is an example that was copied; one that few of both hold and that looks random
is live-looking.  Candidates that are live-looking are added to the spans as kind ``token``; base spans always stay.

Main path: DataFrame functions only.  The hash is the only thing that is shuffled; counts
are combined before the shuffle, so a value in a third of all rows is one row per task.
Null texts are empty.  All null owners count as one, that of the empty name, and so do all null
repositories.  Repeated rows are kept, with the same result.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A match of fewer characters would be dropped, and drops nothing else: runs are maximal.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Wider candidates; looked at only where the text has such a run.
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "token")
LEAST_VALUE = 8
#: A value of more owners than this is a copied example.
MOST_OWNERS = 2
#: So is a value of more repositories than this, whoever owns them.
MOST_REPOSITORIES = 10
#: Characters of a live-looking value that differ, at least.
LEAST_VARIETY = 8


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Elements of an array that a scan goes through before it appends what it found.
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def _scan(array: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Spans that ``step`` gives while a state is carried along ``array``.

    ``step(state, x)`` is the next state and an array of the spans found at ``x``.  Appending to an array
    copies it, so spans are gathered in blocks, and blocks in the whole: time near the array's length.
    """
    none = F.array().cast(SPANS)

    def one(acc: Column, x: Column) -> Column:
        state, found = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], found).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        begin = F.struct(F.element_at(acc, -1)["state"].alias("state"), none.alias("out"))
        return F.concat(acc, F.array(F.aggregate(xs, begin, one)))

    def whole(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(xs, at, BLOCK))
        return F.aggregate(blocks, F.array(F.struct(first.alias("state"), none.alias("out"))), block, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))

    return _let(array, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def _spans(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """Array of (start, kind, end, value) of all matches, in order; offsets in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    between = F.split(text, pattern, -1)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["between"])
        end = begin + F.length(x["match"])
        span = F.struct(
            begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value")
        )
        return end, F.array(span)

    zipped = F.zip_with(
        F.arrays_zip(found.alias("match"), values.alias("value")),
        F.slice(between, 1, F.size(found)),
        lambda m, b: F.struct(b.alias("between"), m["match"].alias("match"), m["value"].alias("value")),
    )
    return F.when(F.rlike(text, F.lit(pattern)), _scan(zipped, F.lit(0), step)).otherwise(F.array().cast(SPANS))


def _untouched(wide: Column, base: Column) -> Column:
    """Spans of ``wide`` that no span of ``base`` overlaps.

    Base spans come at their start and wide ones at their end, sorted: a wide span is touched if a base
    span that came before it ends behind its start.
    """
    event = lambda key, is_base: lambda s: F.struct(s[key].alias("at"), F.lit(is_base).alias("base"), s.alias("span"))
    events = F.array_sort(F.concat(F.transform(base, event("start", 1)), F.transform(wide, event("end", 0))))

    def step(reached: Column, x: Column) -> tuple[Column, Column]:
        free = (x["base"] == 0) & (reached <= x["span"]["start"])
        return (
            F.when(x["base"] == 1, F.greatest(reached, x["span"]["end"])).otherwise(reached),
            F.when(free, F.array(x["span"])).otherwise(F.array().cast(SPANS)),
        )

    return F.array_sort(_scan(events, F.lit(0), step))


def _live(wide: Column, verdicts: Column) -> Column:
    """Spans of ``wide`` whose value has a live verdict: both sorted by hash, verdicts first."""
    nothing = F.lit(None).cast("struct<start:int,kind:int,end:int,value:string>")
    live = F.transform(F.filter(verdicts, lambda v: v["live"]), lambda v: F.struct(v["hash"].alias("hash"), nothing.alias("span")))
    own = F.transform(wide, lambda s: F.struct(F.xxhash64(s["value"]).alias("hash"), s.alias("span")))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        span = x["span"]
        found = span.isNotNull() & last.eqNullSafe(x["hash"])
        return F.when(span.isNull(), x["hash"]).otherwise(last), F.when(found, F.array(span)).otherwise(F.array().cast(SPANS))

    # sort_array puts the null span of a verdict before the spans of its hash.
    return _scan(F.sort_array(F.concat(live, own)), F.lit(None).cast("bigint"), step)


def _random_looking(value: Column) -> Column:
    """Letters and digits mixed and many different characters."""
    variety = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (variety >= LEAST_VARIETY)


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, by start and then kind."""
    assign = F.filter(_spans(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def find_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str | None = None,
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` spans, all ``spans`` and the verdicts.

    ``verdicts`` lists for each distinct value hash of the row its owners, its repositories and
    whether it is live-looking.  Without a ``repository`` column every id is a repository.
    """
    spans = saved(
        docs.select(
            F.col(id_column).alias("_id"),
            F.coalesce(F.col(owner), F.lit("")).alias("_owner"),
            F.col(repository or id_column).cast("string").alias("_repository"),
            F.coalesce(F.col(text), F.lit("")).alias("_text"),
        )
        .withColumns({"base": base_spans(F.col("_text")), "wide": _spans(F.col("_text"), TOKEN, "token")})
        .drop("_text")
        # Of the wider candidates, those that no base span touches.
        .withColumn("wide", _untouched(F.filter("wide", lambda w: _random_looking(w["value"])), F.col("base"))),
        "secret-spans",
    )
    hashed = lambda s: F.xxhash64(s["value"])
    # The row's own key, 128 bits of its values: rows that agree in it have the same verdicts.
    keyed = spans.withColumn("_values", F.array_sort(F.array_distinct(F.transform(F.concat("base", "wide"), hashed))))
    keyed = keyed.withColumn("_key", F.struct(F.xxhash64("_values").alias("h1"), F.xxhash64(F.lit(1), "_values").alias("h2")))
    held = keyed.filter(F.size("_values") > 0)
    one = held.select(
        "_owner",
        "_repository",
        F.explode(
            F.transform(
                F.concat("base", "wide"),
                lambda s: F.struct(hashed(s).alias("hash"), _random_looking(s["value"]).alias("random")),
            )
        ).alias("v"),
    )
    owners = one.groupBy("v.hash").agg(
        F.count_distinct("_owner").alias("owners"),
        F.count_distinct(F.coalesce("_repository", F.lit(""))).alias("repositories"),
        F.max("v.random").alias("random"),
    )
    judged = owners.select(
        "hash",
        F.struct(
            "hash",
            "owners",
            "repositories",
            (
                F.col("random")
                & (F.col("owners") <= most_owners)
                & (F.col("repositories") <= most_repositories)
            ).alias("live"),
        ).alias("verdict"),
    )
    sets = held.select("_key", F.explode("_values").alias("hash")).distinct()
    # Written, so that the skew join can split values that very many rows hold.
    verdicts = saved(
        sets.join(judged, "hash")
        .groupBy("_key")
        .agg(F.sort_array(F.collect_list("verdict")).alias("verdicts")),
        "verdicts",
    )
    none = F.array().cast("array<struct<hash:bigint,owners:bigint,repositories:bigint,live:boolean>>")
    # Most rows have no values; they would all meet at one join key, so they stay out of it.
    rows = held.join(verdicts, "_key").unionByName(
        keyed.filter(F.size("_values") == 0).withColumn("verdicts", none)
    )
    return (
        rows.withColumn("spans", F.array_sort(F.concat("base", _live(F.col("wide"), F.col("verdicts")))))
        .select(F.col("_id").alias(id_column), "base", "spans", "verdicts")
    )
