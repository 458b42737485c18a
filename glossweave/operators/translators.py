"""Pluggable translators for the model stage.

A translator turns rows of requests (``items``, ``prompt``) into responses by adding
``raw`` (reply text, numbered like the request) and ``error`` (null when the call worked).

``ModelTranslator``   any Python function from prompts to replies, run in Arrow batches
``ResumingTranslator``  keeps the answers of another translator and never asks them again
``MemoryTranslator``  exact lookup of whole texts in a translation memory table
``GlossaryTranslator``  word-by-word lookup in a glossary table
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..session import saved
from .positions import anti_join_null_safe, join_null_safe

#: Prompts of a task whose model has ``workers``, in bytes, and answers that leave a task at a time.
TASK_BYTES, PIECE = 1 << 26, 1024


@dataclass(frozen=True)
class ModelTranslator:
    """Run ``fn(list of prompts) -> list of replies`` over the requests.

    ``workers`` spreads the requests over that many tasks, or over more of them if a task would get more
    than ``TASK_BYTES`` of prompts; ``in_flight`` is how many calls of a task run side by side; the
    result depends on neither.  A call that raises is repeated in halves, so
    that one bad request costs only few others a second call.  Requests without a prompt are not
    sent.  ``pause`` seconds are kept before each further call of a task.

    Besides ``raw`` and ``error`` a response has ``seconds``: the time of its calls, failed ones
    included, shared evenly by the prompts of a call.  Scans and writes are no part of it.
    """

    fn: Callable[[list[str]], list[str]]
    workers: int | None = None
    pause: float = 0.0
    calls_per_batch: int = 32
    in_flight: int = 1

    def respond(self, requests: DataFrame, keys: list[str]) -> DataFrame:
        if self.workers:
            size = requests.agg(F.sum(F.octet_length("prompt"))).first()[0] or 0
            requests = requests.repartition(max(self.workers, -(-size // TASK_BYTES)), *keys)
        fn, pause, step, width = self.fn, self.pause, self.calls_per_batch, max(1, self.in_flight)

        def ask(prompts: list[str], spent: float = 0.0) -> list[tuple]:
            start = time.perf_counter()
            try:
                replies, why = list(fn(prompts)), None
                if len(replies) != len(prompts):
                    raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            except Exception as e:  # noqa: BLE001 - a failing model must not end the job
                why = f"{type(e).__name__}: {e}"
            spent += (time.perf_counter() - start) / len(prompts)
            if why is None:
                return [(None if r is None else str(r), None, spent) for r in replies]
            half = len(prompts) // 2
            if half:
                return ask(prompts[:half], spent) + ask(prompts[half:], spent)
            return [(None, why, spent)]

        @F.pandas_udf("raw string, error string, seconds double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            # Calls run side by side and are settled in the order of their prompts.  Answers leave in pieces
            # as they are settled, so what is held is a piece, the calls and the prompts of their batches.
            calls, held = deque(), deque()

            def settle() -> None:
                call, owner, rows = calls.popleft()
                for row, answer in zip(rows, call.result()):
                    owner["answers"][row] = answer
                owner["open"] -= 1
                owner["ready"] = rows[-1] + 1

            def pieces() -> Iterator[pd.DataFrame]:
                while held:
                    owner = held[0]
                    start, n = owner["sent"], len(owner["answers"])
                    last = owner["asked"] and not owner["open"]
                    end = n if last else owner["ready"]
                    if not last and end - start < PIECE:
                        return
                    yield pd.DataFrame(owner["answers"][start:end], columns=["raw", "error", "seconds"])
                    owner["answers"][start:end] = [None] * (end - start)
                    owner["sent"] = end
                    if last:
                        held.popleft()

            with ThreadPoolExecutor(width) as pool:
                first = True
                for batch in batches:
                    answers = [(None, "no prompt", None)] * len(batch)
                    owner = {"answers": answers, "open": 0, "ready": 0, "sent": 0, "asked": False}
                    held.append(owner)
                    prompts = batch.reset_index(drop=True).dropna()
                    for start in range(0, len(prompts), step):
                        if len(calls) >= width:
                            settle()
                            yield from pieces()
                        if pause and not first:
                            time.sleep(pause)
                        first = False
                        part = prompts.iloc[start : start + step]
                        calls.append((pool.submit(ask, part.tolist()), owner, part.index.tolist()))
                        owner["open"] += 1
                    owner["asked"] = True
                    yield from pieces()
                while calls:
                    settle()
                    yield from pieces()

        # Only the prompt travels; a model is asked once, so the call must not be repeated.
        replied = requests.withColumn("_reply", run.asNondeterministic()("prompt"))
        return replied.withColumns({c: F.col("_reply")[c] for c in ("raw", "error", "seconds")}).drop("_reply")


@dataclass(frozen=True)
class ResumingTranslator:
    """Asks ``translator`` only what an earlier run with the same ``folder`` left without an answer.

    Answers are appended to the table ``folder/answers``, keyed by the keys of the request, its step
    and a digest of its prompt; failures are kept there too, but are asked again.  A request whose
    prompt has changed is a new one.  Requests are asked in ``rounds`` parts of their own write each, so
    a job that dies loses at most the answers of one part.
    """

    translator: object
    folder: str
    rounds: int = 1

    def respond(self, requests: DataFrame, keys: list[str]) -> DataFrame:
        path, run = f"{self.folder}/answers", uuid.uuid4().hex
        by = [*keys, "step", "digest"]
        asked = requests.withColumn("digest", F.sha2("prompt", 256))
        open_ = asked.filter(F.col("prompt").isNotNull())
        known = self._answers(open_, keys, path)
        if known is not None:
            open_ = anti_join_null_safe(open_, known.filter("error is null"), by)
        for part in range(self.rounds):
            mine = open_.filter(F.pmod(F.xxhash64("digest", *keys), F.lit(self.rounds)) == part)
            replied = self.translator.respond(mine, keys)
            spent = F.col("seconds") if "seconds" in replied.columns else F.lit(None).cast("double")
            new = replied.select(*by, "raw", "error", spent.alias("seconds"), F.lit(run).alias("run"))
            new.write.mode("append").parquet(path)
        # An answer of any run, else the failure of this one; of repeated answers always the same.
        found = self._answers(open_, keys, path).filter((F.col("run") == run) | F.col("error").isNull())
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "raw", "error", "seconds"))
        answers = found.groupBy(*by).agg(best.alias("_a"))
        error = F.when(F.col("prompt").isNull(), F.lit("no prompt")).otherwise(F.col("_a.error"))
        joined = join_null_safe(asked, answers, by, "left")
        return joined.withColumns({"raw": F.col("_a.raw"), "error": error, "seconds": F.col("_a.seconds")}).drop("_a", "digest")

    def _answers(self, requests: DataFrame, keys: list[str], path: str) -> DataFrame | None:
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.select(*keys).schema)
        schema = f"{own}, step string, digest string, raw string, error string, seconds double, run string"
        try:
            return requests.sparkSession.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def _numbered_reply(items: Column, text: Callable[[Column], Column]) -> Column:
    """Reply to a batch when its texts are translated one by one."""
    labelled = F.transform(items, lambda item, i: F.struct((i + 1).alias("n"), item.alias("item")))
    live = F.filter(labelled, lambda x: ~is_blank(x["item"]["text"]))
    return F.array_join(
        F.transform(live, lambda x: F.concat(x["n"].cast("string"), F.lit(". "), text(x["item"]))), "\n"
    )


def reply_with(requests: DataFrame, text: Callable[[Column], Column]) -> DataFrame:
    """Responses from a column function of the item text (no Python worker)."""
    return requests.withColumns(
        {
            "raw": _numbered_reply(F.col("items"), lambda item: text(item["text"])),
            "error": F.lit(None).cast("string"),
        }
    )


def memory_key(text: Column | str) -> Column:
    """Key of a translation memory: stripped, lower-cased text."""
    return F.lower(strip(text))


def build_memory(pairs: DataFrame, folder: str | None = None) -> DataFrame:
    """A lookup table with one target per key (the smallest, for a stable result).

    With a ``folder`` it is a written table that later joins read directly: a text that
    makes up much of the corpus is then split by Spark's skew join, which does not look
    through an aggregate.
    """
    entries = pairs.groupBy(memory_key("source").alias("key")).agg(F.min("target").alias("target"))
    return saved(entries, folder, "memory")


def translate_by_memory(rows: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    """Add ``translated``, null where the memory (see ``build_memory``) has no entry."""
    entries = memory.select(F.col("key").alias("_key"), F.col("target").alias("translated"))
    return rows.withColumn("_key", memory_key(text)).join(entries, "_key", "left").drop("_key")


def build_glossary(pairs: DataFrame, folder: str | None = None) -> DataFrame:
    """A glossary table with one target per word, written like a memory."""
    return saved(pairs.groupBy("source").agg(F.min("target").alias("target")), folder, "glossary")


def glossary_column(text: Column, pairs: dict[str, str]) -> Column:
    """Word-by-word replacement inside a projection; large glossaries are better tables."""
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    # Most words are in no glossary; a set tells that faster than a map, whose keys are tried one by one.
    target = lambda w: F.when(w.isin(*pairs), F.coalesce(F.try_element_at(lookup, w), w)).otherwise(w)
    return F.array_join(F.transform(F.split(text, " "), target), " ")


def translate_by_glossary(
    rows: DataFrame, glossary: DataFrame, keys: list[str], text: str = "text"
) -> DataFrame:
    """Word-by-word replacement by a glossary (see ``build_glossary``) of any size.

    Each distinct word of a text is looked up once; the answers come back as one small map
    per text.  Spark broadcasts the glossary only while it is under its own size limit.
    """
    entries = glossary.select(F.col("source").alias("_word"), F.col("target").alias("_to"))
    words = rows.select(*keys, F.explode(F.array_distinct(F.split(text, " "))).alias("_word"))
    hits = (
        words.join(entries, "_word")
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("_word", "_to"))).alias("_hits"))
    )
    swapped = F.array_join(
        F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(F.col("_hits"), w), w)), " "
    )
    return (
        rows.join(hits, keys, "left")
        .withColumn("translated", F.when(F.col("_hits").isNull(), F.col(text)).otherwise(swapped))
        .drop("_hits")
    )


@dataclass(frozen=True)
class MemoryTranslator:
    """Replies from a translation memory; texts without an entry keep their wording."""

    memory: DataFrame

    def respond(self, requests: DataFrame, keys: list[str]) -> DataFrame:
        return _respond_by_item(requests, keys, lambda rows: translate_by_memory(rows, self.memory))


@dataclass(frozen=True)
class GlossaryTranslator:
    """Replies by word lookup: a dict stays inside the row, a DataFrame is joined."""

    glossary: DataFrame | dict

    def respond(self, requests: DataFrame, keys: list[str]) -> DataFrame:
        if isinstance(self.glossary, dict):
            return reply_with(requests, lambda t: glossary_column(t, self.glossary))
        return _respond_by_words(requests, keys, self.glossary)


def _respond_by_words(requests: DataFrame, keys: list[str], glossary: DataFrame) -> DataFrame:
    """Word by word: the distinct words of a request are looked up, and their answers come back to it
    as one map.  Only words travel to the glossary; a request is shuffled once, to meet its map.
    """
    entries = glossary.select(F.col("source").alias("_word"), F.col("target").alias("_to"))
    every = F.array_distinct(F.flatten(F.transform("items", lambda item: F.split(item["text"], " "))))
    words = requests.select(*keys, F.explode_outer(every).alias("_word"))
    found = F.map_from_entries(F.collect_set(F.struct("_word", "_to")))
    hits = words.join(entries, "_word").groupBy(*keys).agg(found.alias("_hits"))
    swapped = lambda t: F.array_join(
        F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(F.col("_hits"), w), w)), " "
    )
    return reply_with(join_null_safe(requests, hits, keys, "left"), swapped).drop("_hits")


def _respond_by_item(
    requests: DataFrame, keys: list[str], translate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Translate the items of each batch as rows and put batch and numbered reply together.

    Items travel with their rows, so the requests are read once.  Prompts are not used and
    come back null.  A group is one batch, so gathering is bounded by the batch size.
    """
    others = [c for c in requests.columns if c not in (*keys, "items", "prompt")]
    rows = requests.select(*keys, *others, F.posexplode("items").alias("_n", "_item")).select(
        *keys, *others, "_n", "_item", F.col("_item.pos").alias("pos"), F.col("_item.text").alias("text")
    )
    reply = F.when(
        ~is_blank("text"), F.concat(F.col("_n") + 1, F.lit(". "), F.coalesce("translated", "text"))
    )
    lines = F.array_sort(F.collect_list(F.struct("_n", "_item", reply.alias("line"))))
    return (
        translate(rows)
        .groupBy(*keys)
        .agg(lines.alias("_lines"), *[F.any_value(c).alias(c) for c in others])
        .select(
            *keys,
            *others,
            F.transform("_lines", lambda x: x["_item"]).alias("items"),
            F.lit(None).cast("string").alias("prompt"),
            F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("raw"),
            F.lit(None).cast("string").alias("error"),
        )
    )
