"""Chat formatting: one training example per assistant turn.

Every assistant turn becomes an example of its own: all preceding turns as context, then the
reply, whose text alone is trainable (``loss_start``, ``loss_end`` in code points).  Turns
after the last reply become a last example without a trainable part, so nothing is lost.

The template marks a turn by its role.  Marks inside a text are broken by a backslash and
backslashes are doubled, so ``unescaped`` gives every text back.

A conversation of up to ``TURNS`` turns is one group.  A longer one is numbered and cut into blocks of
``TURNS`` turns, and each block is a group of its own, with the turns before it: so the examples of a hot
conversation, whose size is its length times its replies, are made by as many tasks as it has blocks.
A task holds one conversation's text, never a partition, and gives examples out row by row.

``read_back`` takes its numbers from each example where it is; only replies are then put in order, by
conversation and example, however the examples are stored.

Turns are ordered by turn, role and text (nulls first); repeated rows are turns of their own.
A null text is empty, a null role is the role "", a null conversation id is a conversation.
Extra columns are left out.  An empty table gives no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import anti_join_null_safe, dense_position, join_null_safe
from .common import saved

START = "<s>"
#: Role: what opens and closes its turns.  Other roles are named in the mark.
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("[REPLY]", "</s>"),
}
OTHER = ("[ROLE:", "]", "[/ROLE]")
_CONTROL = re.compile(r"(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?REPLY\]|/?ROLE)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items())
    + r"|\[ROLE:(?P<name>(?:[^\\\]]|\\.)*)\](?P<other>.*?)\[/ROLE\]",
    re.DOTALL,
)
EXAMPLES = "conv_id long, example long, target_turn long, text string, loss_start long, loss_end long, last boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Turns of a block.
TURNS = 512
#: Characters of examples that leave a task at once.
BATCH_CHARS = 1 << 22


def escaped(text: str) -> str:
    """A text in which no mark occurs."""
    return _CONTROL.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its text starts and ends."""
    body = escaped(text)
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escaped(role).replace("]", "\\]") + OTHER[1], OTHER[2]
    return before + body + after, len(before), len(before) + len(body)


def parse(example: str) -> list[tuple[str, str]]:
    """Role and text of every turn of an example."""
    turns = []
    for m in _TURN.finditer(example):
        role = m.lastgroup
        turns.append((unescaped(m["name"]) if role == "other" else role, unescaped(m[role])))
    return turns


def conversation_examples(turns: list[tuple[str, str]], first: int = 0, whole: bool = True) -> Iterator[tuple]:
    """``(example, target turn, text, loss start, loss end, last)`` of the examples from turn ``first`` on.

    ``whole`` says that the conversation ends with these turns.
    """
    parts, chars, replies = [START], len(START), 0
    final = max((k for k, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    for k, (role, text) in enumerate(turns):
        marked, start, end = format_turn(role, text)
        at = chars
        parts.append(marked)
        chars += len(marked)
        if role == "assistant":
            if k >= first:
                parts = ["".join(parts)]
                yield replies, k, parts[0], at + start, at + end, whole and k == final == len(turns) - 1
            replies += 1
    if whole and final < len(turns) - 1:
        yield replies, None, "".join(parts), chars, chars, True


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(column[k].as_py() for column in batch.columns)


_EXAMPLE = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int64()), ("target_turn", pa.int64()), ("text", pa.string()),
     ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())]
)


def _expand(size: int):
    """Examples of blocks of ``size`` turns, given with all turns before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for conv, block, last, rows in _rows(batches):
            turns = [(row["role"] or "", row["text"] or "") for row in rows]
            for example in conversation_examples(turns, block * size, block == last):
                held.append((conv, *example))
                chars += len(example[2])
                if chars >= BATCH_CHARS:
                    yield _example_batch(held)
                    held, chars = [], 0
        if held:
            yield _example_batch(held)

    return run


def _example_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EXAMPLE)], schema=_EXAMPLE)


def expand_examples(conversations: DataFrame, size: int = TURNS) -> DataFrame:
    """Examples of all conversations, numbered inside each; ``last`` marks the one that holds all turns.

    ``size`` is the number of turns of a block.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > size)
    long = saved(sizes.select("conv_id", F.expr(f"(_n - 1) div {size}").alias("_last")), "long-conversations")
    zero = F.lit(0).cast("long")
    cut = anti_join_null_safe(turns, long, ["conv_id"]).withColumns({"_block": zero, "_last": zero})
    if not long.isEmpty():
        # Each turn goes to its own block and to all blocks after it.
        placed = dense_position(join_null_safe(turns, long, ["conv_id"], "inner"), ["conv_id"], "turn", ties=("role", "text"), block=size)
        own = F.expr(f"pos div {size}")
        cut = cut.unionByName(placed.withColumn("_block", F.explode(F.sequence(own, F.col("_last")))).drop("pos"))
    # A struct's nulls come first, as in a sort by its columns.
    inside = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    blocks = cut.groupBy("conv_id", "_block", "_last").agg(inside.alias("turns"))
    return blocks.mapInArrow(_expand(size), EXAMPLES)


READ_ONE = "conv_id long, example long, reply string, chars long, n_turns long, turns_sha256 string"


def _read_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reply and length of each example; of a conversation's last one also the digest of its turns."""
    names = [x.split()[0] for x in READ_ONE.split(", ")]
    for batch in batches:
        out = []
        for conv, example, text, start, end, last in _rows([batch]):
            n, digest = None, hashlib.sha256()
            if last:
                turns = parse(text)
                n = len(turns)
                for role, own in turns:
                    digest.update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
            out.append((conv, example, unescaped(text[start:end]), len(text), n, digest.hexdigest() if last else None))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    out = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*out))], names=names
        )

    for conv, rows in groupby(_rows(batches), itemgetter(0)):
        loss, loss_chars, total, turns, digest = hashlib.sha256(), 0, 0, None, None
        for _, _, reply, chars, n, own in rows:
            loss.update(reply.encode("utf-8", "surrogatepass"))
            loss_chars += len(reply)
            total += chars
            if n is not None:
                turns, digest = n, own
        out.append((conv, turns, digest, loss_chars, loss.hexdigest(), total))
        if len(out) >= 4096:
            yield flush()
            out = []
    if out:
        yield flush()


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold, in whatever order they come.

    Only replies and numbers are shuffled; a digest of a conversation is one stream through its replies.
    """
    parts = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = examples.select("conv_id", "example", "text", "loss_start", "loss_end", "last").mapInArrow(_read_one, READ_ONE)
    return one.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_read, READ)
