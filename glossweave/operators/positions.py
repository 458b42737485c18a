"""Dense positions and ordered heads of long-form rows, without one task per group.

``row_number`` over a whole document would put the largest document into one task.  Here
rows are numbered inside fixed blocks of the order column, and block offsets come from
running sums over one row per block, taken inside blocks of blocks.  A block holds at most
``BLOCK`` order values or blocks; with 64-bit order columns, however sparse, a group has at most
2**48 blocks, so ``LEVELS`` levels of blocks keep every running sum to ``BLOCK`` rows.  The counts
of blocks are a written table, so the levels do not read the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 65536
LEVELS = 2
SALTS = 64


def block_of(order: Column | str, block: int = BLOCK) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / block).cast("bigint")


def dense_position(
    rows: DataFrame,
    keys: list[str],
    order: str,
    name: str = "pos",
    ties: tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by ``order, *ties``.

    Two passes: the first reads keys and order only and writes the offsets of the blocks, of which
    only those of groups with several blocks are kept; the second numbers the rows in their blocks.
    Rows are shuffled once.  Nulls in keys are a group like others.
    """
    tagged = rows.withColumn("_block", block_of(order, block))
    offsets = block_offsets(tagged, keys, _levels(rows, order))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order, *ties)) - 1
    numbered = tagged.withColumn(name, inside.cast("bigint"))
    if offsets.isEmpty():
        return numbered.drop("_block")
    return (
        join_null_safe(numbered, offsets, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_offset", F.lit(0)) + F.col(name))
        .drop("_block", "_offset")
    )


def _levels(rows: DataFrame, order: str) -> int:
    """32-bit orders have so few blocks that one running sum over them will do."""
    return 0 if rows.schema[order].dataType.typeName() in ("integer", "short", "byte") else LEVELS


def block_offsets(tagged: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """``(*keys, _block, _offset)``: rows of a group before each block, where there are any.  Written."""
    counts = written(tagged.groupBy(*keys, "_block").agg(F.count("*").alias("_n")), "blocks")
    return written(_offsets(counts, keys, levels).filter("_offset > 0"), "offsets")


def _offsets(counts: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Rows of a group before each block; windows hold the blocks of one block of blocks."""
    outer = [*keys, "_outer"] if levels else keys
    before = Window.partitionBy(*outer).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (counts.withColumn("_outer", block_of("_block")) if levels else counts).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    if not levels:
        return placed.select(*keys, "_block", "_offset")
    sums = placed.groupBy(*outer).agg(F.sum("_n").alias("_n")).withColumnRenamed("_outer", "_block")
    above = _offsets(sums, keys, levels - 1).withColumnsRenamed({"_block": "_outer", "_offset": "_above"})
    return join_null_safe(placed, above, outer, "inner").select(
        *keys, "_block", (F.col("_offset") + F.col("_above")).alias("_offset")
    )


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join in which null meets null; the columns of ``on`` are those of ``left``."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [left[c].eqNullSafe(other[f"_r_{c}"]) for c in on]
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in on])


def anti_join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose values of ``on`` are not in ``right``; null meets null."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in on])
    return left.join(other, [left[c].eqNullSafe(other[f"_r_{c}"]) for c in on], "left_anti")


def head(
    rows: DataFrame, keys: list[str], order: str | list[str], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per group, for any ``n``.

    Spark keeps the first ``n`` rows that a task has of a group before they are shuffled.  For an
    ``n`` beyond its limit for that, rows are ranked in ``SALTS`` parts of their group first.  So no
    task sorts a whole group.
    """
    order = [order] if isinstance(order, str) else order
    parts = [keys]
    if n > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        parts.insert(0, [*keys, "_salt"])
    for part in parts:
        ranked = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        rows = rows.withColumn("_rank", ranked).filter(F.col("_rank") <= n)
    kept = rows.drop("_salt")
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    order: str,
    last: str,
    how: str = "left",
    block: int = BLOCK,
) -> DataFrame:
    """Join many rows per key with one row per key, splitting the keys that have many rows.

    ``per_key`` carries the highest ``order`` value of its key in ``last``; it is repeated
    once per block of that key, which is once for all but the largest keys.
    """
    copies = per_key.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(last, block)))
    )
    tagged = rows.withColumn("_block", block_of(order, block))
    return tagged.join(copies, [*keys, "_block"], how).drop("_block")
