"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the lengths of frequent pre-tokens, broadcast to every worker; its size
is bounded by ``FREQUENT`` keys of at most ``LONGEST_CACHED`` characters.  Tier two is a cache in each
worker, which encodes what the table lacks with the tokenizer library.  Texts are read once and
nothing is shuffled.  The keys come from ``SAMPLE`` texts, of which the first ``SAMPLE_CHARS`` characters are
looked at; the choice of keys decides only the speed, never a count.

Null and empty texts have no bytes and no tokens.  Rows are kept as they are (repeated rows,
null ids, extra columns); a column with the name of the result is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import LONGEST_CACHED, checked_model, default_model, library_lengths, pre_tokens

FREQUENT = 65_536
#: Texts that the frequent pre-tokens are taken from, and characters of each.
SAMPLE, SAMPLE_CHARS = 4_096, 16_384
#: Entries of a worker's cache before it starts anew.
CACHED = 300_000


def frequent_lengths(docs: DataFrame, model: str, text: str = "text") -> dict[str, int]:
    """Lengths of at most ``FREQUENT`` frequent pre-tokens of a bounded sample of the texts."""
    counts: Counter[str] = Counter()
    # A limit reads only as many parts of the table as it takes.
    for row in docs.select(F.substring(F.col(text).cast("string"), 1, SAMPLE_CHARS)).limit(SAMPLE).collect():
        counts.update(k for k in pre_tokens(row[0]) if len(k) <= LONGEST_CACHED)
    keys = [k for k, _ in counts.most_common(FREQUENT)]
    return dict(zip(keys, library_lengths(model, keys))) if keys else {}


def count_tokens(
    docs: DataFrame,
    model: str | None = None,
    text: str = "text",
    column: str = "n_tokens",
) -> DataFrame:
    """``docs`` with the number of tokens of each whole text."""
    path = checked_model(model or default_model())
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frequent, cache = table.value, {}
        for batch in batches:
            cut = [pre_tokens(x) for x in batch]
            misses = {k for doc in cut for k in doc if k not in frequent and k not in cache}
            if len(cache) + len(misses) > CACHED:
                cache = {}
                misses = {k for doc in cut for k in doc if k not in frequent}
            # Long ones are encoded where they stand, the others once per worker.
            short = [k for k in misses if len(k) <= LONGEST_CACHED]
            cache.update(zip(short, library_lengths(path, short) if short else ()))
            counts = []
            for doc in cut:
                n = 0
                for k in doc:
                    found = frequent.get(k)
                    if found is None:
                        found = cache.get(k)
                    n += library_lengths(path, [k])[0] if found is None else found
                counts.append(n)
            yield pd.Series(counts, dtype="int64")

    return docs.withColumn(column, tokens(F.col(text)))
