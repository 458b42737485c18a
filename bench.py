"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The given tables are files of one row group, which one task reads whatever the query does.  Before anything
is timed, the larger ones are dealt out over as many files as there are cores, as a table on a cluster is;
``BENCH_DEAL=0`` leaves them as they are.

Each query runs once on the smallest data to load and compile it, then up to three times timed
(the median counts), written to Spark's no-op sink so that every column of every row is produced.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES, flagship  # noqa: E402
from glossweave.session import build_session  # noqa: E402

RUNS = 3
#: A query is not repeated after this many seconds.
ENOUGH_S = 12
HEADLINE = [
    "s1_paragraphs",
    "s6_document_counts",
    "o3_batches",
    "o3_batches_of_rows",
    "m2_translation_request",
    "m5_model_run",
    "m5_memory_run",
    "m5_glossary_table_run",
    "m7_parse_items",
    "j2_align",
    "j4_index_merge",
    "m8_table_translation",
    "k1_translated_documents",
    "k2_written_runs",
    "a2_segment_bleu",
    "a3_corpus_bleu",
    "a5_segment_chrf",
    "a6_corpus_chrf",
    "a10_compare_systems",
    "flagship",
]


def dealt_out(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in which those over a megabyte are several files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        if table.is_file() and table.stat().st_size > 1 << 20:
            spark.read.parquet(str(table)).repartition(files).write.parquet(f"{folder}/{table.name}")
        else:
            (shutil.copy if table.is_file() else shutil.copytree)(table, f"{folder}/{table.name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": int(cpus) * 8,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = str(Path(sf_dir).parent / "sf0.001")
    available = {**QUERIES, "flagship": flagship}
    only = sys.argv[1:]
    tables = sf_dir if os.environ.get("BENCH_DEAL") == "0" else dealt_out(spark, sf_dir, int(cpus))
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        run = available[name]
        if Path(small).exists():
            run(spark, small).write.format("noop").mode("overwrite").save()
        runs = []
        while len(runs) < RUNS and sum(runs) < ENOUGH_S:
            start = time.perf_counter()
            run(spark, tables).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
