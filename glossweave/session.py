"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(app: str = "glossweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans rely on; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def saved(frame: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Write a stage's output and read it back, so that a retry or a second use does not
    repeat the stage.  Without a folder the frame stays lazy."""
    if folder is None:
        return frame
    path = f"{folder}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="glossweave-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of a name not used before in the shared folder; ``drop_intermediates`` deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; cuts the lineage."""
    return saved(frame, new_folder(frame.sparkSession, name), "table")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete what this application left in the shared folder; frames that read it end with it."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside on the way out; what is written elsewhere stays."""
    own = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    try:
        yield
    finally:
        _delete(spark, own[before:])
        del own[before:]
