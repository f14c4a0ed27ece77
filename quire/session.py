"""Sessions, shared folders, and getting this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine is written for; all may be set otherwise by the caller.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(master: str | None = None, app: str = "quire", **settings: str) -> SparkSession:
    """A session with DEFAULTS and then ``settings`` (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's source (some 100 KB) to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quire-source-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "quire-source.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._quire_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of this machine stands in only where the session names none and runs in one JVM.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quire-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    found = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of the tables that each open scratch() has to remove.
_scratches: list[list[str]] = []


def app_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes at the end of the application."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/quire/{context.applicationId}"
    if not getattr(context, "_quire_tidied", False):
        context._quire_tidied = True
        atexit.register(_remove_quietly, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the gateway may have gone before; then the folder is left to the cluster
        _remove(spark, path)


def settle(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._quire_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_quire_path", None)
        if path:
            _remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables settled inside are removed at its end, but for those put into the list that it gives."""
    kept: list[DataFrame] = []
    _scratches.append([])
    try:
        yield kept
    finally:
        stay = {getattr(df, "_quire_path", None) for df in kept}
        for path in _scratches.pop():
            if path not in stay:
                _remove_quietly(spark, path)
            elif _scratches:
                _scratches[-1].append(path)
