"""Queries that run a stream to its end and return what it wrote, and the same in SQL over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.books import SQL as _BOOKS
from quire.session import discard, settle, shared_dir
from quire.sources.views import job_events, table
from quire.streaming import progress


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    at = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    progress.run_all(stream, f"{at}/out", f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _stream(spark: SparkSession, rows: DataFrame, name: str, parts: int = 3) -> DataFrame:
    """rows (job, seq, ...) as a stream of ``parts`` triggers or a few more, in the order of seq.

    A stream takes files in the order of their time, so slices of seq are written one after the other, each by many tasks.
    A job's rows of a slice are in one file: wherever a trigger ends, those of a job come in order.
    """
    at = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    rows = settle(rows, name)  # numbered once
    step = (rows.agg(F.max("seq")).first()[0] or 0) // parts + 1
    for i in range(parts):
        rows.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)).repartition("job").write.mode("append").parquet(at)
    files = len(spark.read.schema(rows.schema).parquet(at).inputFiles())
    discard(rows)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // parts))).parquet(at)


def streamed_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = job_events(table(spark, d, "events")).select("job", F.col("seq").cast("long").alias("seq"), "stage_idx", "pct")
    return _drained(spark, progress.running_progress(_stream(spark, rows, "messages")), "progress").select("job", F.col("seq").cast("int").alias("seq"), "overall")


QUERIES = {f.__name__: f for f in (streamed_progress,)}
SQL = {"streamed_progress": _BOOKS["job_progress"].replace("SELECT job, seq, stage, max(", "SELECT job, seq, max(")}
