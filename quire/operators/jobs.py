"""Jobs and their progress, over tables of messages. The streaming forms are in quire.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scoring import rounded

from quire.sources.views import STAGES, WEIGHTS

# ---- fixed values: parts of a log line, the stage that they tell of, its detail and how far it is
LOG_RULES = [
    (["analyzing"], "analyze", None, 0.05), (["route:"], "analyze", None, 1.0), (["rendering + cleaning"], "clean", None, 0.05), (["pages prepared"], "clean", None, 1.0),
    (["azure di chunk"], "ocr", "chunk", None), (["tesseract (", "ocr ("], "ocr", "Offline OCR", 0.85), (["mean confidence"], "ocr", None, 1.0), (["engine scores"], "ocr", "Comparing engines", 0.95),
    (["-> &blocks"], "extract", None, 1.0), (["converting to azw3"], "typography", None, 1.0), (["also built", "also building", "fixed-layout"], "build", "Extra editions", 0.6), (["optimized pdf"], "build", "Kindle PDF", 0.85),
    (["running qa"], "qa", None, 0.3), (["qa gate"], "qa", None, 0.9), (["done in"], "qa", None, 1.0),
]
ERRORS = {"Cancelled": "CANCELLED", "FileNotFoundError": "FILE_NOT_FOUND", "JSONDecodeError": "BAD_REQUEST", "UnknownMethod": "UNKNOWN_METHOD", "InvalidSettings": "INVALID_SETTINGS"}
# ----


def classify_log(line: Column) -> Column:
    """struct(stage, detail, pct) of a log line; nulls if it tells of no stage."""
    low = F.lower(line)
    i = F.regexp_extract(line, r"chunk (\d+)/(\d+)", 1).try_cast("int")
    n = F.regexp_extract(line, r"chunk (\d+)/(\d+)", 2).try_cast("int")
    stage, detail, pct = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for marks, s, d, p in reversed(LOG_RULES):
        hit = F.lit(False)
        for m in marks:
            each = F.lit(True)
            for part in m.split("&"):
                each = each & low.contains(part)
            hit = hit | each
        chunk = d == "chunk"
        told = F.coalesce(F.concat(F.lit("Azure AI · chunk "), i.cast("string"), F.lit(" of "), n.cast("string")), F.lit("Azure AI")) if chunk else F.lit(d).cast("string")
        far = F.coalesce(i / F.greatest(n, F.lit(1)) * 0.8, F.lit(0.1)) if chunk else F.lit(p).cast("double")
        stage, detail, pct = F.when(hit, s).otherwise(stage), F.when(hit, told).otherwise(detail), F.when(hit, far).otherwise(pct)
    return F.struct(stage.alias("stage"), detail.alias("detail"), pct.alias("pct"))


def overall(stage_idx: Column, pct: Column) -> Column:
    """How far a job is: the weights of earlier stages and this one's share; 0 for an unknown stage."""
    known = stage_idx.between(0, len(STAGES) - 1)
    at = F.when(known, stage_idx + 1).otherwise(1)
    starts = [round(sum(WEIGHTS[:i]), 10) for i in range(len(WEIGHTS))]  # 0.82, not 0.8200000000000001: ties of the rounding depend on it
    before, weight = (F.element_at(F.array(*map(F.lit, x)), at) for x in (starts, WEIGHTS))
    return F.when(known, rounded(F.least(F.lit(1.0), before + weight * pct), 4)).otherwise(F.lit(0.0))


def progress(messages: DataFrame) -> DataFrame:
    """messages (job, seq, stage_idx, pct) with overall, which never falls within a job."""
    so_far = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("overall", F.max(overall(F.col("stage_idx"), F.col("pct"))).over(so_far))


def transitions(messages: DataFrame) -> DataFrame:
    """(job, seq, sub, stage, status): at a change of stage done for the one before, then running; the last stage is closed."""
    w = Window.partitionBy("job").orderBy("seq")
    r = messages.select("job", "seq", "stage", F.lag("stage").over(w).alias("prev"), F.lead("seq").over(w).alias("next"))
    none = F.lit(None).cast("struct<sub:int,stage:string,status:string>")
    done = F.when(F.col("prev").isNotNull() & (F.col("prev") != F.col("stage")), F.struct(F.lit(0).alias("sub"), F.col("prev").alias("stage"), F.lit("done").alias("status"))).otherwise(none)
    running = F.struct(F.lit(1).alias("sub"), F.col("stage").alias("stage"), F.lit("running").alias("status"))
    closed = F.when(F.col("next").isNull(), F.struct(F.lit(2).alias("sub"), F.col("stage").alias("stage"), F.lit("done").alias("status"))).otherwise(none)
    return r.select("job", "seq", F.explode(F.array_compact(F.array(done, running, closed))).alias("e")).select("job", "seq", "e.sub", "e.stage", "e.status")


def queue_times(jobs: DataFrame) -> DataFrame:
    """jobs (job, submitted, seconds) with started and ended under a single first-come worker.

    ended is the running maximum of submitted + all that is left to do, which needs no fold: with S the running sum of
    durations, ended_i = S_i + max over j <= i of (submitted_j - S_{j-1}).
    """
    w = Window.orderBy("submitted", "job").rowsBetween(Window.unboundedPreceding, 0)
    r = jobs.withColumn("_s", F.sum("seconds").over(w))
    r = r.withColumn("ended", F.col("_s") + F.max(F.col("submitted") - (F.col("_s") - F.col("seconds"))).over(w))
    return r.withColumn("started", F.col("ended") - F.col("seconds")).drop("_s")


def not_cancelled(jobs: DataFrame, cancels: DataFrame) -> DataFrame:
    """jobs without those that a cancel names before they start; one without an id cancels nothing."""
    first = cancels.where(F.col("job").isNotNull() & (F.col("job").cast("string") != "")).groupBy("job").agg(F.min("ts").alias("_c"))
    return jobs.join(first, "job", "left").where(F.col("_c").isNull() | (F.col("_c") > F.col("started"))).drop("_c")


def error_code(exception: Column) -> Column:
    found = F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv])
    return F.when(exception.isNotNull(), F.coalesce(F.try_element_at(found, exception), F.lit("ENGINE_ERROR")))


def recent(rows: DataFrame, dir_col: str, ts_col: str, id_col: str, n: int = 8) -> DataFrame:
    """The latest n distinct directories, latest first, as (dir_col, rank)."""
    last = rows.groupBy(dir_col).agg(F.max(F.struct(F.col(ts_col), F.col(id_col))).alias("_t"))
    return last.orderBy(F.col("_t").desc()).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.col("_t").desc()))).drop("_t")


def chunked(rows: DataFrame, keys: list[str], order: list[str], size: int = 15) -> DataFrame:
    """rows with chunk (from 0) and in_chunk (from 1)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("chunk", F.floor(n / size).cast("int")).withColumn("in_chunk", (n % size + 1).cast("int"))


def paired(results: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Results of a chunk joined to its rows by place; what has no counterpart is dropped."""
    return rows.join(results, [*keys, "chunk", "in_chunk"])


def grafted(rows: DataFrame, found: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """rows with value_col from found where it has the row, else as it was."""
    new = found.select(*keys, F.col(value_col).alias("_new"))
    return rows.join(new, keys, "left").withColumn(value_col, F.coalesce("_new", value_col)).drop("_new")
