"""The engine's records derived from plain tables: lines, words, boxes, pages, recognised words, job messages.

Every child row carries its ordinals, since rows of a DataFrame have no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES_PER_PAGE = 20
PAGE_HEIGHT = 280.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(id_col, line_no, text, page_no): line_no counts from 0 in the document."""
    rows = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "text"))
    return rows.withColumn("page_no", F.floor(F.col("line_no") / lines_per_page).cast("int"))


def words(line_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, line_no, page_no, word_no, word): the white-space-separated words of lines."""
    found = F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))
    return line_rows.select(id_col, "line_no", "page_no", F.posexplode(found).alias("word_no", "word"))


def boxed(line_rows: DataFrame) -> DataFrame:
    """lines with x0, y0, x1, y1, size and bold, from their ordinals and lengths."""
    n = F.length("text")
    y = (F.col("line_no") % LINES_PER_PAGE) * 14.0
    x0 = (F.col("line_no") % 3) * 8.0
    return line_rows.withColumns({"x0": x0, "y0": y, "x1": x0 + n * 6.0, "y1": y + 10.0, "size": 10.0 + (n % 5), "bold": n % 7 == 0})


def _as_recognised(word: Column, word_no: Column) -> dict[str, Column]:
    n = F.length(word)
    return {"conf": 40.0 + (n * 37) % 60, "left": word_no * 30, "top": F.col("line_no") * 14, "width": n * 6, "height": 10 + n % 4}


def _places() -> dict[str, Column]:
    return {"block_num": F.col("page_no"), "par_num": F.floor(F.col("line_no") / 5).cast("int"), "line_num": F.col("line_no")}


def recognised(word_rows: DataFrame) -> DataFrame:
    """words as an OCR engine reports them: block, paragraph and line numbers, a confidence and a box."""
    return word_rows.withColumns({**_places(), **_as_recognised(F.col("word"), F.col("word_no"))})


def recognised_lines(line_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, block_num, par_num, line_num, words): what recognised(words()) gives, the words of a line as an array in order."""
    found = F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))
    items = F.transform(found, lambda w, i: F.struct(w.alias("word"), *[c.alias(k) for k, c in _as_recognised(w, i).items()]))
    return line_rows.select(id_col, *[c.alias(k) for k, c in _places().items()], items.alias("words"))


def pages_of(boxed_lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, page_no, chars, n_lines, signature, top_line, bottom_line, ink_fraction): a page for each run of lines."""
    place = F.struct("y0", "line_no")
    return boxed_lines.groupBy(id_col, "page_no").agg(
        F.sum(F.length(F.trim("text"))).alias("chars"), F.count("*").alias("n_lines"), F.md5(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]))).alias("signature"),
        F.min_by("text", place).alias("top_line"), F.max_by("text", place).alias("bottom_line"), (F.sum(F.length("text")) / 10000.0).alias("ink_fraction"),
    )


#: Order of the stages of a job, and their share of its duration (fixed values).
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]
STAGES = ["analyze", "clean", "ocr", "extract", "typography", "build", "qa"]
WEIGHTS = [0.13, 0.13, 0.52, 0.04, 0.03, 0.09, 0.06]


def job_events(events: DataFrame) -> DataFrame:
    """(job, seq, ts, event_id, stage, stage_idx, pct): events as messages of a job for each user."""
    known = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type"))
    idx = F.when(known > 0, known - 1).otherwise(F.lit(len(EVENT_TYPES))).cast("int")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pct = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100.0))
    return events.select(F.col("user_id").alias("job"), seq.alias("seq"), "ts", "event_id", F.element_at(F.array(*map(F.lit, STAGES)), idx + 1).alias("stage"), idx.alias("stage_idx"), pct.alias("pct"))


def json_field(text: Column, path: str, default: object) -> Column:
    """A value of a JSON text by path, or default where there is none."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))
