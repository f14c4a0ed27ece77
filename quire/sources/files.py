"""Readers for the engine's inputs and writers for its outputs.

Rendering of PDF pages, recognition engines, font files and e-book containers are outside of an analytic engine: their
results come in through these readers as tables, and their inputs go out through these writers.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship

OCR_SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf string, text string"
LAYOUT_SCHEMA = "struct<pages:array<struct<pageNumber:int,unit:string,lines:array<struct<content:string,polygon:array<double>>>,words:array<struct<content:string,confidence:double>>>>>"
MESSAGE_SCHEMA = "struct<id:string,event:string,stage:string,status:string,overallPct:double,stagePct:double,detail:string,result:string,error:struct<code:string,message:string,detail:string>>"
REQUEST_SCHEMA = "struct<id:string,method:string,params:map<string,string>>"


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recognition engine's TSV tables: rows without a number as confidence, below 0 or without text are left out."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema=OCR_SCHEMA)
    return recognised_words(rows)


def recognised_words(rows: DataFrame) -> DataFrame:
    conf = F.col("conf").try_cast("double")
    return rows.withColumn("conf", conf).where((F.col("conf") >= 0) & (F.length(F.trim("text")) > 0))


def layout_lines(results: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """(keys, page_no, line_no, text, x0, y0, x1, y1, conf) from a layout service's JSON answers; inches become points."""
    pages = results.select(*keys, F.explode(F.from_json(F.col(json_col), LAYOUT_SCHEMA)["pages"]).alias("p"))
    rows = pages.select(*keys, F.col("p.pageNumber").alias("page_no"), F.when(F.col("p.unit") == "inch", 72.0).otherwise(1.0).alias("k"), F.posexplode("p.lines").alias("line_no", "l")).where(F.length(F.trim("l.content")) > 0)
    xs, ys = F.filter("l.polygon", lambda _, i: i % 2 == 0), F.filter("l.polygon", lambda _, i: i % 2 == 1)
    return rows.select(*keys, "page_no", "line_no", F.trim("l.content").alias("text"), *[(f(a) * F.col("k")).alias(n) for n, f, a in (("x0", F.array_min, xs), ("y0", F.array_min, ys), ("x1", F.array_max, xs), ("y1", F.array_max, ys))], F.lit(100.0).alias("conf"))


def layout_confidence(results: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """(keys, mean_conf): the mean confidence of words, in percent."""
    words = results.select(*keys, F.explode(F.flatten(F.transform(F.from_json(F.col(json_col), LAYOUT_SCHEMA)["pages"], lambda p: p["words"]))).alias("w"))
    return words.groupBy(*keys).agg(F.round(F.avg("w.confidence") * 100, 1).alias("mean_conf"))


def parsed(lines: DataFrame, schema: str = MESSAGE_SCHEMA, text_col: str = "value") -> DataFrame:
    """Lines of JSON, batch or stream, as (msg, error): blank lines are left out, what is no JSON object is BAD_REQUEST."""
    msg = F.from_json(F.col(text_col), schema)
    rows = lines.where(F.length(F.trim(text_col)) > 0)
    bad = F.try_parse_json(F.col(text_col)).isNull() | ~F.trim(text_col).startswith("{")
    return rows.select(F.when(~bad, msg).alias("msg"), F.when(bad, F.lit("BAD_REQUEST")).alias("error"))


def key_values(lines: Column) -> Column:
    """A map from an array of "key: value" lines; keys trimmed and in lower case, of equal keys the last counts."""
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def setting(env: Column, stored: Column) -> Column:
    """A setting: the environment's value before the stored one, blank as none."""
    return F.coalesce(F.nullif(F.trim(env), F.lit("")), F.nullif(F.trim(stored), F.lit("")))


def merged_settings(stored: Column, new: Column) -> Column:
    """Maps of settings: null keeps, blank deletes, all else is trimmed and replaces."""
    given = F.map_filter(new, lambda _, v: v.isNotNull())
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(given, k))
    added = F.transform_values(F.map_filter(given, lambda _, v: F.length(F.trim(v)) > 0), lambda _, v: F.trim(v))
    return F.map_concat(kept, added)


def inbox(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime) of the files of a folder, in order of path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime").orderBy("path")


def magic_heads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, head): the first 100 bytes of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.substr("content", F.lit(1), F.lit(100)).alias("head"))


def archive_entries(files: DataFrame) -> DataFrame:
    """(path, entry, size) for each entry of the ZIP archives in (path, content); what is no archive has none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, i.filename, i.file_size) for i in z.infolist()]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "entry", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string, size bigint")


def archive_summary(entries: DataFrame) -> DataFrame:
    """(path, entries, has_opf, has_nav, images, fonts) of archives."""
    e = F.lower("entry")
    return entries.groupBy("path").agg(
        F.count("*").alias("entries"), F.bool_or(e.endswith(".opf")).alias("has_opf"), F.bool_or(e.contains("nav")).alias("has_nav"), F.count_if(e.rlike(r"\.(?:png|jpe?g|gif|svg)$")).alias("images"), F.collect_list(F.when(e.rlike(r"\.(?:ttf|otf)$"), F.col("size"))).alias("fonts")
    )


def reference_text(pages: DataFrame, id_col: str, limit: int = 1500) -> DataFrame:
    """(id_col, text): the first ``limit`` pages' texts in order, presentation forms folded."""
    from quire.functions.arabic import fold_presentation_forms

    kept = pages.where(F.col("page_no") < limit).select(id_col, "page_no", fold_presentation_forms(F.col("text")).alias("text"))
    return kept.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


# ---- writers
def write_records(rows: DataFrame, path: str, without: list[str] | None = None) -> None:
    """One JSON object a line, without the named columns."""
    rows.drop(*(without or [])).write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """Texts below a folder for each name."""
    rows.select(F.col(name_col).alias("name"), F.col(text_col).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def delivery(done: DataFrame, failed: DataFrame, name_col: str) -> DataFrame:
    """A batch's summary: a row for each book, with qa ERROR and the reason for those that failed."""
    ok = done.select(name_col, F.col("gate").alias("qa"), F.lit(None).cast("string").alias("error"))
    return ok.unionByName(failed.select(name_col, F.lit("ERROR").alias("qa"), "error"))
