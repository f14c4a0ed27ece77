"""Recognised words, lines and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scoring import rounded


def lines(words: DataFrame, keys: list[str], word_col: str = "word", order_col: str = "word_no") -> DataFrame:
    """Words grouped by (keys, block_num, par_num, line_num): text in input order, box, mean confidence, size."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, word_col))), lambda x: x[word_col]), " ")
    box = {"x0": F.min("left"), "y0": F.min("top"), "x1": F.max(F.col("left") + F.col("width")), "y1": F.max(F.col("top") + F.col("height"))}
    grouped = words.groupBy(*keys, "block_num", "par_num", "line_num").agg(text.alias("text"), rounded(F.avg("conf"), 1).alias("conf"), *[v.alias(k) for k, v in box.items()])
    return grouped.withColumn("size", F.col("y1") - F.col("y0"))


def lines_of(rows: DataFrame, keys: list[str], word_col: str = "word") -> DataFrame:
    """What lines() gives, from rows (keys, block_num, par_num, line_num, words) that each hold the words of a line, in order.

    No word leaves its row, so nothing is shuffled. No line may be in two rows.
    """
    w = F.col("words")
    of = lambda f: F.transform(w, f)
    conf = F.aggregate(of(lambda x: x["conf"]), F.lit(0.0), lambda s, x: s + x) / F.size(w)
    box = {"x0": F.array_min(of(lambda x: x["left"])), "y0": F.array_min(of(lambda x: x["top"])), "x1": F.array_max(of(lambda x: x["left"] + x["width"])), "y1": F.array_max(of(lambda x: x["top"] + x["height"]))}
    found = rows.where(F.size(w) > 0).select(*keys, "block_num", "par_num", "line_num", F.array_join(of(lambda x: x[word_col]), " ").alias("text"), rounded(conf, 1).alias("conf"), *[v.alias(k) for k, v in box.items()])
    return found.withColumn("size", F.col("y1") - F.col("y0"))


def page_summary(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, mean_conf, low_conf_words)."""
    return words.groupBy(*keys).agg(F.count("*").alias("words"), F.coalesce(rounded(F.avg("conf"), 1), F.lit(0.0)).alias("mean_conf"), F.count_if(F.col("conf") < 60).alias("low_conf_words"))


def _mean_in_order(order_col: str, value: Column) -> Column:
    """The mean of a group's values, added up in order: a sum of binary numbers depends on it, and with it a tie's rounding."""
    values = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order_col).alias("o"), value.alias("v"))))), lambda x: x["v"])
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))


def document_confidence(pages: DataFrame, id_col: str, page_col: str = "page_no") -> DataFrame:
    """(id_col, mean_conf): the plain mean over pages with more than five words."""
    return pages.groupBy(id_col).agg(rounded(F.coalesce(_mean_in_order(page_col, F.when(F.col("words") > 5, F.col("mean_conf"))), F.lit(0.0)), 6).alias("mean_conf"))


def chunk_confidence(words: DataFrame, id_col: str, page_col: str, pages_per_chunk: int = 15) -> DataFrame:
    """(id_col, mean_conf): the mean of the rounded means of runs of pages, as a service asked in chunks reports it."""
    by_chunk = words.withColumn("chunk", F.floor(F.col(page_col) / pages_per_chunk)).groupBy(id_col, "chunk").agg(rounded(F.avg("conf"), 1).alias("c"))
    return by_chunk.groupBy(id_col).agg(rounded(_mean_in_order("chunk", F.col("c")), 1).alias("mean_conf"))


def to_points(pixels: Column, dpi: float = 300.0) -> Column:
    return pixels / (dpi / 72.0)


def first_heads(page_lines: DataFrame, keys: list[str], body: DataFrame, id_col: str, chapter: Column) -> DataFrame:
    """(keys, text): of a page's first four lines, the first that is short, sure, and large or a chapter's.

    page_lines: keys, line_no (from 0 in the page), text, conf, size; body: (id_col, body), the median size.
    """
    t = F.trim("text")
    rows = page_lines.where(F.col("line_no") < 4).join(body, id_col).where((F.length(t) > 0) & (F.length(t) <= 70) & (F.col("conf") >= 65) & ((F.col("size") >= 1.45 * F.col("body")) | chapter))
    return rows.groupBy(*keys).agg(F.min_by(t, "line_no").alias("text"))
