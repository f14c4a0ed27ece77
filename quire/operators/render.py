"""Blocks as a book: HTML, navigation, names of parts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import escape_html


def rendered(blocks: DataFrame, id_col: str) -> DataFrame:
    """blocks with html: the first paragraph after a heading or image is marked, a rule opens a run of footnotes."""
    before = F.lag("kind").over(Window.partitionBy(id_col).orderBy("block_no"))
    t = escape_html(F.col("text"))
    first = before.isNull() | before.isin("heading", "image")
    html = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), F.col("level").cast("string"), F.lit(">"), t, F.lit("</h"), F.col("level").cast("string"), F.lit(">")))
        .when(F.col("kind") == "footnote", F.concat(F.when(before.isNull() | (before != "footnote"), "<hr/>").otherwise(""), F.lit('<p class="fn">'), t, F.lit("</p>")))
        .when(F.col("kind") == "image", F.concat(F.lit('<div class="img"><img src="'), t, F.lit('"/></div>')))
        .otherwise(F.concat(F.when(first, '<p class="first">').otherwise("<p>"), t, F.lit("</p>")))
    )
    return blocks.withColumn("html", html)


def book(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id_col, html): a document's blocks in order, a line each."""
    rows = rendered(blocks, id_col)
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "html"))), lambda x: x["html"]), "\n").alias("html"))


def style_sheet(rtl: Column, family: Column, line_height: Column) -> Column:
    text = F.format_string('body { direction: %s; font-family: "%s"; line-height: %.2f; }\np.first { text-indent: 0; }\np.fn { font-size: 0.8em; }\n', F.when(rtl, "rtl").otherwise("ltr"), family, line_height)
    return F.when(family.isNotNull() & line_height.isNotNull(), text)


def navigation(chapters: Column, n_pages: Column, step: int = 25) -> Column:
    """Chapters (struct(title, page)) within 1..n, or else "Page i" at every ``step`` pages."""
    inside = F.filter(chapters, lambda c: c["page"].between(1, n_pages))
    pages = F.transform(F.sequence(F.lit(1), F.greatest(n_pages, F.lit(1)), F.lit(step)), lambda i: F.struct(F.concat(F.lit("Page "), i.cast("string")).alias("title"), i.alias("page")))
    return F.when(F.coalesce(F.size(inside), F.lit(0)) > 0, inside).otherwise(pages)


def part_name(index: Column) -> Column:
    return F.concat(F.lpad(index.cast("string"), 5, "0"), F.lit(".png"))


def chapters(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id_col, block_no, title, page): headings of level 1, without repeats of the chapter just before."""
    heads = blocks.where("kind = 'heading' and level <= 1").select(id_col, "block_no", F.substring("text", 1, 70).alias("title"), "page")
    before = F.lag("title").over(Window.partitionBy(id_col).orderBy("block_no"))
    return heads.withColumn("_b", before).where("_b is null or _b <> title").drop("_b")


def output_pages(chapter_rows: DataFrame, pages: DataFrame, id_col: str, limit: int = 300) -> DataFrame:
    """Chapters with index, the place of their page among the pages kept (1 if it is none), the first ``limit``."""
    numbered = pages.select(id_col, F.col("page_no").alias("page"), F.row_number().over(Window.partitionBy(id_col).orderBy("page_no")).alias("index"))
    found = chapter_rows.join(numbered, [id_col, "page"], "left").withColumn("index", F.coalesce("index", F.lit(1)))
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy(id_col).orderBy("block_no"))).where(F.col("_rn") <= limit).drop("_rn")


def unique_names(rows: DataFrame, root_col: str, name_col: str, order_col: str) -> DataFrame:
    """rows with unique: names that only differ in case get " (2)" and so on within their root, in order."""
    n = F.row_number().over(Window.partitionBy(root_col, F.lower(name_col)).orderBy(order_col))
    return rows.withColumn("unique", F.when(n > 1, F.concat(F.col(name_col), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(name_col)))


def report(sections: list[tuple[str, list[Column]]]) -> Column:
    """A text of numbered sections, each with those of its lines that aren't null; empty sections are left out."""
    parts = []
    for i, (title, lines) in enumerate(sections, 1):
        kept = F.filter(F.array(*lines), lambda x: x.isNotNull())
        parts.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"{i}. {title}\n"), F.array_join(kept, "\n"))))
    return F.concat_ws("\n\n", *parts)


def result_shape(a: dict[str, Column]) -> Column:
    """A run's result as the user interface reads it."""
    return F.struct(
        a["file"].alias("fileName"), a["route"].alias("route"), a["gate"].alias("qaGate"), a["score"].alias("qualityScore"), a["pages"].alias("pageCount"),
        F.transform(a["outputs"], lambda k: F.struct(k.alias("kind"), (k == "azw3").alias("recommended"))).alias("outputs"),
    )
