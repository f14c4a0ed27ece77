"""Pages from their parts: lines from spans, figures, resolutions, and the record of a document from its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import arabic as A
from quire.functions import text as T
from quire.functions.scoring import rounded
from quire.operators import document as D

SPAN = "struct<text:string,size:double,flags:int,font:string>"


def lines_from_spans(pages: DataFrame, keys: list[str], blocks_col: str = "blocks") -> DataFrame:
    """(keys, line_no, text, x0, y0, x1, y1, size, bold, fonts) from array<struct<lines:array<struct<bbox:array<double>,spans:array<SPAN>>>>>.

    size is the median of the spans with text, bold that any has bit 16 of its flags or "bold" in its font's name.
    """
    flat = F.flatten(F.transform(blocks_col, lambda b: b["lines"]))
    rows = pages.select(*keys, F.posexplode(flat).alias("line_no", "l"))
    sizes = F.array_sort(F.transform(F.filter("l.spans", lambda s: F.length(T.strip(s["text"])) > 0), lambda s: s["size"]))
    n = F.size(sizes)
    middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
    text = F.array_join(F.transform("l.spans", lambda s: s["text"]), "")
    box = [F.get("l.bbox", F.lit(i)).alias(k) for i, k in enumerate(("x0", "y0", "x1", "y1"))]
    bold = F.exists("l.spans", lambda s: (s["flags"].bitwiseAND(16) != 0) | F.lower(s["font"]).contains("bold"))
    fonts = F.array_sort(F.array_distinct(F.transform("l.spans", lambda s: s["font"])))
    return rows.select(*keys, "line_no", text.alias("text"), *box, F.when(n > 0, F.round(middle, 2)).otherwise(0.0).alias("size"), bold.alias("bold"), fonts.alias("fonts")).where(F.length(T.strip(F.col("text"))) > 0)


def figures(images: DataFrame, keys: list[str], least: float = 0.03) -> DataFrame:
    """images (keys, xref, x0, y0, x1, y1, page_area) that are large enough, each xref once a page."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    big = images.where((F.col("xref") > 0) & (w * h / F.greatest(F.col("page_area"), F.lit(1.0)) >= least) & (w >= 40) & (h >= 40))
    return big.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "xref").orderBy("y0", "x0"))).where("_rn = 1").drop("_rn")


def image_measures(images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dpi, coverage): the highest resolution, and the share of the page that images take (overlaps twice)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return images.groupBy(*keys).agg(F.round(F.max(F.col("width_px") / F.nullif(w / 72.0, F.lit(0.0))), 1).alias("dpi"), F.round(F.sum(w * h) / F.greatest(F.max("page_area"), F.lit(1.0)), 3).alias("coverage"))


def document_records(pages: DataFrame, id_col: str) -> DataFrame:
    """A record for each document from its pages (id_col, page_no, chars, ink_fraction, backed, skew, columns, signature, language, width, height, rotation)."""
    p = pages.withColumn("blank", D.is_blank(F.col("chars"), F.col("ink_fraction")))
    full = ~F.col("blank")
    several = p.where(full).groupBy(id_col, "signature").agg(F.count("*").alias("_k"))
    p = p.join(several, [id_col, "signature"], "left")

    def listed(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.col("page_no"))))

    out = p.groupBy(id_col).agg(
        F.count("*").alias("page_count"), F.round(F.avg((F.col("chars") >= 60).cast("int")), 3).alias("text_page_ratio"), F.round(F.avg(F.col("backed").cast("int")), 3).alias("image_backed_ratio"),
        listed(F.col("blank")).alias("blank_pages"), listed(F.coalesce(F.col("_k") > 1, F.lit(False))).alias("duplicate_pages"), listed(F.col("rotation") % 360 != 0).alias("rotated_pages"),
        F.round(F.coalesce(F.median(F.when(full, F.abs("skew"))), F.lit(0.0)), 2).alias("skew_median"), F.round(F.coalesce(F.max(F.when(full, F.abs("skew"))), F.lit(0.0)), 2).alias("skew_max"),
        (F.count("language") > 0).alias("has_language"), F.array_sort(F.collect_set(F.struct("width", "height"))).alias("page_sizes"),
    )
    modal = D.mode_first_seen(p.where(full), id_col, "columns", "page_no").withColumnRenamed("columns", "dominant_columns")
    out = out.join(modal, id_col, "left").withColumn("dominant_columns", F.coalesce("dominant_columns", F.lit(1)))
    return out.withColumn("doc_type", D.document_type(F.col("text_page_ratio"), F.col("image_backed_ratio")))


def font_list(fonts: DataFrame, id_col: str, pages: int = 25, limit: int = 40) -> DataFrame:
    """(id_col, fonts): names on the first pages, sorted."""
    return fonts.where(F.col("page_no") < pages).groupBy(id_col).agg(F.slice(F.array_sort(F.collect_set("font")), 1, limit).alias("fonts"))


def probed_language(samples: DataFrame, id_col: str) -> DataFrame:
    """(id_col, language, ratio): from sampled pages with more than 40 characters, in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length("text") > 40, F.struct("page_no", "text")))), lambda x: x["text"]), "\n")
    r = samples.groupBy(id_col).agg(text.alias("t")).select(id_col, A.letter_ratios(F.col("t")).alias("r"))
    return r.select(id_col, A.language_by(F.col("r")).alias("language"), rounded(F.col("r.arabic"), 2).alias("ratio"))


def guessed_meta(meta: Column, blocks: DataFrame, id_col: str, docs: DataFrame, stem_col: str) -> DataFrame:
    """(id_col, title, author, subject) for docs with a map of metadata: the title also from the first long heading of six blocks."""
    heads = blocks.where((F.col("block_no") <= 6) & (F.col("kind") == "heading") & (F.length("text") > 3)).groupBy(id_col).agg(F.min_by("text", "block_no").alias("_h"))
    rows = docs.join(heads, id_col, "left")
    return rows.select(
        id_col, D.guess_title(F.coalesce(F.try_element_at(meta, F.lit("title")), F.lit("")), F.col("_h"), F.col(stem_col)).alias("title"),
        F.substring(F.coalesce(F.nullif(F.trim(F.try_element_at(meta, F.lit("author"))), F.lit("")), F.lit("Unknown")), 1, 80).alias("author"), F.substring(F.coalesce(F.try_element_at(meta, F.lit("subject")), F.lit("")), 1, 60).alias("subject"),
    )


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def layered(ocr_page: Column, image: Column) -> Column:
    """A page of a searchable document: its recognised layer, or else its image."""
    return F.coalesce(ocr_page, image)


def converter_reason(previewer: Column, plugin: Column) -> Column:
    return F.when(previewer & plugin, "ready").when(previewer, "plugin missing").when(plugin, "previewer missing").otherwise("both tools missing")


def wrapped(text: Column, width: int = 70, indent: str = "") -> Column:
    """Greedy word wrap as an expression; a word longer than the width has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def put(s: Column, w: Column) -> Column:
        grown = F.when(s["line"] == "", F.concat(F.lit(indent), w)).otherwise(F.concat_ws(" ", s["line"], w))
        fits = (s["line"] == "") | (F.length(grown) <= width)
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], s["line"], F.lit("\n"))).alias("done"), F.when(fits, grown).otherwise(F.concat(F.lit(indent), w)).alias("line"))

    return F.aggregate(words, zero, put, lambda s: F.concat(s["done"], s["line"]))
