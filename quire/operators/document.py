"""From pages to documents: page flags, running heads, duplicates, types, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import repeat_key


# ---- flags of a page
def is_blank(chars: Column, ink_fraction: Column) -> Column:
    return (chars < 3) & (ink_fraction < 0.002)


def image_backed(image_area: Column, page_area: Column) -> Column:
    return image_area / F.greatest(page_area, F.lit(1.0)) > 0.55


def is_scanned(image_area: Column, page_area: Column, chars: Column) -> Column:
    return image_backed(image_area, page_area) & (chars < 60)


def is_noisy(speckle: Column, uniformity: Column) -> Column:
    return (speckle > 0.35) | (uniformity < 0.72)


def is_low_dpi(dpi: Column) -> Column:
    return F.coalesce(dpi < 200, F.lit(False))


# ---- samples and limits
def sampled_pages(n: Column, sample: int) -> Column:
    """The page indices (from 0) of a systematic sample of a document with n pages: the first three, then even steps."""
    head = F.least(F.lit(3), n)
    step = F.greatest(F.lit(1.0), (n - 1) / F.greatest(F.lit(sample) - head, F.lit(1)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(max(sample - 1, 0))), lambda i: (head - 1 + 1 + i * step).cast("int"))
    first = F.when(head > 0, F.sequence(F.lit(0), head - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.filter(F.array_distinct(F.concat(first, steps)), lambda i: i < n))


def preview_pages(n: Column) -> Column:
    return F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), F.greatest(n - 1, F.lit(0))))


# ---- running heads
def running_heads(edges: DataFrame, id_col: str, page_counts: DataFrame, share: float = 0.25) -> DataFrame:
    """(id_col, slot, key, n): normalised edge lines that recur on enough of the document's pages.

    edges: (id_col, slot, text); page_counts: (id_col, n_pages), blank pages included. n counts pages; a key counts from
    the larger of 3 and ``share`` of the pages, up to 90 characters.
    """
    counted = edges.select(id_col, "slot", repeat_key(F.col("text")).alias("key")).where((F.length("key") > 0) & (F.length("key") <= 90)).groupBy(id_col, "slot", "key").agg(F.count("*").alias("n"))
    return counted.join(page_counts, id_col).where(F.col("n") >= F.greatest(F.lit(3.0), F.col("n_pages") * share)).select(id_col, "slot", "key", "n")


def without_running_heads(lines: DataFrame, heads: DataFrame, id_col: str) -> DataFrame:
    """lines whose normalised text is no running head of the document, wherever on the page they stand."""
    keys = heads.select(id_col, F.col("key").alias("_key")).distinct()
    return lines.withColumn("_key", repeat_key(F.col("text"))).join(keys, [id_col, "_key"], "left_anti").drop("_key")


# ---- duplicate pages
def kept_pages(pages: DataFrame, id_col: str) -> DataFrame:
    """pages that aren't blank, the first of each signature."""
    first = Window.partitionBy(id_col, "signature").orderBy("page_no")
    return pages.where("not blank").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def duplicate_pages(pages: DataFrame, id_col: str) -> DataFrame:
    """pages whose signature is that of several pages with content; blank ones may be among them."""
    several = pages.where("not blank").groupBy(id_col, "signature").count().where("count > 1").drop("count")
    return pages.join(several, [id_col, "signature"], "left_semi")


# ---- documents
def mode_first_seen(rows: DataFrame, id_col: str, value_col: str, order_col: str) -> DataFrame:
    """(id_col, value_col): the most frequent value; of equally frequent ones the first to occur."""
    counted = rows.groupBy(id_col, value_col).agg(F.count("*").alias("n"), F.min(order_col).alias("first"))
    return counted.groupBy(id_col).agg(F.max_by(value_col, F.struct("n", -F.col("first"))).alias(value_col))


def document_type(text_ratio: Column, backed_ratio: Column) -> Column:
    return F.when((text_ratio > 0.85) & (backed_ratio >= 0.6), "text_over_scan").when(text_ratio > 0.85, "text").when(text_ratio < 0.15, "scanned").otherwise("mixed")


def percent(share: Column) -> Column:
    return F.concat(F.format_number(F.bround(share * 100, 0), 0), F.lit("%"))


def route(doc_type: Column, columns: Column, text_ratio: Column) -> Column:
    """struct(route, reason)."""
    dense = (doc_type == "text") & (columns > 2)
    name = F.when(dense, "fixed").when(doc_type == "text", "reflow").otherwise("ocr")
    reason = (
        F.when(dense, "many columns keep their shape better on fixed pages")
        .when(doc_type == "text", F.concat(F.lit("text layer on "), percent(text_ratio), F.lit(" of pages")))
        .when(doc_type == "text_over_scan", "scans with an earlier text layer; recognising cleaned images is more accurate")
        .when(doc_type == "scanned", "no text layer")
        .otherwise(F.concat(F.lit("mixed, "), percent(text_ratio), F.lit(" text pages; recognition fills the gaps")))
    )
    return F.struct(name.alias("route"), reason.alias("reason"))


def forced(route_: Column, force: Column) -> Column:
    return F.coalesce(F.nullif(force, F.lit("auto")), route_)


def estimate_seconds(pages: Column, route_: Column) -> Column:
    return F.when(route_ == "reflow", F.greatest(F.lit(10.0), pages * 0.22)).otherwise(F.greatest(F.lit(30.0), pages * 2.6)).cast("int")


def scaled_up(n: Column, pages: Column, analysed: Column, sampled: Column) -> Column:
    return F.when(sampled, (n * (pages / F.greatest(analysed, F.lit(1)))).cast("int")).otherwise(n)


def document_language(language: Column, ratio: Column) -> Column:
    """Right-to-left layout of a text layer."""
    return language.isin("ar", "bilingual") & (ratio >= 0.35)


#: Labels shown for codes (fixed values).
LANGUAGE_LABEL = {"ar": "Arabic", "en": "English", "bilingual": "Arabic and English"}
OCR_LANGUAGE = {"en": "eng", "ar": "ara", "bilingual": "ara+eng", "ar+en": "ara+eng"}
TYPE_LABEL = {"text": "text layer", "scanned": "scanned images", "text_over_scan": "scans with a text layer", "mixed": "part text, part scanned"}


def label(code: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """A literal map looked up, with a default."""
    found = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(found, code), default if default is not None else code)


def findings(a: dict[str, Column]) -> Column:
    """An array of the sentences that hold for a document, in order."""
    language, kind = label(a["language"], LANGUAGE_LABEL, F.lit(None).cast("string")), label(a["doc_type"], TYPE_LABEL, F.lit(""))
    columns = F.when(a["columns"] == 1, "single column").otherwise(F.format_string("%d columns", a["columns"]))
    rows = [
        F.when(language.isNotNull(), F.concat_ws(", ", language, kind)).when(F.length(kind) > 0, F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substr(kind, F.lit(2))))),
        F.concat_ws(", ", columns, F.when(a["toc_entries"] > 0, F.format_string("%d bookmarks", a["toc_entries"])).otherwise("no bookmarks")),
        F.when(a["skew"] > 0.15, F.concat(F.lit("tilted by "), a["skew"].cast("string"))),
        *[F.when(a[k] > 0, F.format_string(f"%d {k} page(s)", a[k])) for k in ("blank", "duplicate", "noisy")],
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def guess_title(meta_title: Column, heading: Column, stem: Column) -> Column:
    t = F.trim(meta_title)
    good = (F.length(t) >= 3) & ~F.lower(t).endswith(".pdf")
    return F.substring(F.when(F.coalesce(good, F.lit(False)), t).otherwise(F.coalesce(heading, F.replace(stem, F.lit("_"), F.lit(" ")))), 1, 120)
