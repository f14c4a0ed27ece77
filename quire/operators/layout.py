"""Reading order, paragraphs and headings.

Lines are rows (id_col, page_no, line_no, text, x0, y0, x1, y1, size, bold). Order is by window functions over a document;
only the two folds whose state is the merged text itself run as a function, on batches of blocks in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import settle, ship

BLOCK = "kind string, text string, page int, level int"


# ---- reading order
def order_lines(rows: DataFrame, keys: list[str], columns: Column | int, rtl: bool = False) -> DataFrame:
    """rows with column (from 0, in reading order) and reading_no (from 1 on the page).

    With several columns the page is cut at the widest gaps between line centres; of equal gaps the last counts first.
    """
    n = F.lit(columns) if isinstance(columns, int) else columns
    center = (F.col("x0") + F.col("x1")) / 2
    by_center = Window.partitionBy(*keys).orderBy("_c", "line_no")
    r = rows.withColumn("_c", center).withColumn("_n", n)
    r = r.withColumn("_i", F.row_number().over(by_center)).withColumn("_gap", F.lead("_c").over(by_center) - F.col("_c"))
    widest = Window.partitionBy(*keys).orderBy(F.col("_gap").desc_nulls_last(), F.col("_i").desc())
    r = r.withColumn("_cut", F.when((F.row_number().over(widest) <= F.col("_n") - 1) & F.col("_gap").isNotNull(), F.col("_c") + F.col("_gap") / 2))
    r = r.withColumn("_cuts", F.collect_list("_cut").over(Window.partitionBy(*keys)))
    index = F.size(F.filter("_cuts", lambda c: F.col("_c") > c))
    r = r.withColumn("column", F.when(F.col("_n") <= 1, 0).when(F.lit(rtl), F.col("_n") - 1 - index).otherwise(index))
    reading = Window.partitionBy(*keys).orderBy("column", F.bround("y0", 1), "x0", "line_no")
    return r.withColumn("reading_no", F.row_number().over(reading)).drop("_c", "_n", "_i", "_gap", "_cut", "_cuts")


# ---- classification
def body_size(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, body): the median of the sizes above 0, 12 if there is none."""
    return rows.groupBy(id_col).agg(F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(12.0)).alias("body"))


def classified(rows: DataFrame, id_col: str, page_h: float, mode: str = "text") -> DataFrame:
    """rows with body and kind; running heads should be gone. Page numbers and blank lines are skip.

    The median is taken over a document's rows where they are, so that they are dealt out once, for all that follows too.
    """
    r = rows.withColumn("body", F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy(id_col)), F.lit(12.0)))
    kind = T.classify_line(F.col("text"), F.col("size"), F.col("bold"), F.col("y1"), F.col("body"), F.lit(page_h), mode)
    return r.withColumn("kind", F.when(T.is_page_number(F.col("text")), "skip").otherwise(kind))


# ---- paragraphs
def paragraph_ids(rows: DataFrame, id_col: str, order: list[str], rtl: bool = False) -> DataFrame:
    """The para rows of classified rows, with flush (a run of lines between headings, notes and closed pages) and para.

    A paragraph starts at a wide gap, an indent or after a short line, unless the sentence plainly goes on. Medians are
    those of the run.
    """
    return _numbered(rows, id_col, order, rtl).where("kind = 'para'")


def _numbered(rows: DataFrame, id_col: str, order: list[str], rtl: bool) -> DataFrame:
    """All rows but skip with flush and para: a heading or a note is a run of its own."""
    in_order = Window.partitionBy(id_col).orderBy(*order)
    r = rows.where("kind <> 'skip'").withColumn("_pk", F.lag("kind").over(in_order)).withColumn("_pp", F.lag("page_no").over(in_order)).withColumn("_pt", F.lag("text").over(in_order))
    ends = F.coalesce((F.col("_pp") != F.col("page_no")) & F.col("_pt").rlike(T.PAGE_END), F.lit(False))
    flush = F.when((F.col("kind") != "para") | F.col("_pk").isNull() | (F.col("_pk") != "para") | ends, 1).otherwise(0)
    r = r.withColumn("flush", F.sum(flush).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(id_col, "flush")
    seq = run.orderBy(*order)
    r = r.withColumn("_h", F.median(F.col("y1") - F.col("y0")).over(run)).withColumn("_l", F.median("x0").over(run)).withColumn("_r", F.median("x1").over(run))
    before = {k: F.lag(k).over(seq) for k in ("x0", "x1", "y1", "text")}
    wide = F.col("y0") - before["y1"] > F.col("_h") * 0.85
    if rtl:
        layout = (F.col("x1") < F.col("_r") - F.col("_h") * 0.9) | (before["x0"] > F.col("_l") + F.col("_h") * 1.6)
        on = ~T.starts_upper(F.col("text")) & (F.length(T.strip(F.col("text"))) > 0)
    else:
        layout = (F.col("x0") > F.col("_l") + F.col("_h") * 0.9) | (before["x1"] < F.col("_r") - F.col("_h") * 1.6)
        on = T.starts_lower(F.col("text"))
    new = F.when(before["text"].isNull(), 1).when(wide, 1).when(layout & ~(T.is_open(before["text"]) & on), 1).otherwise(0)
    r = r.withColumn("_new", new)
    return r.withColumn("para", F.sum("_new").over(seq.rowsBetween(Window.unboundedPreceding, 0))).drop("_pk", "_pp", "_pt", "_h", "_l", "_r", "_new")


def blocks(rows: DataFrame, id_col: str, order: list[str], rtl: bool = False) -> DataFrame:
    """(id_col, block_no, kind, text, page, level) from classified rows, paragraphs joined; block_no from 1."""
    place = F.struct(*order)
    r = _numbered(rows, id_col, order, rtl).withColumn("page", F.max_by("page_no", place).over(Window.partitionBy(id_col, "flush")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"])
    r = r.groupBy(id_col, "flush", "para").agg(F.min(place).alias("at"), texts.alias("_t"), *[F.first(c).alias(c) for c in ("page", "kind", "size", "body")])
    text = F.when(F.col("kind") == "para", T.join_lines(F.col("_t"), rtl)).otherwise(T.strip(F.get("_t", F.lit(0))))
    level = F.when(F.col("kind") == "heading", T.heading_level(F.col("size"), F.col("body"))).otherwise(0)
    r = r.select(id_col, "at", "kind", text.alias("text"), "page", level.alias("level")).where((F.col("kind") != "para") | (F.length("text") > 0))
    return r.withColumn("block_no", F.row_number().over(Window.partitionBy(id_col).orderBy("at"))).select(id_col, "block_no", "kind", "text", "page", "level")


# ---- folds over a document's blocks
def merge_across_pages(rows: DataFrame, id_col: str) -> DataFrame:
    """Blocks with paragraphs that a page break cut in two joined.

    The joined block keeps its first page, so that a chain ends where a page is two further on.
    """
    import re

    from quire.functions.arabic import BLOCKS

    end, arabic = re.compile(T.SENTENCE_END), re.compile(f"[{BLOCKS}]")

    def fold(last: list, row: list) -> list | None:
        kind, text, page, _ = row
        if kind == "para" and last[0] == "para" and page - last[2] in (0, 1):
            head, tail = last[1], text.strip()
            goes_on = tail and (tail[0].islower() if tail[0].isascii() else not tail[0].isupper())
            if goes_on and len(head) > 15 and not end.search(head.strip()):
                letters = [c for c in head if c.isalpha()]
                rtl = bool(letters) and sum(bool(arabic.match(c)) for c in letters) / len(letters) >= 0.4
                split = None if rtl else re.search("([A-Za-zÀ-ɏ]{2,})[-‐‑]$", head)
                return [kind, re.sub(r"\s{2,}", " ", head[:-1] + tail if split else f"{head} {tail}").strip(), *last[2:]]
        return None

    return _by_document(rows, id_col, fold)


def dedupe_headings(rows: DataFrame, id_col: str) -> DataFrame:
    """Blocks without headings that repeat, or are part of, the heading just before; the longer one stays in its place."""
    import re

    other = re.compile(r"[^\w؀-ۿ]+")

    def fold(last: list, row: list) -> list | None:
        if row[0] == "heading" and last[0] == "heading":
            a, b = (other.sub(" ", x).strip().lower() for x in (last[1], row[1]))
            if a and b and (a in b or b in a):
                return row if len(b) > len(a) else last
        return None

    return _by_document(rows, id_col, fold)


def _by_document(rows: DataFrame, id_col: str, fold) -> DataFrame:
    """A document's blocks in order: fold(last, row) gives what takes the place of both, or None if the row stands by itself.

    Documents go by in batches of rows, as their windows leave them: a task holds a batch and the last block.
    """
    ship(rows.sparkSession)
    names = [id_col, "block_no", *(c.split()[0] for c in BLOCK.split(", "))]

    def run(batches):
        import pyarrow as pa

        at, last, n, schema = None, None, 0, None
        for batch in batches:
            schema = pa.schema([batch.schema.field(x) for x in names])
            out: list[tuple] = []
            for doc, first, *row in zip(*(batch.column(x).to_pylist() for x in (id_col, "_first", *names[2:])), strict=True):
                both = None if last is None or first else fold(last, row)
                if both is None:
                    if last is not None:
                        n += 1
                        out.append((at, n, *last))
                    n, at, last = 0 if first else n, doc, row
                else:
                    last = both
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(names), schema, strict=True)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((at, n + 1, *last), schema, strict=True)], schema=schema)

    kind = rows.schema[id_col].dataType.simpleString()
    first = F.row_number().over(Window.partitionBy(id_col).orderBy("block_no")) == 1  # brings a document's rows together, in order
    r = rows.select(id_col, F.col("block_no").cast("int").alias("block_no"), "kind", "text", F.col("page").cast("int").alias("page"), F.col("level").cast("int").alias("level"))
    return r.withColumn("_first", first).mapInArrow(run, f"`{id_col}` {kind}, block_no int, {BLOCK}")


# ---- bookmarks
def wanted_bookmarks(bookmarks: DataFrame, id_col: str) -> DataFrame:
    """The first bookmark of each page among those of level 1 and 2 with a title. bookmarks: id_col, ordinal, level, title, page."""
    first = Window.partitionBy(id_col, "page").orderBy("ordinal")
    rows = bookmarks.where((F.col("level") <= 2) & (F.col("page") > 0) & (F.length(T.strip(F.col("title"))) > 0))
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(id_col, "page", T.strip(F.col("title")).alias("title"), "level")


def promoted(rows: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """(id_col, block_no, level): for each page the first paragraph that starts like its bookmark, up to 140 characters."""
    squeeze = F.lower(T.strip(F.regexp_replace("text", r"\s+", " ")))
    start = F.substring(F.lower(F.regexp_replace("title", r"\s+", " ")), 1, 20)
    hit = rows.where("kind = 'para'").drop("level").join(wanted, [id_col, "page"]).where(squeeze.startswith(start) & (F.length("text") <= 140))
    return hit.groupBy(id_col, "page").agg(F.min_by(F.struct("block_no", "level"), "block_no").alias("b")).select(id_col, "page", "b.block_no", "b.level")


def unmatched_bookmarks(rows: DataFrame, wanted: DataFrame, matched: DataFrame, id_col: str) -> DataFrame:
    """Bookmarks without a promoted paragraph, and without a heading on their or a neighbouring page that says the same.

    The band of three pages is spread out on the side of the bookmarks, so that the join is by equal pages.
    """
    heads = rows.where("kind = 'heading'").select(id_col, F.col("page").alias("near"), T.normalised(F.col("text")).alias("h"))
    left = wanted.join(matched.select(id_col, "page"), [id_col, "page"], "left_anti").withColumn("t", T.normalised(F.col("title")))
    spread = left.withColumn("near", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    told = spread.join(heads, [id_col, "near"]).where((F.length("t") > 0) & (F.col("h").contains(F.col("t")) | F.col("t").contains(F.col("h")))).select(id_col, "page").distinct()
    return left.join(told, [id_col, "page"], "left_anti").select(id_col, "page", "title", "level")


def insertion_points(rows: DataFrame, bookmarks: DataFrame, id_col: str) -> DataFrame:
    """(id_col, page, title, level, block_no): the first block on the bookmark's page or later; none drops the bookmark.

    A forward as-of join: bookmarks and blocks are ordered together, and each bookmark takes the next block.
    """
    both = rows.select(id_col, "page", F.lit(1).alias("side"), "block_no", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("level"))
    both = both.unionByName(bookmarks.select(id_col, "page", F.lit(0).alias("side"), F.lit(None).cast("int").alias("block_no"), "title", F.col("level").cast("int").alias("level")))
    ahead = Window.partitionBy(id_col).orderBy("page", "side", "block_no").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("next", F.min("block_no").over(ahead)).where("side = 0 and next is not null").select(id_col, "page", "title", "level", F.col("next").alias("block_no"))


def with_bookmarks(rows: DataFrame, bookmarks: DataFrame, id_col: str) -> DataFrame:
    """Blocks with headings from the document's own bookmarks, duplicates removed and headings cleaned."""
    rows, wanted = settle(rows, "blocks"), settle(wanted_bookmarks(bookmarks, id_col), "bookmarks")  # each is read several times
    found = settle(promoted(rows, wanted, id_col), "promoted")
    new = insertion_points(rows, unmatched_bookmarks(rows, wanted, found, id_col), id_col)
    r = rows.join(found.select(id_col, "block_no", F.col("level").alias("_l")), [id_col, "block_no"], "left")
    r = r.withColumn("kind", F.when(F.col("_l").isNotNull(), "heading").otherwise(F.col("kind"))).withColumn("level", F.coalesce("_l", "level")).withColumn("_at", F.col("block_no").cast("double")).drop("_l")
    r = r.select(id_col, "_at", "kind", "text", "page", "level").unionByName(new.select(id_col, (F.col("block_no") - 0.5).alias("_at"), F.lit("heading").alias("kind"), F.col("title").alias("text"), "page", "level"))
    r = r.withColumn("block_no", F.row_number().over(Window.partitionBy(id_col).orderBy("_at", "page")))
    done = dedupe_headings(r, id_col)
    return done.withColumn("text", F.when(F.col("kind") == "heading", T.clean_heading(F.col("text"))).otherwise(F.col("text")))
