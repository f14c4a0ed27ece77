"""Queries over decisions, formats, right-to-left layout and edge lines, and the same in SQL.

The measures that the reference takes from files are derived here from each document's id, length and language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import arabic as A
from quire.functions import scoring, shaping
from quire.functions import text as T
from quire.operators import document as D
from quire.operators import gates, jobs, layout, pages, render
from quire.plans.books import _PARAS
from quire.plans.books import SQL as _BOOKS
from quire.plans.lines import ARABISED, BOXED, S, _score_sql
from quire.sources.views import PAGE_HEIGHT, boxed, lines, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _pick(options: list[str], of) -> object:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(of, F.lit(len(options))) + 1).cast("int"))


def _list(options: list[str], of: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in options) + f"][{of} % {len(options)} + 1]"


MODES, ENGINES, KINDS, ROUTES, GATES = ["auto", "always", "never"], ["azure", "auto", "local", "cloud"], ["text", "scanned", "text_over_scan", "mixed"], ["reflow", "ocr", "fixed"], ["PASS", "WARN", "FAIL"]
NAMES = ["Book.PDF", "book.azw3", "a.mobi", "b.epub", "c.kfx", "d.pdf", "e.txt"]


def engine_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which engine, whether the local one is skipped, and whether an existing text layer stays."""
    n, i = F.col("n_chars"), F.col("doc_id")
    rows = _docs(spark, d).withColumn("engine", gates.engine(_pick(ENGINES, i), i % 3 != 0, n % 2 == 0))
    keep = gates.keep_layer(_pick(KINDS, n), n, (i % 2 + 1), F.when(i % 4 < 3, "existing").otherwise("fresh"), n % 50, i % 30)
    return rows.select("doc_id", "engine", gates.skip_local(F.col("engine"), (n % 40 + 60).cast("double")).alias("skips_local"), keep.alias("keeps_layer"), gates.backoff((i % 6).cast("double")).alias("backoff"))


def output_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which outputs, fonts and headings a book gets, and which of its outputs is recommended."""
    n, i = F.col("n_chars"), F.col("doc_id")
    sizes = F.when(i % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array((n * 1000).cast("long"), F.lit(300_000).cast("long")))
    rows = _docs(spark, d).withColumn("f", gates.font_check(sizes)).withColumn("rtl", D.document_language(_pick(["ar", "en", "bilingual"], i), (n % 100) / 100.0))
    return rows.select(
        "doc_id", "rtl", gates.wants_pdf(_pick(MODES, i), _pick(ROUTES, n), _pick(KINDS, i)).alias("wants_pdf"), gates.font_mode(_pick(["auto", "native", "preshape"], n), F.col("rtl")).alias("font_mode"),
        gates.heading_mode(i % 11).alias("heading_mode"), "f.embedded", "f.subset_suspected", gates.output_ok(n % 7 != 0, F.when(i % 5 == 0, None).otherwise(i % 5 != 1), F.col("f.subset_suspected")).alias("output_ok"),
        gates.recommended(_pick(GATES, n), i % 2 == 0, i % 3 == 0).alias("recommended"), D.scaled_up(n % 20, n, F.lit(10), i % 2 == 0).alias("scaled"), pages.is_pdf(_pick(NAMES, i)).alias("is_pdf"),
        D.label(F.col("lang"), D.OCR_LANGUAGE, F.lit("eng")).alias("ocr_language"), pages.converter_reason(i % 2 == 0, i % 3 == 0).alias("converter"),
    )


URLS = ["https://a.example.com/x", "HTTPS://B.example.com", "http://plain.example.com", "host.example.com", " ", "ftp://x.example.com", "https://"]
ANSWERS = ["401 Access denied", "Error 404", "getaddrinfo failed", "The read TIMED OUT", "429 quota", "Name or service not known", "else"]


def service_checks(spark: SparkSession, d: str) -> DataFrame:
    """Service addresses and what an error of the service means."""
    i = F.col("doc_id")
    return _docs(spark, d).select("doc_id", gates.endpoint(_pick(URLS, i)).alias("endpoint"), gates.connection_hint(_pick(ANSWERS, F.col("n_chars"))).alias("hint"))


HEADS = ["504B0304", "25504446", "434F4E54", "EA44524D494F4E", "00" * 60 + "424F4F4B4D4F4249", ""]


def format_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Do the first bytes of a file fit the extension of its name."""
    return _docs(spark, d).select("doc_id", gates.magic_ok(_pick(NAMES, F.col("doc_id")), F.unhex(_pick(HEADS, F.col("n_chars")))).alias("ok"))


def shown_values(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, durations and style sheets as they are shown."""
    n = F.col("n_chars")
    css = render.style_sheet(F.col("doc_id") % 2 == 0, F.lit("Amiri"), (n % 10) / 10.0 + 1)
    return _docs(spark, d).select("doc_id", T.format_bytes(n * n).alias("bytes"), T.format_duration(n / 3.0).alias("duration"), css.alias("css"))


def book_reports(spark: SparkSession, d: str) -> DataFrame:
    """What was done to a book, and its report of numbered sections."""
    n, i = F.col("n_chars"), F.col("doc_id")
    counts = {k: (F.col("doc_id") + at) % 3 for at, k in enumerate(("blank_pages_removed", "duplicate_pages_removed", "noisy_pages_cleaned", "running_heads_removed", "page_numbers_removed", "cross_page_merges"))}
    done = gates.actions({"skew_max": (n % 4) / 10.0, **counts})
    text = render.report([("Source", [F.concat(F.lit("pages: "), n.cast("string")), F.when(i % 2 == 0, F.lit("scanned"))]), ("Notes", [F.when(i % 5 == 0, F.lit("none"))]), ("Result", [_pick(GATES, i)])])
    return _docs(spark, d).select("doc_id", F.array_join(done, "; ").alias("actions"), text.alias("report"))


LOGS = ["Analyzing book", "Route: ocr", "Rendering + cleaning", "12 pages prepared", "Azure DI chunk 2/5", "Azure DI chunk", "Tesseract (6 threads)", "mean confidence 93.1", "Engine scores a b", "text -> 12 blocks", "Converting to AZW3", "also built epub", "optimized PDF", "Running QA", "QA gate PASS", "Done in 12 s", "nothing"]


def log_stages(spark: SparkSession, d: str) -> DataFrame:
    """What a line of the log tells of a job: its stage, a detail, and how far the stage is."""
    c = jobs.classify_log(_pick(LOGS, F.col("n_chars") + F.col("doc_id")))
    return _docs(spark, d).select("doc_id", c.alias("c")).select("doc_id", "c.stage", "c.detail", F.round("c.pct", 4).alias("pct"))


LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنه"
ISOLATED = "".join(shaping.joined_forms()[c]["isolated"] for c in LETTERS)


def folded_forms(spark: SparkSession, d: str) -> DataFrame:
    """Arabised texts in isolated presentation forms, with lam-alef as one form: folding gives the letters back."""
    ligature = shaping.joined_forms()["لا"]["isolated"]
    formed = F.translate(F.replace(A.arabised(F.col("text")), F.lit("لا"), F.lit(ligature)), LETTERS, ISOLATED)
    rows = _docs(spark, d).select("doc_id", formed.alias("formed"))
    return rows.select("doc_id", A.fold_presentation_forms(F.col("formed")).alias("text"), A.has_presentation_forms(F.col("formed")).alias("had_forms"))


def adapted_to_font(spark: SparkSession, d: str) -> DataFrame:
    """Lam-alef forms that a font lacks come apart into its letters; what it lacks besides is listed."""
    ligature = shaping.joined_forms()["لا"]["isolated"]
    covered = F.array(*[F.lit(c) for c in LETTERS])
    a = shaping.adapted(F.replace(A.arabised(F.col("text")), F.lit("لا"), F.lit(ligature)), covered)
    return _docs(spark, d).select("doc_id", a.alias("a")).select("doc_id", F.col("a.text").alias("text"), F.col("a.ligatures").alias("ligatures"), F.coalesce(F.array_join("a.missing", ""), F.lit("")).alias("missing"))


def text_scores_arabic(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(_docs(spark, d).select("doc_id", A.arabised(F.col("text")).alias("text")), ["doc_id"], arabic=True)


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Lines with boxes; two of three books have a running head, and one of two a running foot with its page."""
    n = F.col("line_no")
    head = (n % 20 == 0) & (F.col("doc_id") % 3 > 0)
    foot = (n % 20 == 19) & (F.col("doc_id") % 2 == 0)
    text = F.when(head, F.concat(F.lit("Book No. "), F.col("page_no").cast("string"))).when(foot, F.concat(F.lit("Part of page "), F.col("page_no").cast("string"))).otherwise(F.col("text"))
    return boxed(lines(_docs(spark, d).select("doc_id", "text"))).withColumn("text", text)


def _slots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The lines, and the running heads by their slot: the top edge lines and the bottom ones are counted apart."""
    rows = _headed(spark, d)
    edges = rows.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("y0", "y1", "text")).alias("l"))
    slots = F.explode(F.array(F.struct(F.lit("top").alias("slot"), T.edge_line(F.col("l"), F.lit(PAGE_HEIGHT)).alias("text")), F.struct(F.lit("bottom").alias("slot"), T.edge_line(F.col("l"), F.lit(PAGE_HEIGHT), last=True).alias("text"))))
    pages_of = _docs(spark, d).select("doc_id", (F.floor((F.size(F.split("text", "\n")) - 1) / 20) + 1).alias("n_pages"))
    return rows, D.running_heads(edges.select("doc_id", slots.alias("s")).select("doc_id", "s.slot", "s.text"), "doc_id", pages_of)


def running_heads_by_slot(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d)[1]


def lines_without_edge_heads(spark: SparkSession, d: str) -> DataFrame:
    """Lines without the union of both slots' keys, wherever they stand."""
    return D.without_running_heads(*_slots(spark, d), "doc_id").select("doc_id", "line_no", "page_no", "text")


def column_order_rtl(spark: SparkSession, d: str) -> DataFrame:
    rows = boxed(lines(_docs(spark, d).select("doc_id", "text")))
    text = F.when((F.col("line_no") % 13 == 6) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("Chapter "), F.floor(F.col("line_no") / 26).cast("string"), F.lit(" of the book"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("x0", (F.col("line_no") % 3) * 200.0).withColumn("x1", F.col("x0") + F.length("text") % 50)
    return layout.order_lines(rows, ["doc_id", "page_no"], (F.col("doc_id") % 3 + 1).cast("int"), rtl=True).select("doc_id", "page_no", "line_no", "column", "reading_no")


def paragraph_islands_rtl(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of arabised lines, whose layout is read from the right."""
    rows = boxed(lines(_docs(spark, d).select("doc_id", "text")))
    text = F.when((F.col("line_no") % 13 == 6) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("Chapter "), F.floor(F.col("line_no") / 26).cast("string"), F.lit(" of the book"))).otherwise(A.arabised(F.col("text")))
    kinds = layout.classified(rows.withColumn("text", text), "doc_id", PAGE_HEIGHT, "conservative")
    return layout.paragraph_ids(kinds, "doc_id", ["page_no", "line_no"], rtl=True).select("doc_id", "line_no", "flush", "para")


QUERIES = {
    f.__name__: f
    for f in (
        engine_decisions, output_decisions, service_checks, format_signatures, shown_values, book_reports, log_stages, folded_forms, adapted_to_font, text_scores_arabic, running_heads_by_slot,
        lines_without_edge_heads, column_order_rtl, paragraph_islands_rtl,
    )
}

# ---- SQL
_ENGINE = f"CASE WHEN {_list(ENGINES, 'doc_id')} IN ('azure', 'auto', 'cloud') AND doc_id % 3 <> 0 AND n_chars % 2 = 0 THEN 'cloud' ELSE 'local' END"
_ACTIONS = ", ".join(f"CASE WHEN (doc_id + {i}) % 3 > 0 THEN ((doc_id + {i}) % 3) || ' {k}' END" for i, k in enumerate(("blank pages removed", "duplicate pages removed", "noisy pages cleaned", "running heads removed", "page numbers removed", "cross page merges")))
_TOLD = {
    "Analyzing book": ("analyze", None, 0.05), "Route: ocr": ("analyze", None, 1.0), "Rendering + cleaning": ("clean", None, 0.05), "12 pages prepared": ("clean", None, 1.0), "Azure DI chunk 2/5": ("ocr", "Azure AI · chunk 2 of 5", 0.32), "Azure DI chunk": ("ocr", "Azure AI", 0.1),
    "Tesseract (6 threads)": ("ocr", "Offline OCR", 0.85), "mean confidence 93.1": ("ocr", None, 1.0), "Engine scores a b": ("ocr", "Comparing engines", 0.95), "text -> 12 blocks": ("extract", None, 1.0), "Converting to AZW3": ("typography", None, 1.0), "also built epub": ("build", "Extra editions", 0.6),
    "optimized PDF": ("build", "Kindle PDF", 0.85), "Running QA": ("qa", None, 0.3), "QA gate PASS": ("qa", None, 0.9), "Done in 12 s": ("qa", None, 1.0),
}
_LOG_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in (line, *told)) + ")" for line, told in _TOLD.items())
_SIGNS = "CASE lower(split_part(name, '.', -1)) WHEN 'azw3' THEN substr(head, 121, 16) = '424F4F4B4D4F4249' WHEN 'mobi' THEN substr(head, 121, 16) = '424F4F4B4D4F4249' WHEN 'epub' THEN substr(head, 1, 4) = '504B' WHEN 'pdf' THEN substr(head, 1, 8) = '25504446' WHEN 'kfx' THEN substr(head, 1, 8) = '434F4E54' OR substr(head, 1, 14) = 'EA44524D494F4E' END"
_AR = f"translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{LETTERS}')"
_ENDPOINTS = ["https://a.example.com/x", "https://B.example.com", None, "https://host.example.com", None, None, None]
_HINTS = ["check the key", "check the address", "the host name is not known", "the service does not answer", "too many requests", "the host name is not known", "see the message"]
_HEADED = BOXED + ", hd AS (SELECT * REPLACE (CASE WHEN line_no % 20 = 0 AND doc_id % 3 > 0 THEN 'Book No. ' || page_no WHEN line_no % 20 = 19 AND doc_id % 2 = 0 THEN 'Part of page ' || page_no ELSE text END AS text) FROM bx)"
_SLOTS = _HEADED + rf""", sl AS (SELECT doc_id, page_no, line_no, y0, y1, regexp_replace(text, '^{S}+|{S}+$', '', 'g') AS t FROM hd),
ed AS (SELECT doc_id, 'top' AS slot, page_no, CASE WHEN y0 < 280.0 * 0.09 THEN t END AS t FROM (SELECT * FROM sl WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, t) = 1)
 UNION ALL SELECT doc_id, 'bottom', page_no, CASE WHEN y0 > 280.0 * 0.91 THEN t END FROM (SELECT * FROM sl WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0 DESC, t DESC) = 1)),
np AS (SELECT doc_id, max(page_no) + 1 AS n_pages FROM pl GROUP BY 1),
rh AS (SELECT doc_id, slot, lower(regexp_replace(t, '\p{{Nd}}+', '#', 'g')) AS key, count(*) AS n FROM ed WHERE t IS NOT NULL GROUP BY ALL),
hs AS (SELECT doc_id, slot, key, n FROM rh JOIN np USING (doc_id) WHERE key <> '' AND length(key) <= 90 AND n >= greatest(3.0, n_pages * 0.25))"""


def _rtl_paras() -> str:
    ltr = r"(x0 > l + h * 0.9 OR bx1 < r - h * 1.6)"
    at = _PARAS.index(ltr)
    rtl = _PARAS[:at] + "(x1 < r - h * 0.9 OR bx0 > l + h * 1.6)" + _PARAS[at + len(ltr) :].replace(r"regexp_matches(t, '^\p{Ll}')", r"NOT regexp_matches(t, '^\p{Lu}') AND length(t) > 0", 1)
    return rtl.replace("of the book' ELSE text END AS text) FROM bx)", f"of the book' ELSE {_AR} END AS text) FROM bx)", 1)


SQL = {
    "engine_decisions": f"SELECT doc_id, {_ENGINE} AS engine, {_ENGINE} = 'cloud' AND n_chars % 40 + 60 >= 90 AS skips_local, {_list(KINDS, 'n_chars')} = 'text_over_scan' AND n_chars > 500 AND doc_id % 2 = 0 AND doc_id % 4 < 3 AND n_chars % 50 >= doc_id % 30 + 8 AS keeps_layer, least(4 * pow(2.0, doc_id % 6), 45.0)::DOUBLE AS backoff FROM documents",
    "output_decisions": f"""WITH b AS (SELECT *, {_list(["ar", "en", "bilingual"], "doc_id")} IN ('ar', 'bilingual') AND (n_chars % 100) / 100.0::DOUBLE >= 0.35 AS rtl, doc_id % 4 <> 0 AND least(n_chars * 1000, 300000) < 200000 AS sub FROM documents)
SELECT doc_id, rtl, CASE {_list(MODES, "doc_id")} WHEN 'always' THEN true WHEN 'auto' THEN {_list(ROUTES, "n_chars")} = 'fixed' OR {_list(KINDS, "doc_id")} <> 'text' ELSE false END AS wants_pdf, CASE {_list(["auto", "native", "preshape"], "n_chars")} WHEN 'auto' THEN CASE WHEN rtl THEN 'preshape' ELSE 'native' END WHEN 'native' THEN 'native' ELSE 'preshape' END AS font_mode,
CASE WHEN doc_id % 11 >= 5 THEN 'conservative' ELSE 'ocr' END AS heading_mode, doc_id % 4 <> 0 AS embedded, sub AS subset_suspected, n_chars % 7 <> 0 AND doc_id % 5 <> 1 AND NOT sub AS output_ok, CASE WHEN {_list(GATES, "n_chars")} = 'FAIL' AND doc_id % 2 = 0 THEN 'azw3_fixed' WHEN doc_id % 3 = 0 THEN 'kfx' ELSE 'azw3' END AS recommended,
CASE WHEN doc_id % 2 = 0 THEN trunc((n_chars % 20) * (n_chars / 10.0::DOUBLE))::BIGINT ELSE n_chars % 20 END AS scaled, doc_id % 7 IN (0, 5) AS is_pdf, CASE lang WHEN 'ar' THEN 'ara' ELSE 'eng' END AS ocr_language, CASE WHEN doc_id % 6 = 0 THEN 'ready' WHEN doc_id % 2 = 0 THEN 'plugin missing' WHEN doc_id % 3 = 0 THEN 'previewer missing' ELSE 'both tools missing' END AS converter FROM b""",
    "service_checks": f"SELECT doc_id, [{', '.join('NULL' if x is None else repr(x) for x in _ENDPOINTS)}][doc_id % 7 + 1] AS endpoint, {_list(_HINTS, 'n_chars')} AS hint FROM documents",
    "format_signatures": f"WITH b AS (SELECT doc_id, {_list(NAMES, 'doc_id')} AS name, {_list(HEADS, 'n_chars')} AS head FROM documents) SELECT doc_id, {_SIGNS} AS ok FROM b",
    "shown_values": "WITH b AS (SELECT doc_id, n_chars * n_chars AS b, round(n_chars / 3.0::DOUBLE)::INT AS s, n_chars % 10 AS h FROM documents) SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.0f KB', b / 1024.0::DOUBLE) ELSE printf('%.1f MB', b / 1048576.0::DOUBLE) END AS bytes, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS duration, 'body { direction: ' || CASE WHEN doc_id % 2 = 0 THEN 'rtl' ELSE 'ltr' END || '; font-family: \"Amiri\"; line-height: ' || CASE WHEN h = 0 THEN '1.00' ELSE '1.' || h || '0' END || '; }' || chr(10) || 'p.first { text-indent: 0; }' || chr(10) || 'p.fn { font-size: 0.8em; }' || chr(10) AS css FROM b",
    "book_reports": f"WITH a AS (SELECT *, list_filter([CASE WHEN n_chars % 4 >= 2 THEN 'straightened pages' END, {_ACTIONS}], lambda x: x IS NOT NULL) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, '; ') ELSE 'nothing needed mending' END AS actions, '1. Source' || chr(10) || 'pages: ' || n_chars || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'scanned' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '2. Notes' || chr(10) || 'none' ELSE '' END || chr(10) || chr(10) || '3. Result' || chr(10) || {_list(GATES, 'doc_id')} AS report FROM a",
    "log_stages": f"WITH r(line, stage, detail, pct) AS (VALUES {_LOG_ROWS}), d AS (SELECT doc_id, {_list(LOGS, '(n_chars + doc_id)')} AS line FROM documents) SELECT doc_id, stage, detail, round(pct, 4) AS pct FROM d LEFT JOIN r USING (line)",
    "folded_forms": f"SELECT doc_id, {_AR} AS text, regexp_matches({_AR}, '[{LETTERS}]') AS had_forms FROM documents",
    "adapted_to_font": rf"WITH a AS (SELECT doc_id, {_AR} AS t FROM documents) SELECT doc_id, t AS text, ((length(t) - length(replace(t, 'لا', ''))) // 2)::INT AS ligatures, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[^{LETTERS}\s]')))[1:10], ''), '') AS missing FROM a",
    "text_scores_arabic": f"WITH {ARABISED}, " + _score_sql("ar", "doc_id").replace("[A-Za-z]{2,}", r"[\x{0621}-\x{064A}]{2,}").replace("WHEN word IN (" + ", ".join(f"'{w}'" for w in scoring.ENGLISH_FUNCTION) + ")", "WHEN word IN (" + ", ".join(f"'{w}'" for w in scoring.ARABIC_FUNCTION) + ")") + " SELECT * FROM scored",
    "running_heads_by_slot": f"WITH {_SLOTS} SELECT doc_id, slot, key, n FROM hs",
    "lines_without_edge_heads": rf"WITH {_SLOTS}, ky AS (SELECT *, lower(regexp_replace(regexp_replace(text, '\p{{Nd}}+', '#', 'g'), '^{S}+|{S}+$', '', 'g')) AS key FROM hd) SELECT doc_id, line_no, page_no, text FROM ky ANTI JOIN hs USING (doc_id, key)",
    "column_order_rtl": _BOOKS["column_order"].replace("ELSE coalesce(len(list_filter(cuts, lambda z: c > z)), 0) END", "ELSE n - 1 - coalesce(len(list_filter(cuts, lambda z: c > z)), 0) END"),
    "paragraph_islands_rtl": f"WITH {_rtl_paras()} SELECT doc_id, line_no, flush, para FROM pa",
}
