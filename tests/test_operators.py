"""Operators on literal rows: routes, gates, jobs, layout, readers, planes and streams."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import document as D
from quire.operators import gates, imaging, jobs, layout, ocr, pages, render
from quire.sources import files, views
from quire.streaming import progress


def lit1(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("kind", "columns", "want"), [("text", 1, "reflow"), ("text", 3, "fixed"), ("scanned", 1, "ocr"), ("text_over_scan", 1, "ocr"), ("mixed", 1, "ocr")])
def test_routes(spark, kind, columns, want):
    r = lit1(spark, D.route(F.lit(kind), F.lit(columns), F.lit(0.98)))
    assert r["route"] == want
    if want == "reflow":
        assert "98%" in r["reason"]


@pytest.mark.parametrize(("recall", "ratio", "ok", "subset", "want"), [(0.99, 1.0, True, False, "PASS"), (0.8, 1.0, True, False, "WARN"), (0.6, 1.0, True, False, "FAIL"), (0.9, 0.5, True, False, "FAIL"), (0.9, 0.0, True, False, "PASS"), (None, 0.1, True, False, "PASS"), (0.99, 1.0, False, False, "FAIL"), (0.99, 1.0, None, True, "FAIL")])
def test_gate(spark, recall, ratio, ok, subset, want):
    assert lit1(spark, gates.quality_gate(F.lit(recall).cast("double"), F.lit(ratio), F.lit(ok).cast("boolean"), F.lit(subset))) == want


def test_scores_and_badges(spark):
    def score(gate, conf, recall, subset=False, review=0, pages=100):
        return lit1(spark, gates.quality_score(F.lit(gate), F.lit(conf), F.lit(recall), F.lit(True), F.lit(subset), F.lit(review), F.lit(pages)))

    assert score("PASS", 95.0, 0.99) >= 90 and score("PASS", 95.0, 0.99, subset=True) < 85 and score("FAIL", 95.0, 0.6) < 70
    assert all(0 <= score(g, 0.0, 0.0, True, 100) <= 100 for g in ("PASS", "WARN", "FAIL"))
    assert lit1(spark, gates.badge(F.lit("PASS"), F.lit(0), F.lit(95))) == "Excellent"
    assert lit1(spark, gates.confidence_verdict(F.lit(70.0), F.lit("ara"))) == "marginal"


def test_small_rules(spark):
    assert lit1(spark, gates.endpoint(F.lit(" HTTPS://Host/x"))) == "https://Host/x" and lit1(spark, gates.endpoint(F.lit("http://x"))) is None and lit1(spark, gates.endpoint(F.lit("x.example"))) == "https://x.example"
    assert lit1(spark, gates.magic_ok(F.lit("a.PDF"), F.lit(bytearray(b"%PDF-1.7")))) and lit1(spark, gates.magic_ok(F.lit("a.txt"), F.lit(bytearray(b"x")))) is None
    assert lit1(spark, gates.backoff(F.lit(10))) == 45.0
    assert lit1(spark, D.sampled_pages(F.lit(5), 14)) == [0, 1, 2, 3, 4]
    assert lit1(spark, D.forced(F.lit("ocr"), F.lit("auto"))) == "ocr" and lit1(spark, D.forced(F.lit("ocr"), F.lit("fixed"))) == "fixed"
    assert lit1(spark, render.navigation(F.lit(None).cast("array<struct<title:string,page:int>>"), F.lit(30)))[1]["title"] == "Page 26"
    assert lit1(spark, render.report([("A", [F.lit("x"), F.lit(None).cast("string")]), ("B", [F.lit(None).cast("string")])])) == "1. A\nx"


def test_jobs(spark):
    assert abs(sum(views.WEIGHTS) - 1) < 1e-9
    c = lit1(spark, jobs.classify_log(F.lit("Azure DI chunk 2/4")))
    assert (c["stage"], c["pct"]) == ("ocr", 0.4)
    assert lit1(spark, jobs.classify_log(F.lit("-> 12 blocks")))["stage"] == "extract" and lit1(spark, jobs.classify_log(F.lit("hello")))["stage"] is None
    m = spark.createDataFrame([(1, 1, 0, 1.0), (1, 2, 2, 0.5), (1, 3, 0, 0.0), (1, 4, 6, 1.0)], "job int, seq int, stage_idx int, pct double")
    got = [r["overall"] for r in jobs.progress(m).orderBy("seq").collect()]
    assert got == sorted(got) and got[-1] == 1.0
    q = spark.createDataFrame([(1, 0, 10), (2, 3, 5), (3, 100, 1)], "job int, submitted long, seconds long")
    assert [(r["job"], r["started"], r["ended"]) for r in jobs.queue_times(q).orderBy("job").collect()] == [(1, 0, 10), (2, 10, 15), (3, 100, 101)]


def test_blocks_and_bookmarks(spark):
    rows = spark.createDataFrame(
        [(1, 1, "para", "A paragraph that is cut in the", 0, 0), (1, 2, "para", "middle of it.", 1, 0), (1, 3, "heading", "Chapter One", 2, 1), (1, 4, "heading", "Chapter One: The Start", 2, 1), (1, 5, "para", "Second part begins here", 3, 0), (1, 6, "para", "End.", 5, 0)],
        "doc_id int, block_no int, kind string, text string, page int, level int",
    )
    merged = [r["text"] for r in layout.merge_across_pages(rows, "doc_id").orderBy("block_no").collect()]
    assert merged[0] == "A paragraph that is cut in the middle of it." and len(merged) == 5
    assert [r["text"] for r in layout.dedupe_headings(rows, "doc_id").where("kind = 'heading'").collect()] == ["Chapter One: The Start"]
    marks = spark.createDataFrame([(1, 1, 1, "Second part", 3), (1, 2, 1, "Chapter one", 1), (1, 3, 2, "Epilogue", 4), (1, 4, 1, "Beyond", 9)], "doc_id int, ordinal int, level int, title string, page int")
    got = [(r["kind"], r["text"]) for r in layout.with_bookmarks(rows, marks, "doc_id").orderBy("block_no").collect()]
    assert ("heading", "Second part begins here") in got and got.index(("heading", "Epilogue")) == len(got) - 2 and "Beyond" not in str(got) and sum(t.startswith("Chapter") for _, t in got) == 1


def test_ocr(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t10\t20\t8\t90.5\tHello\n5\t1\t1\t1\t1\t2\t40\t9\t30\t10\t80\t\"world\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t2\t1\t0\t0\t9\t9\tx\tbad\n")
    words = files.ocr_words(spark, str(tmp_path / "w.tsv"))
    line = ocr.lines(words, ["page_num"], "text", "word_num").collect()
    assert [(r["text"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in line] == [('Hello "world', 10, 9, 70, 19)]
    assert ocr.page_summary(words, ["page_num"]).first()["words"] == 2


def test_readers(spark, tmp_path):
    answer = {"pages": [{"pageNumber": 1, "unit": "inch", "lines": [{"content": "hi", "polygon": [1, 2, 3, 2, 3, 4, 1, 4]}, {"content": " ", "polygon": [0, 0]}], "words": [{"content": "hi", "confidence": 0.9}]}]}
    rows = spark.createDataFrame([(1, json.dumps(answer))], "id int, j string")
    got = files.layout_lines(rows, "j", ["id"]).collect()
    assert [(r["text"], r["x0"], r["y1"]) for r in got] == [("hi", 72.0, 288.0)] and files.layout_confidence(rows, "j", ["id"]).first()["mean_conf"] == 90.0
    msgs = files.parsed(spark.createDataFrame([('{"id": "a", "event": "stage"}',), ("",), ("nonsense",), ("[1]",)], "value string")).collect()
    assert [(m["msg"] and m["msg"]["id"], m["error"]) for m in msgs] == [("a", None), (None, "BAD_REQUEST"), (None, "BAD_REQUEST")]
    assert lit1(spark, files.key_values(F.array(F.lit("Title: A: b"), F.lit("x"), F.lit("title : C")))) == {"title": "C"}
    new = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit(" "), F.lit("c"), F.lit(" z "))
    assert lit1(spark, files.merged_settings(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), new)) == {"a": "1", "c": "z"}
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("content.opf", "x")
        z.writestr("nav.xhtml", "x")
        z.writestr("i.png", "x")
    (tmp_path / "bad.epub").write_text("no archive")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(str(tmp_path))
    s = files.archive_summary(files.archive_entries(found)).collect()
    assert len(s) == 1 and s[0]["has_opf"] and s[0]["has_nav"] and s[0]["images"] == 1
    assert files.magic_heads(spark, str(tmp_path), "b.epub").select(gates.magic_ok(F.col("path"), F.col("head"))).first()[0]
    files.write_records(rows, str(tmp_path / "out"), ["j"])
    assert spark.read.json(str(tmp_path / "out")).collect()[0].asDict() == {"id": 1}


def test_planes(spark):
    g = np.full((200, 160), 255, np.uint8)
    for y in range(20, 180, 12):
        g[y : y + 4, 10:65] = 0
        g[y : y + 4, 95:150] = 0
    assert imaging.columns(g) == 2 and abs(imaging.skew(g)) < 0.11
    assert abs(imaging.skew(imaging.rotated(g, 2.0)) + 2.0) < 0.3 or abs(imaging.skew(imaging.rotated(g, 2.0)) - 2.0) < 0.3
    box = imaging.content_box(g)
    assert abs(box[0] - 10) <= 2 and abs(box[2] - 150) <= 2
    assert set(np.unique(imaging.quantised(g))) == {8, 248} and imaging.fitted(g, 100, 100).shape == (100, 100)
    assert imaging.page_signature(g) == imaging.page_signature(np.clip(g, 5, 250)) and len(imaging.components(np.array([[1, 0], [0, 1]], bool))) == 1
    rows = spark.createDataFrame([(1, (bytearray(g.tobytes()), 200, 160)), (2, None)], f"id int, p {imaging.PLANE}")
    m = {r["id"]: r for r in imaging.measured(rows, "p").collect()}
    assert m[1]["columns"] == 2 and m[2]["columns"] is None
    c = {r["id"]: r["c"] for r in imaging.on_planes(rows, "p", imaging.cleaned, "c").collect()}
    assert c[2] is None and c[1]["height"] <= 200
    assert imaging.noise(np.full((30, 30), 200, np.uint8))["components"] in (0, 1)


def _drain(spark, tmp_path, stream, name):
    progress.run_all(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / f"{name}-out"))


def _feed(spark, tmp_path, name, batches, schema):
    """A stream of a file for each batch, in order."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        if i + 1 < len(batches):
            time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_job_board_keeps_state_between_triggers(spark, tmp_path):
    schema = "engine_id string, seq long, ts timestamp, kind string, job string, detail string"
    from datetime import datetime as dt

    t = dt(2026, 1, 1, 10)
    s = _feed(spark, tmp_path, "m", [[("e1", 1, t, "stage", None, "early"), ("e2", 1, t, "attach", "j2", None)], [("e1", 2, t, "attach", "j1", None), ("e2", 2, t, "dismiss", None, None)], [("e1", 3, t, "stage", None, "late"), ("e2", 3, t, "stage", None, "lost")]], schema)
    got = sorted((r["job"], r["seq"], r["detail"]) for r in _drain(spark, tmp_path, progress.job_board(s), "board").collect())
    assert got == [("j1", 1, "early"), ("j1", 3, "late")]


def test_replies_within_an_hour(spark, tmp_path):
    from datetime import datetime as dt

    q = _feed(spark, tmp_path, "q", [[("a", dt(2026, 1, 1, 10), "convert"), ("b", dt(2026, 1, 1, 10), "convert")]], "id string, ts timestamp, method string")
    a = _feed(spark, tmp_path, "a", [[("a", dt(2026, 1, 1, 10, 30), "ok"), ("b", dt(2026, 1, 1, 11, 30), "late")]], "id string, ts timestamp, result string")
    assert [(r["id"], r["result"]) for r in _drain(spark, tmp_path, progress.replies(q, a), "r").collect()] == [("a", "ok")]


def test_windows_and_duplicates(spark, tmp_path):
    from datetime import datetime as dt

    rows = [(i // 2, dt(2026, 1, 1, i // 4, 10), 1, "view", 1.0, "{}") for i in range(40)]
    s = _feed(spark, tmp_path, "e", [rows], progress.EVENTS)
    assert _drain(spark, tmp_path, progress.live_only(s), "live").count() == 20
    s = _feed(spark, tmp_path, "e2", [rows], progress.EVENTS)
    assert {r["n"] for r in _drain(spark, tmp_path, progress.windows(s), "win").collect()} == {4}
    s = _feed(spark, tmp_path, "e3", [rows], progress.EVENTS)
    assert _drain(spark, tmp_path, progress.sessions(s), "ses").count() > 0


def test_pages_from_parts(spark):
    blocks = [([([10.0, 20.0, 90.0, 30.0], [("Big ", 14.0, 16, "Serif"), ("text", 12.0, 0, "Serif-Bold")]), ([0.0, 0.0, 1.0, 1.0], [("  ", 9.0, 0, "Serif")])],)]
    df = spark.createDataFrame([(1, blocks)], f"page_no int, blocks array<struct<lines:array<struct<bbox:array<double>,spans:array<{pages.SPAN}>>>>>")
    got = pages.lines_from_spans(df, ["page_no"]).collect()
    assert [(r["text"], r["x1"], r["size"], r["bold"], r["fonts"]) for r in got] == [("Big text", 90.0, 13.0, True, ["Serif", "Serif-Bold"])]
    im = spark.createDataFrame([(1, 5, 0.0, 0.0, 100.0, 100.0, 50000.0, 300), (1, 5, 0.0, 200.0, 100.0, 300.0, 50000.0, 300), (1, 6, 0.0, 0.0, 30.0, 100.0, 50000.0, 10)], "page_no int, xref int, x0 double, y0 double, x1 double, y1 double, page_area double, width_px int")
    assert pages.figures(im, ["page_no"]).count() == 1 and pages.image_measures(im, ["page_no"]).first()["dpi"] == 216.0
    assert lit1(spark, pages.wrapped(F.lit("aa bb cc dddddddd e"), 5)) == "aa bb\ncc\ndddddddd\ne"
    meta = spark.createDataFrame([(1, {"title": "x.pdf"}, "my_book"), (2, {"title": "A Title", "author": " "}, "s")], "id int, meta map<string,string>, stem string")
    heads = spark.createDataFrame([(1, 2, "heading", "The Heading")], "id int, block_no int, kind string, text string")
    assert {r["id"]: (r["title"], r["author"]) for r in pages.guessed_meta(F.col("meta"), heads, "id", meta, "stem").collect()} == {1: ("The Heading", "Unknown"), 2: ("A Title", "Unknown")}


def test_confidence_adds_in_page_order(spark):
    """Means of tenths are often ties: they are added in page order and rounded as binary numbers, however rows arrive."""
    import random
    from math import floor

    r = random.Random(7)
    pages = [(d, p, r.randint(500, 900) / 10) for d in range(300) for p in range(d % 9 + 1)]
    rows = spark.createDataFrame(r.sample(pages, len(pages)), "doc_id int, page_no int, conf double").repartition(5)
    half_up = lambda x, digits: floor(x * 10.0**digits + 0.5) / 10.0**digits
    by_doc = {d: [c for e, _, c in pages if e == d] for d in range(300)}
    want = {}
    for d, cs in by_doc.items():
        total = 0.0
        for c in cs:
            total += c
        want[d] = total / len(cs)
    got = {x["doc_id"]: x["mean_conf"] for x in ocr.chunk_confidence(rows, "doc_id", "page_no", 1).collect()}
    assert got == {d: half_up(x, 1) for d, x in want.items()}
    summary = rows.select("doc_id", "page_no", F.lit(6).alias("words"), F.col("conf").alias("mean_conf"))
    assert {x["doc_id"]: x["mean_conf"] for x in ocr.document_confidence(summary, "doc_id").collect()} == {d: half_up(x, 6) for d, x in want.items()}
    few = ocr.document_confidence(summary.withColumn("words", F.lit(5)), "doc_id")
    assert {x["mean_conf"] for x in few.collect()} == {0.0}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


SMALL = "/root/testdata/sf0.001"


def test_visual_order_judges_all_lines(spark, tmp_path):
    """A line of many other letters is judged as its SQL judges it."""
    from quire.plans import books

    spark.createDataFrame([(1, "é" * 100 + "\nab")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r["line_no"], r["restored"], r["reversed"]) for r in books.visual_order(spark, str(tmp_path)).collect()} == {(0, True, True), (1, True, True)}


def test_ratios_read_a_text_once(spark):
    from quire.plans import lines

    assert "regexp_count" not in _plan(lines.language_ratios(spark, SMALL))


def test_folding_and_fitting_take_no_text_apart(spark):
    """Neither makes an array of a text's characters."""
    from quire.plans import decisions

    for query in (decisions.folded_forms, decisions.adapted_to_font):
        assert "(?s)." not in _plan(query(spark, SMALL))


def test_blocks_are_folded_without_a_frame_for_each_document(spark):
    from quire.plans import books

    for query in (books.merged_blocks, books.deduped_headings):
        plan = _plan(query(spark, SMALL))
        assert "FlatMapGroupsInPandas" not in plan and plan.count("Generate ") == 1


def test_folds_across_batches(spark):
    """A batch of one row each: the last block waits for the next batch."""
    rows = spark.createDataFrame([(d, i, k, t, p, 1) for d in (1, 2) for i, (k, t, p) in enumerate([("heading", "The End", 0), ("heading", "the end.", 0), ("para", "a paragraph that goes on with-", 0), ("para", "out a stop", 1), ("para", "and no more", 2), ("para", "", 3)], 1)], "doc_id int, block_no int, kind string, text string, page int, level int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        merged = [tuple(r) for r in layout.merge_across_pages(rows, "doc_id").orderBy("doc_id", "block_no").collect()]
        heads = [tuple(r) for r in layout.dedupe_headings(rows, "doc_id").orderBy("doc_id", "block_no").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert merged == [(d, i, *x) for d in (1, 2) for i, x in enumerate([("heading", "The End", 0, 1), ("heading", "the end.", 0, 1), ("para", "a paragraph that goes on without a stop", 0, 1), ("para", "and no more", 2, 1), ("para", "", 3, 1)], 1)]
    assert [x[:4] for x in heads if x[2] == "heading"] == [(d, 1, "heading", "The End") for d in (1, 2)] and len(heads) == 10


def test_bookmarks_read_blocks_that_are_made_once(spark):
    from quire.plans import books

    assert "posexplode" not in _plan(books.book_with_bookmarks(spark, SMALL))


def test_words_of_a_line_are_not_shuffled(spark, tmp_path):
    """Only ids that several rows share bring words together; their lines come out as from one text."""
    from quire.plans import lines

    assert "Aggregate" not in _plan(lines.ocr_lines(spark, SMALL))
    spark.createDataFrame([(1, "a b\nc"), (2, "d  e\n\n"), (1, "\n\nf")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_num"]): (r["text"], r["x0"], r["x1"], r["y0"], r["size"]) for r in lines.ocr_lines(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): ("a b", 0, 36, 0, 11), (1, 1): ("c", 0, 6, 14, 11), (1, 2): ("f", 0, 6, 28, 11), (2, 0): ("d e", 0, 36, 0, 11)}


def test_a_stream_is_written_by_many_tasks(spark):
    """A job's rows of a slice are in one file, and slices are in several."""
    from quire.plans import streams

    rows = spark.range(60).selectExpr("id % 6 as job", "id div 6 + 1 as seq", "1 as stage_idx", "0.5D as pct")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = streams._stream(spark, rows, "many")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    path = stream._jdf.queryExecution().analyzed().toString()
    assert stream.isStreaming and path
    done = streams._drained(spark, progress.running_progress(stream), "many-done")
    assert done.count() == 60


def test_overall_rounds_as_sql(spark):
    """Stages start at 0.82, not at a sum of weights just above, and what is rounded is the binary number."""
    from math import floor

    starts = [0.0, 0.13, 0.26, 0.78, 0.82, 0.85, 0.94]
    rows = spark.range(70007).selectExpr("cast(id % 7 as int) as i", "(id div 7) / 10000D as p")
    rows = rows.select("i", "p", jobs.overall(F.col("i"), F.col("p")).alias("x")).collect()
    assert all(r["x"] == floor(min(1.0, starts[r["i"]] + views.WEIGHTS[r["i"]] * r["p"]) * 10000.0 + 0.5) / 10000.0 for r in rows)
