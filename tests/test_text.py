"""Scalars and small operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from quire.functions import arabic as A
from quire.functions import correction, scoring, shaping
from quire.functions import text as T
from quire.operators import render

SENTENCE = "في هذا الكتاب العربية كان من قبل الذي على المدرسة"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) and not isinstance(v, bool) else 'double' if isinstance(v, float) else 'boolean'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("ﻟ", "ل"), ("ﻻ", "لا"), ("﴾", "﴾"), ("plain", "plain"), ("", "")])
def test_folding(spark, raw, want):
    assert one(spark, A.fold_presentation_forms(F.col("t")), t=raw) == want


def test_presentation_forms(spark):
    assert one(spark, A.has_presentation_forms(F.col("t")), t="aﻟ")
    assert not one(spark, A.has_presentation_forms(F.col("t")), t="﴾ ﷽")
    assert one(spark, A.has_presentation_forms(F.col("t")), t="﻿")


def test_reversed_text_is_restored(spark):
    back = one(spark, A.reverse_clusters(F.col("t")), t=SENTENCE)
    fixed = one(spark, A.fix_visual_order(F.col("t")), t=back)
    assert fixed["text"] == SENTENCE and fixed["reversed"]
    kept = one(spark, A.fix_visual_order(F.col("t")), t=SENTENCE)
    assert kept["text"] == SENTENCE and not kept["reversed"]
    assert one(spark, A.clean_line(F.col("t"), allow_reversal=False), t=back)["text"] == back


def test_marks_stay_with_their_letters(spark):
    marked = "كِتَابٌ"
    back = one(spark, A.reverse_clusters(F.col("t")), t=marked)
    assert one(spark, A.mark_count(F.col("t")), t=back) == 3 and one(spark, A.reverse_clusters(F.col("t")), t=back) == marked
    assert one(spark, A.reverse_clusters(F.col("t")), t="abc") == "cba"


@pytest.mark.parametrize(("text", "want"), [(SENTENCE, "ar"), ("The quick brown fox", "en"), ("The quick brown fox " + SENTENCE, "bilingual"), ("", "en"), ("123", "en")])
def test_languages(spark, text, want):
    assert one(spark, A.classify_language(F.col("t")), t=text) == want


def test_clean_line(spark):
    r = one(spark, A.clean_line(F.col("t")), t="‫  كتـــاب \t عربي ‬")
    assert (r["text"], r["tatweel_removed"]) == ("كتاب عربي", 3)


def test_shaping_checks(spark):
    assert one(spark, A.validate_shaping(F.col("t")), t=SENTENCE)["ok"]
    assert one(spark, A.validate_shaping(F.col("t")), t="ﻟﻟﻟ")["issues"] == ["residual_presentation_forms"]
    assert one(spark, A.validate_shaping(F.col("t"), True), t="ﻟﻟﻟ")["ok"]
    assert one(spark, A.validate_shaping(F.col("t"), True), t=SENTENCE * 5)["issues"] == ["expected_preshaped_text_but_found_none"]


def test_preshaping(spark):
    shaped = one(spark, shaping.preshaped(F.col("t")), t="كتاب")
    assert shaped == "ﻛﺘﺎﺏ"
    assert one(spark, A.fold_presentation_forms(F.col("t")), t=shaped) == "كتاب"
    assert one(spark, shaping.preshaped(F.col("t")), t="سلام") == "ﺳﻼﻡ"
    assert one(spark, A.mark_count(shaping.preshaped(F.col("t"))), t="كِتَابٌ") == 0
    assert one(spark, shaping.preshaped(F.col("t")), t="plain") == "plain"


def test_adapted(spark):
    r = spark.sql("select 'ﻻ x' t, array('ل', 'ا') c").select(shaping.adapted(F.col("t"), F.col("c")).alias("x")).first()["x"]
    assert (r["text"], r["ligatures"], r["missing"]) == ("لا x", 1, ["x"])


def test_flattened(spark):
    cmap = spark.createDataFrame([(0x0644, "lam"), (0x0627, "alef"), (0x0628, "beh")], "code int, glyph string")
    subs = spark.createDataFrame([("init", "lam", "lam.i"), ("fina", "alef", "alef.f"), ("init", "beh", "beh.i")], "feature string, glyph string, to string")
    ligs = spark.createDataFrame([("lam.i alef.f", "lamalef")], "glyphs string, to string")
    got = {r["code"]: (r["glyph"], r["how"]) for r in shaping.flattened(cmap, subs, ligs).collect()}
    assert got[0xFE91] == ("beh.i", "added") and got[0xFEFB] == ("lamalef", "ligature") and got[0xFE8F] == ("beh", "added") and got[0xFE92][1] == "missing"


@pytest.mark.parametrize(("line", "want"), [("12", True), ("- iv -", True), ("I", True), ("civic", True), ("page 3", False), ("", False), ("1234567890123", False)])
def test_page_numbers(spark, line, want):
    assert one(spark, T.is_page_number(F.col("t")), t=line) is want


def test_keys_and_joins(spark):
    assert one(spark, T.repeat_key(F.col("t")), t="  Page 12١٢ of 9 ") == "page # of #"
    assert one(spark, T.join_lines(F.split("t", r"\|"), False), t="a long exam-|ple  of|| lines") == "a long example of lines"
    assert one(spark, T.clean_heading(F.col("t")), t=" 12. Title of it - 7") == "Title of it"
    assert one(spark, T.clean_heading(F.col("t")), t="1984") == "1984"
    assert one(spark, T.safe_name(F.col("t")), t="???") == "Book"
    assert one(spark, T.format_bytes(F.col("n")), n=2048) == "2 KB"
    assert one(spark, T.format_duration(F.col("s")), s=75.0) == "1m 15s"


def test_scores(spark):
    rows = spark.createDataFrame([(1, "the cat and the dog of the town and the cat in the town of the dog " * 6), (2, "x # q ~ z ^ k | " * 20), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: r["score"] for r in scoring.score(rows, ["id"]).collect()}
    assert got[1] > 80 > got[2] and got[3] == 0.0 and got[4] == 0.0
    c = one(spark, scoring.coverage(F.col("a"), F.col("b")), a="one two three three", b="one three")
    assert (c["source_tokens"], c["token_ratio"], c["vocab_recall"], c["lost"]) == (4, 0.5, 0.667, ["two"])
    assert one(spark, scoring.coverage(F.col("a"), F.col("b")), a="", b="x")["vocab_recall"] is None


def test_corrections(spark):
    rows = spark.createDataFrame([(1, "كتاب " * 30 + "كناب"), (2, "سبع " * 3 + "شبع " * 3)], "doc_id int, text string")
    fixes = correction.corrections(correction.lexicon(rows))
    assert [tuple(r) for r in fixes.collect()] == [("كناب", "كتاب")]
    got = {r["doc_id"]: (r["text"], r["n_corrected"]) for r in correction.corrected(rows, fixes).collect()}
    assert got[1] == ("كتاب " * 30 + "كتاب", 1) and got[2][1] == 0


@pytest.mark.parametrize(("n", "want"), [(1023, "1023 B"), (2560, "2 KB"), (3584, "4 KB"), (2359296, "2.2 MB"), (2463105, "2.3 MB"), (2883584, "2.8 MB")])
def test_sizes_between_two_steps(spark, n, want):
    """A size just between two steps takes the even one, as in SQL's printf."""
    assert one(spark, T.format_bytes(F.col("n")), n=n) == want


def test_nothing_is_shown_as_nothing(spark):
    null = F.lit(None).cast("bigint")
    row = spark.range(1).select(T.format_bytes(null).alias("b"), T.format_duration(null / 3.0).alias("d"), render.style_sheet(F.lit(True), F.lit("Amiri"), null / 10.0).alias("c")).first()
    assert row["b"] is None and row["d"] is None and row["c"] is None
