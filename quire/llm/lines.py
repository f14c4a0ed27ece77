"""Line de-duplication by a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of line ids (128-bit digests of the lines). Lines that occur once are no part of a
repeated run; they part a document into segments of repeated lines, and the array is of the suffixes of those.

Ranks. Round 0 sorts the distinct ids of repeated lines over the cluster; an id's place is its rank. Round k + 1 sorts the
distinct pairs (rank of p, rank of p + 2^k) and so ranks the suffixes by their first 2^(k + 1) lines. A pair that
occurs once has no common prefix of that length with any other suffix and leaves the array. Every sort is a range
partitioning of the distinct pairs, so no partition holds all of them, and ranks are places in it
(partition, place within it), which keep the order.

Depth. A repeated run counts from ``min_words`` words, and every line of a run that also occurs earlier (in the order of
id, text digest and line number; in another document or the same one) is deleted. The maximal runs of that kind together
cover the same lines as their least qualifying parts: for a suffix, its prefixes of n lines for those n at which the run
ends with line e and no later start reaches min_words by e. So the doubling goes on for a suffix only while such a prefix
is longer than what is ranked, and the rounds are few at any length of copies.

Intervals. The suffixes whose ranks at 2^k and, 2^k lines before the end of the prefix, again at 2^k are equal
share the prefix of n lines (2^k <= n < 2^(k + 1)): they are an interval of the longest-common-prefix array of depth n at
least. Its first place stays, the others are later copies. Grouped aggregations find the intervals, and joins that can
split a hot one bring the first place back.

Defined results: a null text stays null and has no lines; an empty text is one empty line; rows alike in id and text
get the same result, and neither is the other's earlier copy; rows that share only an id are documents of their own,
ordered by text digest; null ids come first; other columns stay as they are, whatever their names. A document all of
whose lines are deleted keeps an empty text (``remove_copies(..., drop_empty=True)`` drops it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import as_rows, discard, field, fields, settle, text_digest, word_count

MIN_WORDS = 50


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, i, h, w): key tells documents apart and orders them; i counts lines from 0; h is the line's id, w its words."""
    key = F.struct(field(id_col).alias("id"), text_digest(field(text_col)).alias("d"))
    rows = as_rows(docs).where(field(text_col).isNotNull()).select(key.alias("key"), F.posexplode(F.split(field(text_col), "\n")).alias("i", "line"))
    return rows.select("key", "i", text_digest(F.col("line")).alias("h"), word_count(F.col("line")).alias("w"))


def _ranked(values: DataFrame, what: str) -> DataFrame:
    """values, which are distinct, with their places r in a sort over the cluster."""
    by = values.columns
    return settle(values.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), what)


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """(seg, key, start, x): stretches of consecutive repeated lines, seg in the order of (key, start).

    x has for each line j its rank r, the lines n that its suffix needs for min_words words (null if it has fewer), and
    the greatest number of lines, most, at which a prefix of it counts.
    """
    ids = _ranked(lines.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h.a", "h.b"), "line-ranks")
    rows = lines.select("key", "i", "h.a", "h.b", "w").join(ids, ["a", "b"]).select("key", "i", "r", "w")
    # rows alike in id and text have one key and count once
    rows = rows.repartition("key").dropDuplicates(["key", "i"])
    order = Window.partitionBy("key").orderBy("i")
    rows = rows.select("key", "i", "r", "w", (F.col("i") - F.row_number().over(order)).alias("island"), F.sum(F.col("w").cast("long")).over(order).alias("words"))
    whole = rows.groupBy("key", "island").agg(F.sort_array(F.collect_list(F.struct("i", "r", "w", "words"))).alias("a"))
    first = F.get("a", F.lit(0))
    before = first["words"] - first["w"]
    whole = whole.where(F.element_at("a", -1)["words"] - before >= min_words)
    sums = F.concat(F.array(F.lit(0).cast("long")), F.transform("a", lambda x: x["words"] - before))
    whole = whole.select("key", first["i"].alias("start"), F.transform("a", lambda x: x["r"]).alias("r"), sums.alias("c"))
    m, c = F.size("r"), F.col("c")
    down = F.reverse(F.sequence(F.lit(0), F.length(F.bin(m))))

    def least(j: Column) -> Column:
        """As many lines as stay short of min_words words, then one more."""

        def longer(n: Column, k: Column) -> Column:
            to = j + n + _power(k)
            return F.when((to <= m) & (F.get(c, to) - F.get(c, j) < min_words), n + _power(k)).otherwise(n)

        n = F.aggregate(down, F.lit(0), longer) + 1
        return F.when(j + n <= m, n)

    whole = whole.withColumn("n", F.transform(F.sequence(F.lit(0), m - 1), least))
    at = F.transform("r", lambda r, j: F.struct(j.alias("j"), r.alias("r"), F.get("n", j).alias("n"), F.when(F.get("n", j).isNotNull(), F.greatest(F.get("n", j), F.coalesce(F.get("n", j + 1), m - j))).alias("most")))
    whole = whole.select("key", "start", at.alias("x")).repartitionByRange("key", "start").sortWithinPartitions("key", "start")
    return settle(whole.select(F.monotonically_increasing_id().alias("seg"), "key", "start", "x"), "segments")


def _spread(a: Column) -> Column:
    """a, sorted by j, with nulls for the j that are missing in between."""

    def fill(p: Column, at: Column) -> Column:
        gap = F.coalesce(F.get(a, at + 1)["j"] - p["j"] - 1, F.lit(0))
        return F.concat(F.array(p), F.array_repeat(F.when(p["j"] < 0, p), gap))

    return F.flatten(F.transform(a, fill))


def _round(suffixes: DataFrame, step: int) -> DataFrame:
    """(seg, j, lines, a, b, n, most) from (seg, x) with ranks of the first ``step`` lines.

    With lines > 0, the prefix of that many lines by the ranks that name it; with 0, the pair to be ranked next.
    """
    x = F.col("x")
    base = F.get(x, F.lit(0))["j"]

    def told(p: Column, other: Column, lines: Column) -> Column:
        return F.struct(p["j"].alias("j"), lines.alias("lines"), p["r"].alias("a"), other["r"].alias("b"), p["n"].alias("n"), p["most"].alias("most"))

    def of(p: Column) -> Column:
        at = p["j"] - base
        lo, hi = F.greatest(p["n"], F.lit(step)), F.least(p["most"], F.lit(2 * step - 1))
        due = F.when(p["n"].isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        prefixes = F.transform(due, lambda n: F.when(F.get(x, at + n - step).isNotNull(), told(p, F.get(x, at + n - step), n)))
        after = F.get(x, at + step)
        onward = p["n"].isNull() | (p["n"] > step) | (p["most"] >= 2 * step)
        return F.array_compact(F.concat(prefixes, F.array(F.when(onward & after.isNotNull(), told(p, after, F.lit(0))))))

    each = F.flatten(F.transform(F.filter(x, lambda p: p.isNotNull()), of))
    return settle(suffixes.select("seg", F.explode(each).alias("e")).select("seg", "e.*"), "suffixes")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start, n): runs of lines that are copies of an earlier run, at least min_words words long."""
    lines = settle(lines_of(docs, id_col, text_col), "lines")
    segments = _segments(lines, min_words)
    discard(lines)
    rounds, step = [_round(segments.select("seg", "x"), 1)], 1
    while True:
        pairs = rounds[-1].where("lines = 0")
        ranks = _ranked(pairs.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"), "ranks")
        if ranks.isEmpty():
            break
        step *= 2
        alive = pairs.join(ranks, ["a", "b"]).groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("j", "r", "n", "most"))).alias("x"))
        rounds.append(_round(alive.withColumn("x", _spread(F.col("x"))), step))
    prefixes = reduce(DataFrame.union, [r.where("lines > 0").select("lines", "a", "b", "seg", "j") for r in rounds])
    place = F.struct("seg", "j")
    intervals = settle(prefixes.groupBy("lines", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "intervals")
    later = prefixes.join(intervals, ["lines", "a", "b"]).where(place > F.col("first")).select("seg", "j", F.col("lines").alias("n"))
    return later.join(segments.select("seg", "key", "start"), "seg").select("key", (F.col("start") + F.col("j")).alias("start"), "n")


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, drop_empty: bool = False, counts: bool = False) -> DataFrame:
    """docs with the later copies of repeated runs of lines deleted from text_col.

    With counts also n_lines and n_deleted, long. drop_empty leaves out documents that lost all lines.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words)
    # what stays lies between the end of all earlier runs and the start of the next
    earlier = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    gaps = runs.select("key", "start", (F.col("start") + F.col("n")).alias("end"), F.coalesce(F.max(F.col("start") + F.col("n")).over(earlier), F.lit(0)).alias("from"))
    gap = F.when(F.col("start") > F.col("from"), F.struct("from", (F.col("start") - F.col("from")).alias("n")))
    cuts = gaps.groupBy("key").agg(F.sort_array(F.collect_list(gap)).alias("gaps"), F.max("end").alias("end"))
    cuts = cuts.select(F.col("key.id").alias("id"), F.col("key.d").alias("d"), "gaps", "end")
    marked = as_rows(docs).withColumn("digest", text_digest(field(text_col)))
    rows = marked.join(cuts, field(id_col).eqNullSafe(cuts["id"]) & (marked["digest"] == cuts["d"]), "left")
    lines = F.split(field(text_col), "\n")
    left = F.concat(F.flatten(F.transform("gaps", lambda g: F.slice(lines, g["from"] + 1, g["n"]))), F.slice(lines, F.col("end") + 1, F.size(lines)))
    rows = rows.select("row", F.when(F.col("end").isNotNull(), left).alias("kept"))
    if drop_empty:
        rows = rows.where(F.col("kept").isNull() | (F.size("kept") > 0))
    total = F.when(field(text_col).isNotNull(), F.size(lines)).otherwise(0).cast("long")
    lost = F.when(F.col("kept").isNotNull(), total - F.size("kept")).otherwise(F.lit(0)).cast("long")
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(field(text_col))
    return rows.select(*fields(docs, **{text_col: text}), *([total.alias("n_lines"), lost.alias("n_deleted")] if counts else []))
