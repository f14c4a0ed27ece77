"""Quality of recognised text without a ground truth, and coverage of one text by another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arabic import COMMON_WORDS
from quire.functions.text import strip, tokens

# ---- fixed values
ARABIC_FUNCTION = [*COMMON_WORDS, "الى", "هذه", "هو", "هي", "كل", "بعض", "غير", "لم", "لن", "قال", "عند", "لو", "ثم", "إذا", "حتى", "بل"]
ENGLISH_FUNCTION = ["the", "and", "of", "to", "in", "that", "he", "was", "it", "for", "with", "as", "his", "on", "be", "at", "by", "had", "not", "but"]
JUNK = r"[^\p{L}\p{N}_\s\x85\p{Z}؀-ۿ.,;:!?'\"()\[\]\-،؛؟٪-٭‘’“”–—/%&@#]"
# ----


def rounded(x: Column, digits: int) -> Column:
    """Rounded as a binary number, for x from 0: 4.975, which lies below its name, becomes 4.97."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def score(docs: DataFrame, id_cols: list[str], text_col: str = "text", arabic: bool = False) -> DataFrame:
    """(id_cols, score, tokens, distinct, recurring_rate, function_word_rate, junk_rate, isolated_letter_rate, avg_word_len).

    Words are case-sensitive, so a capitalised "The" is no function word. All is counted inside the row: among a text's
    sorted words, one that recurs has its likes next to it.
    """
    pattern = "[ء-ي]{2,}" if arabic else "[A-Za-z]{2,}"
    function = ARABIC_FUNCTION if arabic else ENGLISH_FUNCTION
    text = F.col(text_col)
    alone = F.regexp_count(text, F.lit(r"(?<!\S)[ء-يA-Za-z](?!\S)"))
    junk = F.regexp_count(text, F.lit(JUNK)) / F.greatest(F.length(text), F.lit(1))
    base = docs.select(*id_cols, F.sort_array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("w"), alone.alias("alone"), junk.alias("junk"))

    def thrice(x: Column, i: Column) -> Column:
        like = lambda k: F.coalesce(F.get("w", i + k) == x, F.lit(False))
        return like(2) | (like(-1) & like(1)) | like(-2)

    size = F.size("w").cast("long")
    rows = base.select(
        *id_cols, "alone", "junk", F.when(size > 0, size).alias("n"), F.when(size > 0, F.size(F.array_distinct("w")).cast("long")).alias("distinct"), F.size(F.filter("w", thrice)).alias("again"),
        F.size(F.filter("w", lambda x: x.isin(function))).alias("fn"), F.length(F.array_join("w", "")).alias("chars"),
    )
    n = F.col("n")
    recurring, fn, single, mean = F.col("again") / n, F.col("fn") / n, F.col("alone") / n, F.col("chars") / n
    fit = F.when(mean.between(3.0, 7.5), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(mean - 5) / 5))
    total = recurring * 34 + F.least(fn / 0.16, F.lit(1.0)) * 34 + F.greatest(F.lit(0.0), 1 - F.col("junk") * 60) * 14 + F.greatest(F.lit(0.0), 1 - single * 14) * 10 + fit * 8
    return rows.select(
        *id_cols, F.coalesce(rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1), F.lit(0.0)).alias("score"), F.coalesce(n, F.lit(0)).alias("tokens"), F.coalesce("distinct", F.lit(0)).alias("distinct"),
        rounded(recurring, 3).alias("recurring_rate"), rounded(fn, 3).alias("function_word_rate"), F.when(n > 0, rounded(F.col("junk"), 4)).alias("junk_rate"), rounded(single, 3).alias("isolated_letter_rate"), rounded(mean, 2).alias("avg_word_len"),
    )


def pick_best(scored: DataFrame, id_cols: list[str], name_col: str, ordinal_col: str) -> DataFrame:
    """(id_cols, winner, score): the candidate of the highest score; of equal ones the first by ordinal."""
    best = F.max(F.struct(F.col("score").alias("score"), (-F.col(ordinal_col)).alias("o"), F.col(name_col).alias("winner")))
    return scored.groupBy(*id_cols).agg(best.alias("b")).select(*id_cols, "b.winner", "b.score")


def coverage(source: Column, output: Column) -> Column:
    """struct(source_tokens, output_tokens, token_ratio, vocab_recall, lost): how much of source is in output.

    Both ratios are null for an empty source; lost holds 15 lost words, in alphabetical order.
    """
    s, o = tokens(source), tokens(output)
    vocab = F.array_distinct(s)
    n = F.nullif(F.size(s), F.lit(0))
    return F.struct(
        F.size(s).alias("source_tokens"), F.size(o).alias("output_tokens"), rounded(F.size(o) / n, 3).alias("token_ratio"),
        rounded(F.size(F.array_intersect(vocab, o)) / F.nullif(F.size(vocab), F.lit(0)), 3).alias("vocab_recall"), F.slice(F.array_sort(F.array_except(vocab, o)), 1, 15).alias("lost"),
    )


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0
