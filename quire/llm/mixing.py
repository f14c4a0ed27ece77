"""Mixing sources to target weights.

Tokens are aggregated per source, targets follow from the weights, and each document is emitted
floor(rate) times plus once more with a probability equal to the fraction of its source's rate, decided by a
hash of a seed and the row (so that reruns agree).

Targets: the mix holds ``share`` times all tokens, dealt by weight; a source gets at most ``most`` times its own
size, and what exceeds that goes to the others by weight until none is above. In closed form: with the sources in
the order of (cap / weight), those before some place get their cap and the rest a common level times their weight.

The table of sources (a row for each, from one grouped aggregation) is ordered in one task; documents never are.
They meet their source's rate in a broadcast join while the counted sources are few enough, else in a shuffled one
that adaptive execution splits at a hot source.

Rows alike in id, text and source are told apart by the number of their occurrence, so that many copies of one row are
taken near their rate too. Only such rows are written and numbered: within the part of the table that each was read in,
and those counts are added up, so that no task orders all copies of a row.

Defined results: a null text has size 0; a null source is a source of its own, last in order; which of several rows
alike in id, text and source gets which number is not defined, only that each gets its own; empty tables give empty
results; sources without any token get target 0 and take none; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import as_rows, field, fields, numbered, settle, text_digest, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 20250601
#: Rows of the table of sources that may be broadcast, some 10 MB at 50 bytes each.
BROADCAST_SOURCES = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(word_count(text), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if this source and all later ones are not full; it holds from the first that isn't
    level = (F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    first = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(everyone)
    target = F.when(first.isNull() | (F.col("full_at") < first["full_at"]), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * first["level"]))
    return s.withColumn("target", target).select("source", "source_size", "target")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(row, size, source_size, target, copies): docs' rows and the number of times that the mix takes each."""
    rows = as_rows(docs).select("row", size_of(field(text_col)).alias("size"))
    targets = source_targets(rows.select(field(source_col).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = settle(targets, "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = numbered(rows, F.struct(field(id_col).alias("id"), text_digest(field(text_col)).alias("d"), field(source_col).alias("source")))
    rows = rows.join(targets, field(source_col).eqNullSafe(targets["source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    id_, nth = F.coalesce(field(id_col).cast("string"), F.lit("")), F.when(F.col("nth") > 0, F.col("nth")).cast("string")
    # a first occurrence is drawn by seed, id and text alone
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), nth, id_, F.coalesce(field(text_col), F.lit(""))))
    drawn = F.conv(F.substring(seeded, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    taken = (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return rows.select("row", "size", "source_size", "target", taken.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed rows themselves: each row of docs as often as the mix takes it, with the columns of docs."""
    rows = copies(docs, id_col, text_col, source_col, **how).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*fields(docs))


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(id_col, size, source_size, target, taken) for each row of docs."""
    rows = copies(docs, id_col, **how)
    return rows.select(field(id_col).alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
