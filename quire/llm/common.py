"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import discard, scratch, settle, shared_dir

#: ASCII white space (space, tab, newline, vertical tab, form feed, return); all else makes words.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
__all__ = ["SPACE", "SPACE_WORD", "UPPER", "as_rows", "ascii_lower", "discard", "field", "fields", "numbered", "pieces", "scratch", "settle", "shared_dir", "table", "text_digest", "word_count"]
#: Keys of repeated rows that may be broadcast, some 20 MB.
BROADCAST_KEYS = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_digest(text: Column) -> Column:
    """128 bits of the text as two longs, for telling rows apart that share an id."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("quire"), text).alias("b"))


def pieces(text: Column, separator: str) -> Column:
    """What the separator parts, without the empty strings at either end; splitting is far quicker than matching words."""
    return F.array_remove(F.split(text, separator), "")


def word_count(text: Column) -> Column:
    """The number of words between ASCII white space; null for a null text."""
    parts = F.split(text, SPACE)
    return F.size(parts) - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_rows(df: DataFrame) -> DataFrame:
    """df with all its columns in one, ``row``, so that columns of any name can stand beside those of an operator."""
    return df.select(F.struct(*[F.col(_quoted(c)).alias(c) for c in df.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def fields(df: DataFrame, **other: Column) -> list[Column]:
    """The columns of df out of ``row``, some of them replaced."""
    return [other.get(c, field(c)).alias(c) for c in df.columns]


def numbered(rows: DataFrame, key: Column) -> DataFrame:
    """rows (row, ...) with nth: 0 for the first of the rows of one key, 1 for the next and so on."""
    rows = rows.withColumn("key", key)
    again = settle(rows.groupBy("key").count().where("count > 1").select("key"), "repeated-keys")
    few = again.count()
    if not few:
        return rows.withColumn("nth", F.lit(0).cast("long")).drop("key")
    if few <= BROADCAST_KEYS:
        again = F.broadcast(again)
    once = rows.join(again, "key", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    more = settle(rows.join(again, "key", "left_semi").withColumn("part", F.spark_partition_id()), "repeated-rows")
    counts = more.groupBy("key", "part").count()
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.select("key", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "repeated-counts")
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.lit(0)))
    more = more.withColumn("within", within).join(counts, ["key", "part"]).withColumn("nth", F.col("before") + F.col("within") - 1)
    return once.unionByName(more.select(*once.columns)).drop("key")
