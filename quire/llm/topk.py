"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into whole numbers, floor(64 x), and grouped by length: from a count of the vectors of each
sixteenth of an octave, parts of the table are laid out in the order of falling length. Every query first asks the
longest part, which gives it a score that k candidates reach; it then goes only to the parts whose greatest length could
beat that score. Inside a part the buckets are skipped, narrowed by coordinates or narrowed by length, as their local
cosine threshold says, and the products that remain are verified (see quire.llm.blocks).

Defined results: rows with a null id, or vectors that are null, empty, or have null or non-finite components take no
part; zero vectors do; vectors of different dimension are not compared; rows that share an id are rows of their own,
and only the query's own row is left out; fewer candidates than k give all; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import blocks
from quire.llm.common import settle

K = 20
SCALE = 64
#: Below so many rows a part isn't split for the sake of more cores.
LEAST_PART = 4096


def quantised(vec: Column, scale: int = SCALE) -> Column:
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))


def parts_by_length(vecs: DataFrame, part_rows: int) -> DataFrame:
    """(dim, octave, base, width): where the vectors of a length go; a row for each sixteenth of an octave.

    A length with more rows than a part gets parts of its own; shorter ones share the part that they fall into.
    """
    counts = vecs.groupBy("dim", "octave").count()
    before = Window.partitionBy("dim").orderBy(F.col("octave").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / F.lit(part_rows)).cast("int")
    return counts.select("dim", "octave", first.alias("base"), F.ceil(F.col("count") / F.lit(part_rows)).cast("int").alias("width"))


def top_k(rows: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", is_query: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of rows, the k rows of the largest integer inner product."""
    spark = rows.sparkSession
    vecs = blocks.valid(rows, id_col, vec_col, zero=True).withColumn("vec", quantised(F.col("vec"), scale)).withColumn("dim", F.size("vec"))
    vecs = vecs.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    octave = F.when(F.col("norm") > 0, F.floor(16 * F.log2("norm"))).otherwise(F.lit(-100000)).cast("int")
    asks = F.coalesce(is_query if is_query is not None else blocks.is_query(F.col("vec_id")), F.lit(False))
    vecs = settle(vecs.withColumn("octave", octave).withColumn("asks", asks), "vectors")
    n, n_asked = vecs.agg(F.count("*"), F.count_if("asks")).first()
    part_rows = min(blocks.PART_ROWS, max(LEAST_PART, blocks.per(n, spark.sparkContext.defaultParallelism)))
    groups = blocks.per(n_asked, blocks.GROUP_ROWS)
    layout = settle(parts_by_length(vecs, part_rows), "parts")
    place = F.struct("dim", (F.col("base") + blocks.dealt(F.col("uid"), 1 << 20) % F.col("width")).alias("no"))
    placed = settle(vecs.join(layout, ["dim", "octave"]).select(place.alias("part"), "uid", "vec_id", "vec", "norm"), "placed")
    longest = settle(placed.groupBy("part").agg(F.max("norm").alias("longest")), "longest")
    asked = vecs.where("asks").select("dim", "uid", "vec_id", "vec", "norm", blocks.dealt(F.col("uid"), groups).alias("group"))

    first = asked.select(F.struct("dim", F.lit(0).alias("no")).alias("part"), "group", "uid", "vec_id", "vec", F.lit(None).cast("double").alias("least"))
    seen = settle(blocks.search(blocks.in_groups(placed.where("part.no = 0"), groups), first, k, "bigint"), "first-part")
    least = seen.groupBy("query_uid").agg(F.min("score").alias("score"), F.count("*").alias("n")).select(F.col("query_uid").alias("uid"), F.when(F.col("n") >= k, F.col("score").cast("double")).alias("least"))
    known = settle(asked.join(settle(least, "least-scores"), "uid", "left"), "asked")
    rest = longest.where("part.no > 0").groupBy("part.dim").agg(F.sort_array(F.collect_list(F.struct(F.col("part.no").alias("no"), "longest"))).alias("others"))
    # a little below the bound, for the rounding of lengths
    may = F.filter("others", lambda o: F.col("least").isNull() | (F.col("least") <= 0) | (F.col("norm") * o["longest"] >= F.col("least") * F.lit(1 - 1e-9)))
    further = known.join(settle(rest, "other-parts"), "dim").withColumn("o", F.explode(may))
    further = further.select(F.struct("dim", F.col("o.no").alias("no")).alias("part"), "group", "uid", "vec_id", "vec", "least")
    more = blocks.search(blocks.in_groups(placed.where("part.no > 0"), groups), further, k, "bigint")
    return blocks.ranked(seen.unionByName(more), k)
