"""SimHash near-duplicates with BK-trees.

Fingerprints (64 bits over word shingles) link at a Hamming distance of at most ``radius``. Two fingerprints
that differ in at most r bits agree on at least m - r of any m bit blocks, so they meet in the shard of some
choice of m - r blocks with equal values. Every shard of *distinct* fingerprints gets a BK-tree (children keyed
by their distance to the parent), searched with every member while only edges within the radius are followed.
A shard answers with a spanning forest of its links, never with all pairs; components come from alternating
star contraction on DataFrames. A tree travels to the task with its shard's rows: a broadcast of all trees would
grow with the corpus.

Shards above ``shard_rows`` members (dense groups of near copies) are cut into chunks and each pair of chunks is
searched, which is exact for any size.

Defined results: null or wordless texts have fingerprint zero and link like any other; a null doc_id counts for
linking but never names a component unless all ids of the component are null; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_rows, discard, field, fields, numbered, settle, text_digest
from quire.session import ship

RADIUS = 3
SHINGLE = 3
SHARD_ROWS = 1500
LEAF = 24
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: bit b is set if over half of the shingles' XXH64 (seed 42) have it set."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    if shingle == 3:
        hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # long texts in pieces
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp): one row for each row of docs; fp holds the unsigned 64 bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BKTree:
    """A BK-tree over distinct fingerprints, built and searched in bulk.

    A node keeps a pivot; the rest of its members go to the child keyed by their distance to it. Up to LEAF
    members stay in a bucket. ``link`` joins each member with all others within the radius that are reached by
    following the edges k with |k - distance to the pivot| <= radius.
    """

    def __init__(self, values: np.ndarray, radius: int):
        self.values, self.radius = values, radius
        self.parent = list(range(len(values)))
        self.parts = len(values)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
            self.parts -= 1

    def link(self) -> None:
        everyone = np.arange(len(self.values))
        todo = [(everyone, everyone)]  # members of a subtree, and the fingerprints to look up in it
        while todo and self.parts > 1:
            members, queries = todo.pop()
            if len(members) <= LEAF:
                near = np.bitwise_count(self.values[members][:, None] ^ self.values[queries][None, :]) <= self.radius
                for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                    self.join(int(members[i]), int(queries[j]))
                continue
            pivot = members[0]
            to_query = np.bitwise_count(self.values[queries] ^ self.values[pivot])
            for j in queries[to_query <= self.radius].tolist():
                self.join(int(pivot), j)
            to_member = np.bitwise_count(self.values[members[1:]] ^ self.values[pivot])
            for edge in np.unique(to_member).tolist():
                asked = queries[np.abs(to_query.astype(np.int16) - edge) <= self.radius]
                if len(asked):
                    todo.append((members[1:][to_member == edge], asked))


def _links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as (member, root)."""
    n = len(values)
    if n == 2:
        a, b = int(values[0]), int(values[1])
        return [(b, a)] if (a ^ b).bit_count() <= radius else []
    tree = BKTree(values, radius)
    tree.link()
    return [(int(values[i]), int(values[r])) for i in range(n) if (r := tree.find(i)) != i]


def blocks_for(n: int, radius: int = RADIUS, bits: int = 64) -> tuple[int, int]:
    """(blocks, clean blocks) so that a shard of n random fingerprints holds some hundred members at most."""
    blocks = radius + 1
    while (blocks - radius) * (bits // blocks) < np.log2(max(n, 2)) - 8 and blocks < 2 * radius:
        blocks += 1
    return blocks, blocks - radius


def shards(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(shard, value, fp) for each distinct fingerprint and choice of blocks that may be free of differences."""
    blocks, clean = blocks_for(fps.count(), radius)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), clean)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        keys.append(F.struct(F.lit(k).alias("shard"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("value")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.shard", "k.value", "fp")


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v): for the distinct fingerprints in column fp, edges whose components are those of all links."""
    ship(fps.sparkSession)
    rows = shards(fps, radius)
    # written, as all sides of joins that come from an aggregation: then a hot key can be split
    sizes = settle(rows.groupBy("shard", "value").count().where("count > 1"), "shards")
    rows = rows.join(sizes, ["shard", "value"])
    n = F.ceil(F.col("count") / F.lit(shard_rows)).cast("int")
    chunk = F.when(n > 1, F.pmod(F.xxhash64("fp"), n).cast("int")).otherwise(F.lit(0))
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.struct(F.least(d, chunk).alias("a"), F.greatest(d, chunk).alias("b")))
    rows = rows.select("shard", "value", "fp", F.explode(pair).alias("c")).select("shard", "value", "c.a", "c.b", "fp")
    keys = ["shard", "value", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def done() -> list[tuple[int, int]]:
            values = np.concatenate(held).view(np.uint64) if held else np.empty(0, np.uint64)
            return _links(values, radius) if len(values) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not batch.num_rows:
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                key = tuple(int(c[s]) for c in cols[:4])
                if key != last:
                    out += done()
                    held, last = [], key
                held.append(cols[4][s:e].astype(np.int64))
            yield _edges(out)
        yield _edges(done())

    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp").mapInArrow(run, "u bigint, v bigint")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large-star and small-star steps."""
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        # large star: each node sends its larger neighbours to the least node that it knows
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: each node sends its smaller neighbours and itself to the least of them
        large = settle(large, "stars")
        discard(least)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        old, edges = edges, settle(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        discard(large, least, old)


def components(fps: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of fps (id_col, fp); root names the component, never null."""
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected(links(nodes.select("fp"), radius, shard_rows))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = settle(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return nodes.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of docs."""
    fps = settle(with_fingerprint(docs, id_col, text_col), "fingerprints")
    found = components(fps, id_col, radius, shard_rows)
    return fps.join(found, "fp").select(id_col, hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row for each group of near-duplicates: the least by (id, text digest), nulls first.

    All columns stay as they are, whatever their names. Rows that are alike in id and text count as one; which of them
    stays is not defined.
    """
    key = F.struct(field(id_col).alias("id"), text_digest(field(text_col)).alias("d"))
    rows = as_rows(docs).withColumn("key", key)
    fps = settle(with_fingerprint(rows.select("key", field(text_col).alias("text")), "key", "text"), "fingerprints")
    found = components(fps.select(F.col("key.id").alias("id"), "fp"), "id", radius)
    chosen = settle(fps.join(found, "fp").groupBy("root").agg(F.min("key").alias("k")), "chosen")
    kept = rows.join(chosen, rows["key"] == chosen["k"], "left_semi")
    return numbered(kept.select("row"), key).where("nth = 0").select(*fields(docs))
