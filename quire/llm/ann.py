"""Approximate nearest neighbours by learned partitions.

On a bounded sample (the FIT_ROWS rows that come first by a hash of their id), the graph of nearest neighbours is
cut into balanced partitions: halves by the leading direction, improved by swaps of equal numbers of nodes that lower
the number of cut edges, and so on within each half; their number grows with the square root of the table's rows. A small network with one hidden layer is trained to tell, from a
vector, in which partitions its neighbours lie. Every row of the table is indexed in its most probable partition; a
query goes to the most probable partitions until their probabilities add up to a threshold, which is set on held-out
rows of the sample so that at least TARGET of their neighbours are covered. Candidates are reranked by the exact
inner product in double precision (see quire.llm.blocks); a partition that outgrows a task is dealt into several.

Vectors are only compared with those of their dimension. Each dimension has partitions of its own; one with too few
rows in the sample to be parted has a single one, which every query of that dimension searches.

Defined results: rows with a null id, or vectors that are null, empty, zero, or have null or non-finite components take
no part; rows that share an id are rows of their own; fewer candidates than k give all that are found; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks
from quire.llm.common import settle
from quire.session import ship

K = 20
FIT_ROWS = 8192
HIDDEN = 128
TARGET = 0.93
#: Rows of the sample that a partition must have.
LEAST_ROWS = 32
NEIGHBOURS = 20
SEED = 7


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """For each row the k rows of the largest inner product, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A partition of the graph's nodes into ``parts`` (a power of two) of nearly equal size with few cut edges."""
    label = np.zeros(len(x), dtype=np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            direction = np.linalg.eigh(y.T @ y)[1][:, -1] if len(g) > 1 else np.zeros(x.shape[1])
            side = np.zeros(len(g), dtype=bool)
            side[np.argsort(y @ direction, kind="stable")[len(g) // 2 :]] = True
            at = np.full(len(x), -1)
            at[g] = np.arange(len(g))
            near = at[graph[g]]
            for _ in range(12):
                other = np.where(near >= 0, side[near] != side[:, None], False).sum(axis=1)
                own = (near >= 0).sum(axis=1) - other
                gain = other - own
                a, b = (np.flatnonzero(side == s) for s in (False, True))
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                n = min(len(a), len(b))
                good = int((gain[a[:n]] + gain[b[:n]] > 0).sum() // 2)
                if not good:
                    break
                side[a[:good]], side[b[:good]] = True, False
            halves += [g[~side], g[side]]
        groups = halves
    for i, g in enumerate(groups):
        label[g] = i
    return label


class Router:
    """A network with one hidden layer: vector -> probabilities of the partitions."""

    def __init__(self, dim: int, parts: int, scale: float, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.scale = scale
        self.w = [r.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), r.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x / self.scale @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, rate: float = 3e-3) -> None:
        r = np.random.default_rng(SEED)
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), 256):
                b = order[at : at + 256]
                h, p = self.forward(x[b])
                dz = (p - target[b]) / len(b)
                dh = dz @ self.w[2].T * (h > 0)
                grads = [(x[b] / self.scale).T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)


def probes(p: np.ndarray, threshold: float) -> np.ndarray:
    """A boolean matrix: the most probable partitions of each row, until their probabilities add up to the threshold."""
    order = np.argsort(-p, axis=1, kind="stable")
    added = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    take = np.concatenate([np.ones((len(p), 1), dtype=bool), added[:, :-1] < threshold], axis=1)
    out = np.zeros(p.shape, dtype=bool)
    np.put_along_axis(out, order, take, axis=1)
    return out


def parts_for(rows: int) -> int:
    """A power of two near a seventh of the square root of the rows: 4 for 500, 32 for 50,000, 256 for 5,000,000."""
    return 1 << max(0, round(math.log2(max(1.0, math.sqrt(rows) / 7))))


def fit(sample: np.ndarray, parts: int, target: float = TARGET) -> tuple[Router, float]:
    """The router, and the threshold of probability up to which partitions are searched."""
    while parts > 1 and len(sample) < LEAST_ROWS * parts:
        parts //= 2
    if parts == 1:
        return Router(sample.shape[1], 1, 1.0), 2.0
    scale = float(np.sqrt((sample**2).sum(axis=1).mean() / sample.shape[1])) or 1.0
    graph = neighbour_graph(sample)
    label = balanced_parts(sample, graph, parts)
    wanted = np.zeros((len(sample), parts))
    np.add.at(wanted, (np.arange(len(sample))[:, None], label[graph]), 1 / graph.shape[1])
    soft = wanted * 0.8
    soft[np.arange(len(sample)), label] += 0.2
    held = np.arange(len(sample)) % 8 == 0
    router = Router(sample.shape[1], parts, scale)
    router.fit(sample[~held], soft[~held])
    p = router.forward(sample)[1]
    home = p.argmax(axis=1)  # where the index has each row
    for threshold in (0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9995, 0.9999):
        asked = probes(p[held], threshold)
        covered = np.take_along_axis(asked, home[graph[held]], axis=1).mean()
        if covered >= target:
            return router, threshold
    return router, 2.0  # all partitions


def search(rows: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", is_query: Column | None = None, fit_rows: int = FIT_ROWS, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of rows, the k nearest found."""
    query = is_query if is_query is not None else blocks.is_query(F.col("vec_id"))
    vecs = settle(blocks.valid(rows, id_col, vec_col, zero=False).withColumn("asks", F.coalesce(query, F.lit(False))), "vectors")
    n = vecs.count()
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in vecs.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "uid").limit(fit_rows).select("vec").toPandas()["vec"]:
        by_dim.setdefault(len(v), []).append(np.asarray(v, dtype=np.float64))
    sampled = sum(map(len, by_dim.values()))
    routers = {dim: fit(np.array(x), parts or parts_for(round(n * len(x) / sampled))) for dim, x in by_dim.items()}
    ship(rows.sparkSession)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vecs, asks = b.column(2), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            dims = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
            home, many = np.zeros(b.num_rows, dtype=np.int64), [[] for _ in range(b.num_rows)]
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                router, threshold = routers.get(dim, (None, 2.0))
                if router is None:
                    p = np.ones((len(at), 1))
                else:
                    p = router.forward(vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim))[1]
                home[at] = p.argmax(axis=1)
                for i, x in zip(at.tolist(), probes(p, threshold)):
                    if asks[i]:
                        many[i] = np.flatnonzero(x).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vecs, pa.array(dims, pa.int32()), pa.array(home, pa.int32()), pa.array(many, pa.list_(pa.int32()))], names=["uid", "vec_id", "vec", "dim", "home", "probes"])

    kind = vecs.schema["vec"].dataType.simpleString()
    routed = vecs.select("uid", "vec_id", "vec", "asks").mapInArrow(route, f"uid bigint, vec_id bigint, vec {kind}, dim int, home int, probes array<int>")
    routed = settle(routed, "routed")
    # how many pieces each partition is dealt into, and how many groups of queries ask for it: a row for each partition
    held = routed.groupBy("dim", F.col("home").alias("no")).agg(F.ceil(F.count("*") / F.lit(blocks.PART_ROWS)).cast("int").alias("pieces"))
    asked = routed.select("dim", "uid", "vec_id", "vec", F.explode("probes").alias("no"))
    asking = asked.groupBy("dim", "no").agg(F.ceil(F.count("*") / F.lit(blocks.GROUP_ROWS)).cast("int").alias("groups"))
    sizes = settle(held.join(asking, ["dim", "no"]), "partitions")
    index = routed.withColumn("no", F.col("home")).join(sizes, ["dim", "no"])
    index = index.withColumn("piece", (blocks.dealt(F.col("uid"), 1 << 20) % F.col("pieces")).alias("piece")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asked = asked.join(sizes, ["dim", "no"]).withColumn("group", blocks.dealt(F.col("uid"), 1 << 20) % F.col("groups")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    part = F.struct("dim", "no", "piece")
    return blocks.ranked(blocks.search(index.withColumn("part", part), asked.withColumn("part", part).withColumn("least", F.lit(None).cast("double")), k, "double"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())
