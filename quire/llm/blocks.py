"""Exact search of queries against vectors, in parts of bounded size.

Candidates are dealt into parts, queries into groups; a task holds one part and one group (PART_ROWS and GROUP_ROWS rows
at most) and answers each query with its k best of the part. What is shipped is the candidates once for each group, and
a query once for each part that it may need, never a pair of rows. Groups and parts stay as few as the cores allow, so
what is shipped grows with the rows until a part or a group is full.

Within a part, vectors are put into buckets of near-equal length, the longest first. With t the k-th best score so
far, a candidate c can only matter to a query q if cos(q, c) >= t / (|q| max|c|) =: theta in its bucket. A bucket with
theta > 1 is skipped. With theta above COORDINATE the candidates are narrowed by coordinates: on the two axes where q
is largest, c's angle to the axis must lie within arccos(theta) of q's. Otherwise they are narrowed by length, to
|c| >= t / |q|. Products are verified for what is left. A query may bring a t along from parts that it has seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import ship

BLOCK = 1024
QUERY_BLOCK = 128
PART_ROWS = 65_536
GROUP_ROWS = 65_536
COORDINATE = 0.6
SLACK = 1e-9


def valid(rows: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(uid, vec_id, vec, norm): the rows that take part; uid tells rows with equal ids apart, once written.

    Left out are rows with a null id, and vectors that are null, empty, or have null or non-finite components
    (and, unless ``zero``, those of length zero).
    """
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(ok, F.lit(False))).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))


class Bucket:
    """Candidates of near-equal length, longest first, with what every query asks of them."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, c: np.ndarray):
        self.uids, self.ids = uids, ids
        self.exact = c.astype(np.int64 if np.issubdtype(c.dtype, np.integer) else np.float64)
        self.cf = c.astype(np.float64)
        self.length = np.sqrt((self.cf**2).sum(axis=1))
        self.unit = self.cf / np.where(self.length > 0, self.length, 1)[:, None]


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


class Best:
    """The k best candidates of each query of a block: by score, then by smaller id."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.uids, self.ids = uids, ids
        self.exact = np.issubdtype(q.dtype, np.integer)
        self.q, self.k = q.astype(np.int64 if self.exact else np.float64), k
        self.qf = q.astype(np.float64)
        self.norm = np.sqrt((self.qf**2).sum(axis=1))
        unit = self.qf / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.axes = np.argsort(-np.abs(unit), axis=1)[:, :2]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.axes, axis=1), -1, 1))
        self.limit = np.full(len(q), -np.inf) if limit is None else np.array(limit, dtype=np.float64)
        self.top: list[list[tuple]] = [[] for _ in range(len(q))]

    def see(self, bucket: Bucket) -> None:
        uids, ids, exact, cf, length, unit = bucket.uids, bucket.ids, bucket.exact, bucket.cf, bucket.length, bucket.unit
        if self.exact and np.abs(cf).max(initial=0) * np.abs(self.qf).max(initial=0) * cf.shape[1] >= 2**53:
            rough = None  # beyond doubles' exact range: all products in whole numbers
        else:
            rough = True
        reach = self.norm * (length[0] if len(length) else 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = np.where(reach > 0, self.limit / reach, np.where(self.limit <= 0, -np.inf, np.inf))
            least = np.where(self.norm > 0, self.limit / self.norm, -np.inf)
        asked = np.flatnonzero(theta <= 1 + SLACK) if rough else np.arange(len(self.q))
        by_coordinate = (theta[asked] > COORDINATE) & bool(rough)
        by_length = asked[~by_coordinate]
        if len(by_length):
            n = len(length) if not rough else max(1, int(np.searchsorted(-length, -least[by_length].min() * (1 - SLACK) + SLACK, side="right")))
            if rough:
                scores = self.qf[by_length] @ cf[:n].T
            else:
                scores = self.q[by_length] @ exact[:n].T
            slack = SLACK * (1 + np.abs(self.limit[by_length])) if not self.exact else 0
            hits = scores >= np.where(np.isfinite(self.limit[by_length]), self.limit[by_length] - slack, -np.inf)[:, None]
            for i, hit in zip(by_length.tolist(), hits):
                self._add(i, np.flatnonzero(hit), uids, ids, exact)
        for i in asked[by_coordinate].tolist():
            wide = np.arccos(min(1.0, theta[i]))
            keep = np.ones(len(unit), dtype=bool)
            for axis, angle in zip(self.axes[i], self.angle[i]):
                x = unit[:, axis]
                keep &= (x >= np.cos(min(np.pi, angle + wide)) - 1e-7) & (x <= np.cos(max(0.0, angle - wide)) + 1e-7)
            left = np.flatnonzero(keep)
            rest = cf[left] @ self.qf[i]
            self._add(i, left[rest >= self.limit[i] - SLACK * (1 + abs(self.limit[i]))], uids, ids, exact)

    def _add(self, i: int, at: np.ndarray, uids: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        if not len(at):
            return
        score = (exact[at] * self.q[i]).sum(axis=1)  # each sum in the same order, so that equal vectors tie
        if len(at) > 4 * self.k:
            edge = np.partition(score, len(score) - self.k - 1)[len(score) - self.k - 1]  # one more: the query's own row may be among them
            at, score = at[score >= edge], score[score >= edge]
        mine = self.uids[i]
        new = [(-s, v) for s, v, u in zip(score.tolist(), ids[at].tolist(), uids[at].tolist()) if u != mine]
        top = self.top[i] = sorted(self.top[i] + new)[: self.k]
        if len(top) == self.k:
            self.limit[i] = max(self.limit[i], -top[-1][0])


def per(rows: int, size: int) -> int:
    """Into how many pieces of at most ``size`` rows (about) so many rows are dealt."""
    return max(1, -(-rows // size))


def search(candidates: DataFrame, queries: DataFrame, k: int, score: str) -> DataFrame:
    """(query_uid, query_id, vec_id, score): for each query and part, its k best candidates of that part.

    candidates: (part, group, uid, vec_id, vec), each of its parts in every group that asks for it;
    queries: (part, group, uid, vec_id, vec, least), least being a score that k candidates elsewhere reach, or null.
    A part and group are held in one task. score is the SQL type of a score.
    """
    ship(candidates.sparkSession)

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if held.num_rows and asked.num_rows:
            c, uids, ids = _matrix(held), _numbers(held, "uid"), _numbers(held, "vec_id")
            length = (c.astype(np.float64) ** 2).sum(axis=1)
            order = np.lexsort((uids, -length))
            buckets = [Bucket(uids[at], ids[at], c[at]) for at in (order[i : i + BLOCK] for i in range(0, len(order), BLOCK))]
            asked = asked.sort_by("uid")
            q, quids, qids = _matrix(asked), _numbers(asked, "uid"), _numbers(asked, "vec_id")
            least = asked.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            least = np.where(np.isnan(least), -np.inf, least)
            for i in range(0, len(q), QUERY_BLOCK):
                best = Best(quids[i : i + QUERY_BLOCK], qids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], k, least[i : i + QUERY_BLOCK])
                for b in buckets:
                    best.see(b)
                found += [(u, o, v, -s) for u, o, top in zip(best.uids.tolist(), best.ids.tolist(), best.top) for s, v in top]
        kinds = [pa.int64()] * 3 + [pa.int64() if score == "bigint" else pa.float64()]
        names = ["query_uid", "query_id", "vec_id", "score"]
        return pa.table([pa.array([r[j] for r in found], t) for j, t in enumerate(kinds)], names=names)

    keys = ["part", "group"]
    # columns of their own on either side, which may both come from one table
    own = lambda df, *more: df.select(*[F.col(c).alias(c) for c in (*keys, "uid", "vec_id", "vec")], *more).groupBy(*keys)
    left, right = own(candidates), own(queries, F.col("least").cast("double").alias("least"))
    return left.cogroup(right).applyInArrow(run, f"query_uid bigint, query_id bigint, vec_id bigint, score {score}")


def in_groups(rows: DataFrame, groups: int) -> DataFrame:
    """rows, once for each group."""
    return rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def dealt(uid: Column, pieces: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(pieces)).cast("int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best over a query's parts."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def is_query(id_col: Column) -> Column:
    return id_col % 20 == 0
