"""Exact top-k inner products with MaxScore, shard by shard.

Dimensions are the terms. Within a shard, each dimension's column is its posting list; contributions
of a query are shifted by their least value there, so that they are not negative and have an upper
bound. With the k-th best score so far, terms of the smallest bounds whose sum can't reach it are
non-essential: only the essential ones are traversed for all rows; the others are probed, in steps,
for rows that can still compete. The shards' best rows are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of components that a shard of rows and a block of queries hold; a task has one of each.
SHARD_BYTES, QUERY_BYTES = 32 << 20, 8 << 20
#: With few rows shards are smaller, for tasks to share, but not below this many rows.
LEAST_ROWS = 4096
_MOST, _LEAST = 2**63 - 1, -(2**63)
_SCHEMA = "query_id long, query_hash long, vec_id long, score long"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    out = np.zeros((len(column), d))
    n = np.diff(column.offsets.to_numpy())
    if len(n):
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    # ~ instead of -, which overflows at one end
    return np.lexsort((ids, ~score))[:k]


def _whole(row: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) of each component as whole numbers of any size."""
    return np.array([int(c) * scale if abs(c) >= 2**53 else math.floor(c * scale) for c in row.tolist()], object)


def _wide_scores(rows: list[np.ndarray], query: np.ndarray) -> np.ndarray:
    """Exact products; beyond 64 bits the nearest long."""
    return np.array([min(max(int(r @ query), _LEAST), _MOST) for r in rows], np.int64)


class _Shard:
    """Rows of a shard whose products with plain queries are exact in doubles: posting columns and their bounds."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.columns = np.ascontiguousarray(x.T)
        self.low, self.high = (x.min(0), x.max(0)) if len(x) else (None, None)

    def best(self, row: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows but the query's own."""
        alive = np.flatnonzero(self.ids != own)
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        d = len(row)
        ends = np.stack([row * self.low, row * self.high])
        least, bound = ends.min(0), ends.max(0) - ends.min(0)
        order = np.argsort(-bound, kind="stable")
        base, reach = least.sum(), bound[order][::-1].cumsum()[::-1]  # reach[j]: all that terms j.. can add
        first = alive[: max(256, 4 * k)]
        some = np.sort(self.x[first] @ row)[::-1]
        floor = some[k - 1] if len(some) >= k else None
        essential = d if floor is None else max(1, int(np.count_nonzero(base + reach >= floor)))
        terms = order[:essential]
        score = (base + row[terms] @ self.columns[terms] - least[terms].sum())[alive]
        if essential < d and len(alive) > 16 * k:  # the rows that lead so far, scored in full, raise the floor
            lead = np.argpartition(score, len(score) - 16 * k)[-16 * k :]
            floor = max(floor, np.sort(self.x[alive[lead]] @ row)[-k])
        at = essential
        while at < d:
            keep = score + reach[at] >= floor
            alive, score = alive[keep], score[keep]
            terms = order[at : at + 8]
            if 4 * len(alive) > len(self.ids):  # whole stretches of postings are read faster than many places in them
                more = (row[terms] @ self.columns[terms])[alive]
            else:
                more = self.x[np.ix_(alive, terms)] @ row[terms]
            score = score + more - least[terms].sum()
            at += 8
        score = score.astype(np.int64)
        top = _best(score, self.ids[alive], k)
        return score[top], self.ids[alive][top]


def _search(key, rows: pa.Table, queries: pa.Table, k: int, scale: int) -> pa.Table:
    if not rows.num_rows or not queries.num_rows:
        return pa.table([[]] * 4, pa.schema([(n, pa.int64()) for n in ("query_id", "query_hash", "vec_id", "score")]))
    rows, queries = rows.combine_chunks(), queries.combine_chunks()
    x, q = (t.column("v").chunk(0) for t in (rows, queries))
    d = max([1, *(int(np.diff(v.offsets.to_numpy()).max()) for v in (x, q))])
    raw, raw_q = _matrix(x, d), _matrix(q, d)
    ids, own = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    hashes = queries.column("query_hash").to_numpy()
    most = math.sqrt(2**52 / d)  # components up to this keep products and their sums exact in doubles
    with np.errstate(over="ignore"):
        plain, plain_q = (np.abs(m).max(1) * scale + 1 <= most for m in (raw, raw_q))
    shard = _Shard(np.floor(raw[plain] * scale), ids[plain])
    wide = [_whole(r, scale) for r in raw[~plain]]
    every = [_whole(r, scale) for r in raw] if not plain_q.all() else []
    out: list[list] = [[], [], [], []]
    for i in range(len(own)):
        if plain_q[i]:
            score, found = shard.best(np.floor(raw_q[i] * scale), own[i], k)
            if wide:
                score = np.concatenate([score, _wide_scores(wide, _whole(raw_q[i], scale))])
                found = np.concatenate([found, ids[~plain]])
        else:  # bounds in doubles don't hold: every row is scored by whole numbers
            score, found = _wide_scores(every, _whole(raw_q[i], scale)), ids
        score, found = score[found != own[i]], found[found != own[i]]
        top = _best(score, found, k)
        out[0] += [own[i]] * len(top)
        out[1] += [hashes[i]] * len(top)
        out[2] += found[top].tolist()
        out[3] += score[top].tolist()
    return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "query_hash", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: the k best rows of each query.

    Queries: rows whose vec_id is divisible by every. Components become floor(scale * x); the score is
    their inner product (the nearest long where it is beyond 64 bits), ties go to the smaller vec_id. All rows
    but those with the query's own vec_id compete. Vectors that are null or hold a null or non-finite component, and rows without vec_id, take
    no part. A vector shorter than another counts as ended by zeros. A repeated row competes as often as
    it occurs and is searched for once. No rows or no queries: an empty table. Other columns are ignored.
    """
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sane = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    ints = sane.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    asked = ints.where(F.col("vec_id") % every == 0)
    n, m, d = ints.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    few = min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS)
    shards, blocks = max(1, few, -(-n * d * 8 // SHARD_BYTES)), max(1, -(-m * d * 8 // QUERY_BYTES))
    spread = F.xxhash64("vec_id")
    queries = asked.distinct().withColumn("query_hash", F.xxhash64("v")).withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = ints.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = rows.groupBy("block", "shard").cogroup(queries.groupBy("block", "shard")).applyInArrow(_searcher(k, scale), _SCHEMA)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, scale: int):
    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        return _search(key, rows, queries, k, scale)

    return search
