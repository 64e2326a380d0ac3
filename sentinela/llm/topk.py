"""Exact top-k by inner product: columnar branch-and-bound over blocks.

Vectors are packed into blocks stored dimension by dimension (vertical layout).
A block of queries meets a block of candidates in one task. Scores are
accumulated over one block of dimensions at a time; after each, what the
remaining dimensions can still add is bounded by the product of the remaining
norms (the remaining mass), and candidates that cannot reach a query's k-th
best score any more are compacted away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm._base import for_python, stash

#: Rows in a block of candidates and of queries, candidate blocks a task takes in turn, dimensions at a time.
CANDIDATE_ROWS, QUERY_ROWS, CHAIN, DIMS = 2048, 2048, 2, 16
LONG = 2 ** 63
#: What a block of queries has found: ids and row numbers of query and candidate, and the score.
FOUND = ["query_id", "query_row", "vec_id", "row", "score"]


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; null unless every component is a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")))


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: ids, and components as a dimensions x rows matrix; shorter vectors get zeros."""
    frame = frame.sort_values(["id", "row"], kind="stable")
    width = max((len(v) for v in frame.vector), default=0)
    grid = np.zeros((width, len(frame)))
    for i, v in enumerate(frame.vector):
        grid[:len(v), i] = v
    return pd.DataFrame({"block": [frame.block.iloc[0]], "ids": [frame[["id", "row"]].to_numpy(np.int64).T.tobytes()],
                         "grid": [grid.tobytes()]})


def _blocks(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    count = max(1, -(-df.count() // rows))
    dealt = df.select(F.pmod(F.xxhash64("row"), F.lit(count)).alias("block"), "id", "row", "vector")
    return dealt.groupBy("block").applyInPandas(_pack, "block long, ids binary, grid binary"), count


def _grid(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and row numbers (2 x rows), and the components (dimensions x rows) of a block."""
    ids = np.frombuffer(ids, np.int64).reshape(2, -1)
    return ids, np.frombuffer(data, np.float64).reshape(-1, ids.shape[1])


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[0] >= width else np.vstack([a, np.zeros((width - a.shape[0], a.shape[1]))])


class Search:
    """The best k so far of each query of one block; candidates come block after block."""

    def __init__(self, ids: np.ndarray, grid: np.ndarray, k: int):
        self.ids, self.grid, self.k = ids, grid, k
        self.best = [(np.empty(0, object), np.empty((2, 0), np.int64)) for _ in ids[0]]

    def add(self, ids: np.ndarray, grid: np.ndarray) -> None:
        width = max(len(grid), len(self.grid))
        q, c = _wide(self.grid, width), _wide(grid, width)
        largest = [np.abs(x).max(initial=0.0) for x in (q, c)]
        if largest[0] * largest[1] * max(width, 1) >= 2.0 ** 52:  # doubles would round: exact integers instead
            ints = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c)]
            scores = ints[0].T.dot(ints[1]) if width else np.zeros((q.shape[1], c.shape[1]), object)
            for i in range(len(self.best)):
                self._keep(i, scores[i], ids)
            return
        cuts = list(range(0, width, DIMS)) or [0]
        # Remaining mass: norms over the dimensions after each block, one row per block of dimensions.
        rest = [[np.sqrt((m[d + DIMS:] ** 2).sum(axis=0)) for d in cuts] for m in (q, c)]
        head = q[:DIMS].T @ c[:DIMS]  # the first block of dimensions for all pairs
        for i in range(len(self.best)):
            part, alive = head[i], None
            for step, d in enumerate(cuts):
                if step:
                    block = c[d:d + DIMS] if alive is None else c[d:d + DIMS, alive]
                    part = part + q[d:d + DIMS, i] @ block
                if step + 1 == len(cuts):
                    break
                slack = rest[0][step][i] * (rest[1][step] if alive is None else rest[1][step][alive]) + 1.0
                floor = float(self.best[i][0][-1]) if len(self.best[i][0]) == self.k else -np.inf
                if len(part) > self.k:
                    floor = max(floor, np.partition(part - slack, len(part) - self.k - 1)[len(part) - self.k - 1])
                keep = part + slack >= floor
                if keep.sum() < 0.7 * len(keep):
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    part = part[keep]
            self._keep(i, part, ids if alive is None else ids[:, alive])

    def _keep(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids[1] != self.ids[1, i]  # all rows but the query's own
        scores, ids = scores[other], ids[:, other]
        if scores.dtype != object and len(scores) > 4 * self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[:, near]
        if scores.dtype != object:
            scores = scores.astype(np.int64)
        scores = np.concatenate([self.best[i][0], scores.astype(object)])
        ids = np.concatenate([self.best[i][1], ids], axis=1)
        order = sorted(range(len(scores)), key=lambda j: (-scores[j], ids[0, j], ids[1, j]))[:self.k]
        self.best[i] = (scores[order], ids[:, order])

    def rows(self) -> pd.DataFrame:
        rows = [(int(q), int(row), int(v), int(other), max(-LONG, min(LONG - 1, int(s))))
                for q, row, (scores, ids) in zip(*self.ids, self.best) for s, v, other in zip(scores, *ids)]
        return pd.DataFrame(rows, columns=FOUND).astype("int64")


def top_k(vectors: DataFrame, key: str, vector: Column, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query row with every other row.

    ``vector`` holds integers as doubles (see ``quantised``); ``queries`` marks the
    query rows. Ties go to the smaller id; with fewer than ``k`` others all are
    returned. Rows with a null key or a null vector take no part. Rows that
    repeat a key count each for itself, as queries and as candidates of each
    other; equal scores of one id may come in any order. Shorter vectors count as
    padded with zeros; an empty vector scores 0. Scores are exact and stop at
    the limits of a long. An empty table gives no rows.

    Every query block meets every candidate block once, in a task that holds one
    query block and a chain of ``CHAIN`` candidate blocks; the k-th best score of
    one block is the bound for the next.
    """
    for_python(vectors.sparkSession)
    rows = stash(vectors.select(F.col(f"`{key}`").cast("long").alias("id"), vector.alias("vector"),
                                queries.alias("asks"))
                 .where("id is not null and vector is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    packed, count = _blocks(rows, CANDIDATE_ROWS)
    packed_queries, asked_count = _blocks(rows.where("asks"), QUERY_ROWS)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = packed.select(F.floor(F.col("block") / CHAIN).alias("chain"), upto(asked_count).alias("asked"),
                               "block", "ids", "grid")
    asked = packed_queries.select(upto(-(-count // CHAIN)).alias("chain"), F.col("block").alias("asked"),
                                  "ids", "grid")

    def meet(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame(columns=FOUND, dtype="int64")
        found = Search(*_grid(queries.ids.iloc[0], queries.grid.iloc[0]), k)
        for _, block in blocks.sort_values("block").iterrows():
            found.add(*_grid(block.ids, block.grid))
        return found.rows()

    found = (asked.groupBy("chain", "asked").cogroup(candidates.groupBy("chain", "asked"))
             .applyInPandas(meet, ", ".join(f"{c} long" for c in FOUND)))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
