"""k-means on integer vectors; the nearest centroid is found by the threshold algorithm.

For each dimension the centroids are kept as a list sorted by their value
there. A vector walks each list outward from its own value, nearest first; a
centroid met in any list gets its exact distance. What the lists hold beyond
the frontier is, in each dimension, at least as far as the frontier, so a
centroid not met yet is at least the sum of the squared frontier distances
away. A vector stops once that sum is strictly above its best exact distance,
so ties are always met and go to the smaller number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.llm._base import for_python, stash

#: Up to this size of a component all distances fit a 64-bit integer; beyond it Python's integers are used.
SMALL = 1 << 26
#: Vectors whose working arrays are held at once.
STEP = 2048
#: Sums of components travel as limbs of so many bits, which carry the sign; their sums over all tasks fit a long.
LIMB = 36
LONG = (1 << 63) - 1


def usable(vector: Column, size: int) -> Column:
    """Vectors of exactly ``size`` components, all of them finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def quantised(grid: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, x as double, exactly; Python integers where some are large."""
    with np.errstate(over="ignore"):
        values = np.floor(scale * grid.astype(np.float64))
    if not np.isfinite(values).all():  # scale * x is beyond a double: the exact product
        return np.array([[int(scale) * int(x) if abs(x) >= 2.0 ** 53 else int(np.floor(scale * x)) for x in row]
                         for row in grid.astype(np.float64)], object).reshape(grid.shape)
    if np.abs(values).max(initial=0.0) <= SMALL:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(grid.shape)


class Lists:
    """Sorted centroid lists, one for each dimension."""

    def __init__(self, centroids: list[list[int]]):
        large = max((abs(x) for c in centroids for x in c), default=0) > SMALL
        self.grid = np.array(centroids, object if large else np.int64)
        self.order = np.argsort(self.grid, axis=0, kind="stable")
        self.values = np.take_along_axis(self.grid, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector the nearest centroid, its squared distance, and how many exact distances it took."""
        kind = object if object in (vectors.dtype, self.grid.dtype) else np.int64
        parts = [self._walk(vectors[i:i + STEP].astype(kind), self.grid.astype(kind)) for i in range(0, len(vectors), STEP)]
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))

    def _walk(self, x: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = x.shape
        k = len(grid)
        dims = np.arange(width)[None, :]
        values = self.values.astype(x.dtype)
        right = (values[:, None, :] < x[None, :, :]).sum(axis=0).astype(np.int64)  # the next list places to the right,
        left = right - 1                                                          # and to the left
        number, best = np.full(n, k), np.zeros(n, x.dtype)
        met, alive, took = np.zeros((n, k), bool), np.arange(n), np.zeros(n, np.int64)
        for _ in range(k):
            v = x[alive]
            l, r = left[alive], right[alive]
            to_left = v - values[np.maximum(l, 0), dims]
            to_right = values[np.minimum(r, k - 1), dims] - v
            go_left = (r >= k) | ((l >= 0) & (to_left <= to_right))
            gap = np.where(go_left, to_left, to_right)
            seen = self.order[np.where(go_left, l, np.minimum(r, k - 1)), dims]
            left[alive], right[alive] = l - go_left, r + ~go_left
            new = np.zeros((len(alive), k), bool)
            new[np.arange(len(alive))[:, None], seen] = True
            new &= ~met[alive]
            met[alive] |= new
            for c in range(k):
                rows = np.flatnonzero(new[:, c])
                if len(rows):
                    exact = ((v[rows] - grid[c]) ** 2).sum(axis=1)
                    at = alive[rows]
                    better = (number[at] == k) | (exact < best[at]) | ((exact == best[at]) & (c < number[at]))
                    number[at[better]], best[at[better]] = c, exact[better]
                    took[at] += 1
            beyond = (gap ** 2).sum(axis=1) > best[alive]
            alive = alive[~beyond]
            if not len(alive):
                break
        return number, best, took


def _split(value: int) -> list[int]:
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _gathered(batches) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``STEP`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= STEP:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _grid(column: pa.Array, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return quantised(flat.reshape(len(column), -1), scale)


def _sums(vectors: DataFrame, centroids: list[list[int]], scale: float) -> list:
    """(cluster, dim, limb, s): limbs of the sum of each cluster and dimension, added up by Spark; limb -1 is the count."""
    lists = vectors.sparkSession.sparkContext.broadcast(Lists(centroids))

    def run(batches):
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in _gathered(batches):
            x = _grid(batch.column(0), scale)
            number = lists.value.nearest(x)[0]
            for c in np.unique(number):
                own = x[number == c]
                n, run = totals.get(int(c), (0, np.zeros(x.shape[1], object)))
                totals[int(c)] = n + len(own), run + own.sum(axis=0).astype(object)
        rows = [(c, d, i, x) for c, (n, run) in totals.items() for d, s in enumerate(run)
                for i, x in [(-1, n), *enumerate(_split(int(s)))]]
        names = ["cluster", "dim", "limb", "s"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)

    return (vectors.select("vector").mapInArrow(run, "cluster long, dim long, limb long, s long")
            .groupBy("cluster", "dim", "limb").agg(F.sum("s").alias("s")).collect())


def cluster(df: DataFrame, key: str, vector: str, size: int, k: int, rounds: int, scale: float, seed: str) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid (array of decimal text) per usable vector.

    Components count as floor(scale * x). The k centroids start as the usable
    vectors with the smallest sha256 of ``<seed>:<key>``, in that order (rows
    without a key last, ties by the vector; fewer vectors, fewer centroids).
    Each round puts every vector to the nearest centroid (squared Euclidean
    distance, ties to the smaller number) and moves each non-empty one to the
    floor of the exact mean; then vectors are assigned once more. Vectors of
    another length, null, or with a null or non-finite component take no part.
    Repeated keys and vectors count each for itself. All sums are exact;
    distances and inertias stop at the limit of a long. Further columns play no
    part. An empty table gives no rows.

    Every round reads all vectors once where they are; only k * size sums a
    task are shuffled, and k * size rows come to the driver.
    """
    for_python(df.sparkSession)
    rows = stash(df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").alias("vector"))
                 .where(usable(F.col("vector"), size)), "vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = rows.orderBy(place.asc_nulls_last(), "vector").limit(k).collect()
    if not first:
        return rows.select("key", *[F.lit(0).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))],
            F.array().cast("array<string>").alias("centroid"))
    centroids = [[int(x) for x in quantised(np.array([r["vector"]], np.float64), scale)[0]] for r in first]
    for _ in range(rounds):
        totals, counts = {}, {}
        for r in _sums(rows, centroids, scale):
            at = r["cluster"], r["dim"]
            if r["limb"] < 0:
                counts[at] = r["s"]
            else:
                totals[at] = totals.get(at, 0) + (r["s"] << (LIMB * r["limb"]))
        for (c, d), n in counts.items():
            centroids[c][d] = totals.get((c, d), 0) // n
    lists = df.sparkSession.sparkContext.broadcast(Lists(centroids))

    def assign(batches):
        for batch in _gathered(batches):
            number, distance, _ = lists.value.nearest(_grid(batch.column(1), scale))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int32()), pa.array([min(int(x), LONG) for x in distance], pa.int64())],
                ["key", "cluster", "distance"])

    found = stash(rows.mapInArrow(assign, "key long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(sum(int(s) for s in sums.values()), LONG)
    ends = df.sparkSession.createDataFrame([(c, min(int(sums[c]), LONG), [str(x) for x in centroids[c]]) for c in sorted(sums)],
                                           "cluster int, cluster_inertia long, centroid array<string>")
    return (found.join(F.broadcast(ends), "cluster")
            .select("key", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid"))
