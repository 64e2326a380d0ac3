"""Exact neighbour search on Spark by boxes of a k-d tree (used by M9 LOF; M5 has its own cells in ``ml.density``).

* Exact duplicates are collapsed first into weighted points (rep id = the
  smallest id, weight = multiplicity), so a hot group of identical rows costs
  one point, not a quadratic block.
* Points are parted in boxes over all dimensions. A point meets its own box,
  which bounds its k-distance, and then the boxes within this bound.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.ml.features import standardize
from sentinela.plans.hints import ensure_parallelism, settled
from sentinela.session import ship_package


def sq_dist(a: Column, b: Column) -> Column:
    """Euclidean distance of two equal-length double arrays, summed left to right."""
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v))


def feature_points(df: DataFrame, features: Sequence[str] | None, key: str = K.ID, vector: str | None = None,
                   standardize_features: bool = True) -> DataFrame:
    """(key, x array<double>) for complete rows; from columns or an array column."""
    if vector is not None:
        x = F.transform(F.col(vector), lambda v: v.cast("double"))
        return df.where(F.col(vector).isNotNull()).select(F.col(key), x.alias("x"))
    base = standardize(df, features, prefix="__z_") if standardize_features else \
        df.withColumns({f"__z_{c}": F.col(c).cast("double") for c in features})
    zc = [f"__z_{c}" for c in features]
    ok = F.lit(True)
    for c in zc:
        ok = ok & F.col(c).isNotNull()
    return base.where(ok).select(F.col(key), F.array(*zc).alias("x"))


def collapse(points: DataFrame, key: str = K.ID) -> tuple[DataFrame, DataFrame]:
    """Weighted representatives (rid, x, w) and the row → rep map (key, rid)."""
    reps = points.groupBy("x").agg(F.min(key).alias("rid"), F.count(F.lit(1)).alias("w"))
    mapping = points.join(reps.select("x", "rid"), "x").select(key, "rid")
    return reps, mapping


def blocking_dims(reps: DataFrame, d: int, b: int = 3) -> list[int]:
    """The ``b`` dimensions with the largest spread (one aggregation, d values)."""
    if d <= b:
        return list(range(d))
    st = reps.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.variance("v").alias("s")).collect()
    return [r["i"] for r in sorted(st, key=lambda r: (-(r["s"] or 0.0), r["i"]))[:b]]


#: Points of a box on average, and points that place the boxes. Both decide the work only, the result is exact at any.
BOX_POINTS, PLACING = 1024, 100_000
#: Distances that a task holds at a time.
AT_ONCE = 2_000_000


class Boxes:
    """Cuts of a k-d tree that part the points in about ``count`` boxes, placed by a sample."""

    def __init__(self, sample: np.ndarray, count: int):
        self.feature, self.cut, self.down = [], [], []
        self._add(sample, count)
        self.feature, self.cut, self.down = np.array(self.feature), np.array(self.cut), np.array(self.down).reshape(-1, 2)

    def _add(self, x: np.ndarray, count: int) -> int:
        at = len(self.feature)
        self.feature.append(-1), self.cut.append(0.0), self.down.append((at, at))
        if count >= 2 and len(x) >= 2:
            f = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            values = np.sort(x[:, f])
            middle = values[len(values) // 2]
            cut = middle if middle > values[0] else values[np.searchsorted(values, middle, "right")] if middle < values[-1] else None
            if cut is not None:
                left = x[:, f] < cut
                part = count * left.mean()
                self.feature[at], self.cut[at] = f, cut
                self.down[at] = (self._add(x[left], part), self._add(x[~left], count - part))
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return node
            right = (x[rows, np.maximum(f, 0)] >= self.cut[node]).astype(int)
            node = np.where(f < 0, node, self.down[node, right])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``sq_dist``: summed left to right."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        step = a[:, i, None] - b[None, :, i]
        total += step * step
    return np.sqrt(total)


def _nearest(p: np.ndarray, dist: np.ndarray, q: np.ndarray, qw: np.ndarray, most: np.ndarray, k: int):
    """For each row of ``dist`` (same point: infinite) its at most ``most`` distant points, up to the k-th and its ties."""
    kth = np.partition(dist, k - 1, axis=1)[:, k - 1] if dist.shape[1] > k else np.full(len(dist), np.inf)
    row, col = np.nonzero((dist <= np.minimum(kth, most)[:, None]) & np.isfinite(dist) & (qw > 0))
    start = np.searchsorted(row, np.arange(len(p) + 1))
    for i, (lo, hi) in enumerate(zip(start[:-1], start[1:])):
        own = col[lo:hi]
        yield p[i], q[own], dist[i, own], qw[i, own]


def knn(reps: DataFrame, k: int) -> DataFrame:
    """Exact weighted k nearest neighbours of every representative.

    Returns (p, q, dist, wq): the neighbours of p in (dist, q) order, with the
    multiplicity ``wq`` of q that falls inside the first k (copies of p itself
    count, at distance 0, as sklearn counts distinct rows).

    The points are parted in boxes of a k-d tree over all dimensions. A point
    first meets its own box, which bounds its k-distance, and then the boxes
    that lie within this bound; of each box it keeps the k nearest. What is
    listed are points and boxes, and not pairs of points.
    """
    spark = reps.sparkSession
    ship_package(spark)
    reps = settled(reps.select("rid", "x", "w"))
    n, kind = reps.count(), reps.schema["rid"].dataType.simpleString()
    sample = reps.where(F.pmod(F.xxhash64("rid"), F.lit(-(-n // PLACING))) == 0).select("x").toPandas()
    boxes = spark.sparkContext.broadcast(Boxes(np.vstack(sample.x.to_numpy()) if len(sample) else np.zeros((0, 1)), n // BOX_POINTS))

    @F.pandas_udf("int")
    def box(x: pd.Series) -> pd.Series:
        return pd.Series(boxes.value.of(np.vstack(x.to_numpy())) if len(x) else [], dtype="int32")

    placed = settled(ensure_parallelism(reps).withColumn("box", box("x")))
    d = len(reps.select("x").first()["x"])
    edges = placed.groupBy("box").agg(F.array(*[F.min(F.col("x")[i]) for i in range(d)]).alias("lo"),
                                      F.array(*[F.max(F.col("x")[i]) for i in range(d)]).alias("hi")).orderBy("box").toPandas()
    shared = spark.sparkContext.broadcast((edges.box.to_numpy(), np.vstack(edges.lo.to_numpy()), np.vstack(edges.hi.to_numpy())))
    near = f"array<struct<dist: double, q: {kind}, qw: bigint>>"

    def listed(dist, q, qw) -> list:
        return [{"dist": a, "q": b, "qw": c} for a, b, c in zip(dist.tolist(), q.tolist(), qw.tolist())]

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        """Neighbours in the own box, the distance ``r`` within which all are, and the other boxes within it."""
        ids, lo, hi = shared.value
        x, rid, w = np.vstack(pdf.x.to_numpy()), pdf.rid.to_numpy(), pdf.w.to_numpy()
        own = ids == pdf.box.iloc[0]
        gap = np.sqrt((np.maximum(np.maximum(lo - hi[own], lo[own] - hi), 0) ** 2).sum(axis=1))
        rows = []
        step = max(1, AT_ONCE // len(x))
        for first in range(0, len(x), step):
            part = np.arange(first, min(first + step, len(x)))
            dist, qw = _distances(x[part], x), np.repeat(w[None, :], len(part), axis=0)
            qw[np.arange(len(part)), part] -= 1  # copies of the point itself count, itself does not
            dist[qw == 0] = np.inf
            found = list(_nearest(rid[part], dist, rid, qw, np.full(len(part), np.inf), k))
            for i, (p, q, at, weight) in zip(part, found):
                order = np.argsort(at, kind="stable")
                enough = np.searchsorted(np.cumsum(weight[order]), k)
                r = float(at[order][enough]) if enough < len(order) else np.inf
                some = np.flatnonzero((gap <= r * (1 + 1e-9)) & ~own)
                step_out = np.maximum(np.maximum(lo[some] - x[i], x[i] - hi[some]), 0)
                visit = ids[some[np.sqrt((step_out ** 2).sum(axis=1)) <= r * (1 + 1e-9)]]
                rows.append((p, x[i].tolist(), r, visit.tolist(), listed(at, q, weight)))
        return pd.DataFrame(rows, columns=["p", "x", "r", "visit", "near"])

    met = settled(placed.groupBy("box").applyInPandas(home, f"p {kind}, x array<double>, r double, visit array<int>, near {near}"))

    def call(guests: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(guests) and len(pdf):
            x, rid, w = np.vstack(pdf.x.to_numpy()), pdf.rid.to_numpy(), pdf.w.to_numpy()
            step = max(1, AT_ONCE // len(x))
            for first in range(0, len(guests), step):
                g = guests.iloc[first:first + step]
                dist = _distances(np.vstack(g.x.to_numpy()), x)
                qw = np.broadcast_to(w[None, :], dist.shape)
                rows += [(p, listed(at, q, weight)) for p, q, at, weight in _nearest(g.p.to_numpy(), dist, rid, qw, g.r.to_numpy(), k) if len(q)]
        return pd.DataFrame(rows, columns=["p", "near"])

    guests = met.select("p", "x", "r", F.explode("visit").alias("box"))
    called = guests.groupBy("box").cogroup(placed.groupBy("box")).applyInPandas(call, f"p {kind}, near {near}")
    # one list a point: the k nearest by (dist, q), each with the weight that the ones before leave it
    lists = met.select("p", "near").unionByName(called).groupBy("p").agg(F.flatten(F.collect_list("near")).alias("near"))
    lists = lists.select("p", F.slice(F.array_sort("near"), 1, k).alias("near"))
    before = F.transform("near", lambda e, i: F.struct(
        e["q"].alias("q"), e["dist"].alias("dist"), e["qw"].alias("qw"),
        F.aggregate(F.slice(F.col("near"), F.lit(1), i), F.lit(0).cast("long"), lambda s, v: s + v["qw"]).alias("before")))
    return settled(lists.select("p", F.explode(before).alias("e")).where(F.col("e.before") < k).select(
        "p", "e.q", "e.dist", F.least(F.col("e.qw"), F.lit(k) - F.col("e.before")).alias("wq")))
