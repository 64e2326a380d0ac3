"""Feature operators (M1–M3)."""

from __future__ import annotations

from collections.abc import Sequence

import re

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.plans.hints import bounded_broadcast, ranked


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (one row to the driver)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Sequence[str], prefix: str = "z_",
                stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """M1: z-score with the population standard deviation (as the original's
    scaler); a constant column maps to 0.  ``StandardScaler`` is not used: it
    divides by the sample deviation."""
    stats = stats or column_stats(df, cols)
    out = {}
    for c in cols:
        m, s = stats[c]
        if m is None:
            out[prefix + c] = F.lit(None).cast("double")
        elif not s:
            out[prefix + c] = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            out[prefix + c] = (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))
    return df.withColumns(out)


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M3: alphabetical codes from 0 (as a double, like ``StringIndexer``).

    The code table has one row per distinct value; it is numbered by a range
    sort with partition offsets and joined back by broadcast, if it is small: a
    join by a few values would leave as few tasks.  NULL stays NULL.
    """
    out = out or f"{col}_idx"
    codes = ranked(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], out)
    return df.join(bounded_broadcast(codes.withColumn(out, F.col(out).cast("double"))), col, "left")


def _safe(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct non-NULL values of text columns, all in one pass
    (bounded by the columns' cardinalities)."""
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    rows = df.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct().collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_stages(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str], out: str = "features",
                   drop_first: bool = False) -> list:
    """M2: dummies of text columns, numbers pass through, assembled into a vector.

    The levels are read from ``df`` once; the dummies are a ``SQLTransformer``
    with the level list written into its statement, so the fitted pipeline
    scores new data the same way: an unseen or NULL value gives all-zero
    dummies.  ``drop_first`` drops the alphabetically first level, as the
    risk model of the original does.
    """
    exprs, names = [], []
    all_levels = levels(df, list(cat_cols))
    for c in cat_cols:
        lv = all_levels[c]
        for v in (lv[1:] if drop_first else lv):
            name = f"{_safe(c)}_oh_{_safe(v)}"
            while name in names:
                name += "_"
            lit = v.replace("\\", "\\\\").replace("'", "\\'")
            exprs.append(f"CASE WHEN CAST(`{c}` AS STRING) = '{lit}' THEN 1.0 ELSE 0.0 END AS `{name}`")
            names.append(name)
    stages = []
    if exprs:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=names + list(num_cols), outputCol=out, handleInvalid="skip"))
    return stages
