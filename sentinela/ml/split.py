"""Deterministic train/test split and fold assignment.

A row's side is decided by a hash of its key and the seed, so the split is
stable under re-partitioning, executor loss and re-runs, and never sorts a
class inside one task.  The stratified form gives every class its exact share;
``split_counts`` reports the rows per class and side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.plans.hints import bounded_broadcast, settled


def hash_unit(key: str = K.ID, seed: int | str = 42) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of MD5(key ':' seed)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    return h.cast("long") / F.lit(4294967296.0)


#: Ranges of the hash in which a class is counted to find its cut.
RANGES = 4096


def split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = K.ID,
          out: str = "conjunto", stratify: str | None = None) -> DataFrame:
    """Column ``conjunto`` = 'teste' for a ``test_size`` share, else 'treino'.

    With ``stratify`` every class (NULL is one) gives exactly its rounded share:
    the rows with its smallest hashes.  Rows per class and hash range are
    counted first (pre-aggregated); only the rows of the one range that holds
    a class's cut are put in order.
    """
    if stratify is None:
        return df.withColumn(out, F.when(hash_unit(key, seed) < F.lit(test_size), "teste").otherwise("treino"))
    d = df.withColumns({"__u": hash_unit(key, seed)}).withColumn("__r", F.floor(F.col("__u") * RANGES))
    counts = d.groupBy(F.col(stratify).alias("__c"), "__r").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("__c").orderBy("__r")
    counts = counts.withColumns({"up": F.sum("n").over(run),
                                 "want": F.floor(F.sum("n").over(Window.partitionBy("__c")) * test_size + 0.5)})
    cuts = settled(counts.where(F.col("up") >= F.col("want")).groupBy("__c", "want")
                   .agg(F.min(F.struct("__r", (F.col("up") - F.col("n")).alias("before"))).alias("m"))
                   .select("__c", F.col("m.__r").alias("__cut"), (F.col("want") - F.col("m.before")).alias("__need")))
    j = d.join(bounded_broadcast(cuts), F.col(stratify).eqNullSafe(F.col("__c")))
    order = Window.partitionBy("__c").orderBy("__u", key)
    edge = j.where("__r = __cut").withColumn("__t", F.row_number().over(order) <= F.col("__need"))
    apart = j.where("__r != __cut").withColumn("__t", F.col("__r") < F.col("__cut"))
    return edge.unionByName(apart).select(*df.columns, F.when(F.col("__t"), "teste").otherwise("treino").alias(out))


def fold_column(df: DataFrame, k: int = 5, seed: int = 42, key: str = K.ID, out: str = "fold") -> DataFrame:
    """Fold number 0..k−1 for ``CrossValidator(foldCol=...)``.  The hash is
    salted differently from ``split`` so folds are independent of the split."""
    return df.withColumn(out, F.floor(hash_unit(key, f"{seed}:fold") * F.lit(float(k))).cast("int"))


def split_counts(df: DataFrame, label: str, side: str = "conjunto") -> DataFrame:
    """Rows per class and side (to check the stratification)."""
    return df.groupBy(label, side).agg(F.count(F.lit(1)).alias("n")).orderBy(label, side)
