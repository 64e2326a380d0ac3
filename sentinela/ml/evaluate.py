"""Evaluation of predictions as SQL aggregates.

Inputs are tables (id, group, label, prediction); all work is group-by on
the k × k confusion cells, so the cost is one pass over the predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators import profile as P
from sentinela.operators._common import ensure_hour, n_rows
from sentinela.plans.hints import precounted


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M18 long form: (label, prediction, n) for every non-empty cell."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n")).orderBy(label, prediction)


def confusion_matrix_wide(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M18 wide form over the complete class list (labels ∪ predictions), 0-filled."""
    classes = sorted({r[0] for r in df.select(F.explode(F.array(label, prediction))).distinct().collect()
                      if r[0] is not None})
    cells = confusion_matrix(df, label, prediction)
    wide = cells.groupBy(label).pivot(prediction, classes).agg(F.first("n")).fillna(0)
    lab = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    return lab.join(wide, label, "left").fillna(0).orderBy(label)


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted
    averages and accuracy (0 on zero division)."""
    cells = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    contrib = cells.select(F.explode(F.array(
        F.struct(F.col(label).alias("classe"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("pred"),
                 F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col(prediction).alias("classe"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("pred"),
                 F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    per = contrib.where(F.col("classe").isNotNull()).groupBy("classe").agg(
        F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("pred").alias("pred"))
    p = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumns({"precision": p, "recall": r})
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      F.lit(2.0) * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    rnd = lambda c: S.round_half_up(c, digits)
    classes = per.select("classe", rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                         rnd("f1").alias("f1"), F.col("support").cast("long").alias("support"))
    tot = per.agg(F.sum("support").alias("s"), F.sum("tp").alias("tp"), F.avg("precision").alias("mp"),
                  F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    macro = tot.select(F.lit("macro avg").alias("classe"), rnd("mp").alias("precision"), rnd("mr").alias("recall"),
                       rnd("mf").alias("f1"), F.col("s").cast("long").alias("support"))
    w = lambda c: F.when(F.col("s") > 0, F.col(c) / F.col("s")).otherwise(0.0)
    weighted = tot.select(F.lit("weighted avg").alias("classe"), rnd(w("wp")).alias("precision"),
                          rnd(w("wr")).alias("recall"), rnd(w("wf")).alias("f1"), F.col("s").cast("long").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("classe"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), rnd(w("tp")).alias("f1"),
                     F.col("s").cast("long").alias("support"))
    return classes.unionByName(macro).unionByName(weighted).unionByName(acc)


def fairness_by_group(df: DataFrame, group: str = K.ZONE, label: str = "label", prediction: str = "prediction",
                      factor: float = K.FAIRNESS_FACTOR, digits: int = 6) -> DataFrame:
    """Error rate per group, descending; groups above ``factor`` × the mean
    error of all rows are flagged.  The overall mean is a scalar subquery over
    the per-group table (one row per group)."""
    err = F.when(F.col(label) != F.col(prediction), 1).otherwise(0)
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum(err).alias("e"), F.count(F.lit(1)).alias("t"))
    g = g.withColumns({"erro": F.col("e") / F.col("t"), "__m": g.agg(F.sum("e") / F.sum("t")).scalar()})
    return g.select(group, S.round_half_up("erro", digits).alias("erro"),
                    (F.col("erro") > F.col("__m") * F.lit(factor)).alias("vies")) \
        .orderBy(F.col("erro").desc(), F.col(group).asc())


def anomaly_profile(df: DataFrame, flag: str = "anomalia", ts: str = K.TS) -> DataFrame:
    """Profile of flagged rows as long rows (item, chave, n, pct): count and
    share of all rows, commonest type, zone and hour, top-3 type shares."""
    def row(item, chave, n, pct):
        return [F.lit(item).alias("item"), (chave.cast("string") if chave is not None
                                             else F.lit(None).cast("string")).alias("chave"),
                n.cast("long").alias("n"), (pct if pct is not None else F.lit(None)).cast("double").alias("pct")]
    d = precounted(ensure_hour(df, ts), [flag, K.TYPE, K.ZONE, "hora"])
    a = d.where(F.col(flag) == -1)
    tot = d.agg(n_rows(d, F.col(flag) == -1).alias("k"), n_rows(d).alias("t")) \
        .select(*row("total", None, F.col("k"), S.pct("k", "t", 1)))
    t = P.global_mode(a, K.TYPE).select(*row("tipo_comum", F.col(K.TYPE), F.col("n"), None))
    z = P.global_mode(a, K.ZONE).select(*row("bairro_comum", F.col(K.ZONE), F.col("n"), None))
    h = P.global_mode(a, "hora").select(*row("hora_comum", F.col("hora"), F.col("n"), None))
    top3 = P.share_table(a, K.TYPE, 3).select(*row("tipo_top3", F.col(K.TYPE), F.col("n"), F.col("pct")))
    return tot.unionByName(t).unionByName(z).unionByName(h).unionByName(top3)
