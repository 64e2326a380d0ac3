"""Profiles, rates, modes, KPIs and top-N.

Every aggregation is a hash aggregation with a partial (map-side) phase, so a
zone or type holding a third of all rows is pre-aggregated in every task
before the shuffle; no group is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators._common import counted, ensure_dow, ensure_hour, n_rows
from sentinela.sources import dims
from sentinela.plans.hints import fixed_broadcast


def frequency(df: DataFrame, col: str, n: str = "n") -> DataFrame:
    """A1: count per value (NULL dropped), count descending, value ascending."""
    return counted(df, [col], n).orderBy(F.col(n).desc(), F.col(col).asc())


def top_n(df: DataFrame, col: str, k: int, n: str = "n") -> DataFrame:
    """The ``k`` most frequent values; ties by value.  Plans as
    TakeOrderedAndProject over the (small) aggregated table."""
    return frequency(df, col, n).limit(k)


def _with_total(df: DataFrame, col: str, n: str) -> DataFrame:
    """Counts per value and, as a scalar subquery over the same counts, the grand
    total including the NULL group."""
    c = df.groupBy(col).agg(n_rows(df).alias(n))
    return c.withColumn("__total", c.agg(F.sum(n)).scalar()).where(F.col(col).isNotNull())


def share_table(df: DataFrame, col: str, k: int | None = None, n: str = "n",
                digits: int = 1) -> DataFrame:
    """Value, count and percent of all rows (NULL keys count in the total)."""
    t = _with_total(df, col, n)
    t = t.select(col, n, S.pct(F.col(n), F.col("__total"), digits).alias("pct")) \
        .orderBy(F.col(n).desc(), F.col(col).asc())
    return t.limit(k) if k is not None else t


def hour_histogram(df: DataFrame, ts: str = K.TS, hour: str = "hora") -> DataFrame:
    """A2: counts by hour, ordered by hour."""
    return counted(ensure_hour(df, ts, hour), [hour]).orderBy(hour)


def peak(df_counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Largest count, lowest key on ties (``idxmax`` after sorting by key)."""
    return df_counts.orderBy(F.col(n).desc(), F.col(key).asc()).limit(1)


def peak_hour(df: DataFrame, ts: str = K.TS, hour: str = "hora") -> DataFrame:
    """A2: the hour with the largest count."""
    return peak(hour_histogram(df, ts, hour), hour)


def weekday_histogram(df: DataFrame, ts: str = K.TS, names: Sequence[str] = K.WEEKDAYS_LOWER) -> DataFrame:
    """A3 + J7: counts Monday…Sunday including days without rows (0)."""
    c = counted(ensure_dow(df, ts), ["dow"])
    wd = fixed_broadcast(dims.weekdays(df.sparkSession, names))
    return (wd.join(c, "dow", "left")
            .select("dow", "dia_semana", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
            .orderBy("dow"))


def peak_day(df: DataFrame, ts: str = K.TS, names: Sequence[str] = K.WEEKDAYS_LOWER) -> DataFrame:
    """A3: weekday with the largest count (first in week order on ties)."""
    return peak(weekday_histogram(df, ts, names), "dow")


def monthly_trend(df: DataFrame, ts: str = K.TS) -> DataFrame:
    """A4: count per year-month, chronological."""
    return counted(df.withColumn("mes_ano", S.month_key(ts)), ["mes_ano"]).orderBy("mes_ano")


def group_mean(df: DataFrame, key: str, value: str, out: str | None = None, digits: int = 2,
               k: int | None = None) -> DataFrame:
    """Mean of ``value`` per ``key`` (NULL keys dropped), descending."""
    out = out or f"media_{value}"
    g = (df.where(F.col(key).isNotNull()).groupBy(key)
         .agg(F.avg(value).alias("__m"))
         .where(F.col("__m").isNotNull())
         .select(key, S.round_half_up("__m", digits).alias(out)))
    g = g.orderBy(F.col(out).desc(), F.col(key).asc())
    return g.limit(k) if k else g


def conditional_rate(df: DataFrame, key: str, predicate: Column, of: str | None = None,
                     digits: int = 1) -> DataFrame:
    """A10: per ``key``: total, matches and 100·matches/total.

    ``of`` = column whose non-NULL values form the denominator (the first
    dashboard counts non-NULL status); ``None`` = all rows (second dashboard).
    """
    den = F.count(F.col(of)) if of else F.count(F.lit(1))
    g = (df.where(F.col(key).isNotNull()).groupBy(key)
         .agg(den.alias("total"), F.count(F.when(predicate, 1)).alias("casos")))
    return g.withColumn("taxa", S.pct("casos", "total", digits)).orderBy(F.col("taxa").desc(), key)


def best_worst(rates: DataFrame, key: str, rate: str = "taxa") -> DataFrame:
    """Key with highest and lowest rate (ties: lowest key), one pass."""
    best = F.min(F.struct((-F.col(rate)).alias("r"), F.col(key).alias("k")))
    worst = F.min(F.struct(F.col(rate).alias("r"), F.col(key).alias("k")))
    a = rates.agg(best.alias("b"), worst.alias("w"))
    return a.select(F.explode(F.array(
        F.struct(F.lit("melhor").alias("posicao"), F.col("b.k").alias(key), (-F.col("b.r")).alias(rate)),
        F.struct(F.lit("pior").alias("posicao"), F.col("w.k").alias(key), F.col("w.r").alias(rate)),
    )).alias("x")).select("x.*")


def overall_rates(df: DataFrame, predicates: dict[str, Column], digits: int | dict = 1) -> DataFrame:
    """Share in percent of rows matching each predicate; 0 for empty input.
    ``digits`` is one number or a per-name dictionary (default 1)."""
    nd = (lambda k: digits.get(k, 1)) if isinstance(digits, dict) else (lambda k: digits)
    aggs = [n_rows(df).alias("__t")] + [n_rows(df, p).alias(f"__{k}") for k, p in predicates.items()]
    a = df.agg(*aggs)
    return a.select(*[S.pct(F.col(f"__{k}"), F.col("__t"), nd(k)).alias(k) for k in predicates])


def distinct_counts(df: DataFrame, cols: Iterable[str], exact: bool = True, rsd: float = 0.05) -> DataFrame:
    """Number of distinct non-NULL values per column (one row).

    ``exact=False`` uses HyperLogLog++ (constant memory per column, relative
    standard deviation ``rsd``), the choice for very high-cardinality columns
    at scale.
    """
    if exact:
        return df.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in cols if c in df.columns])
    return df.agg(*[F.approx_count_distinct(F.col(c), rsd).alias(f"n_{c}") for c in cols if c in df.columns])


def _mode_struct(n: str, v: str) -> Column:
    # minimum of (−count, value): highest count, lowest value on ties
    return F.min(F.struct((-F.col(n)).alias("neg"), F.col(v).alias("v")))


def global_mode(df: DataFrame, col: str) -> DataFrame:
    """The most frequent non-NULL value and its count (lowest value on ties)."""
    c = counted(df, [col], "__n")
    return c.agg(_mode_struct("__n", col).alias("m")).select(
        F.col("m.v").alias(col), (-F.col("m.neg")).alias("n"))


def mode_by_group(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per group, the most frequent value of each column.

    Two-level aggregation: counts per (key, value) — partial aggregation
    absorbs hot keys — then a min-by-struct per key.  Columns are processed
    in one shuffle by exploding (column, value) pairs.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    long = (df.where(F.col(key).isNotNull()).select(key, pairs.alias("p")).select(key, "p.c", "p.v")
            .groupBy(key, "c", "v").agg(F.count(F.lit(1)).alias("n")))
    # NULL values keep their group in the result but are nobody's mode
    best = long.groupBy(key, "c").agg(F.min(F.when(F.col("v").isNotNull(), F.struct(
        (-F.col("n")).alias("neg"), F.col("v").alias("v")))).alias("m"))
    wide = best.groupBy(key).pivot("c", list(cols)).agg(F.first("m.v"))
    return wide.select(key, *[F.col(c).alias(f"moda_{c}") for c in cols])


def mean_diversity(df: DataFrame, zone: str = K.ZONE, type_col: str = K.TYPE, digits: int = 6) -> DataFrame:
    """Mean over zones of the number of distinct types."""
    per = df.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count_distinct(type_col).alias("d"))
    return per.agg(S.round_half_up(F.avg("d"), digits).alias("diversidade_media"))


def concentration(df: DataFrame, col: str, k: int = 3, digits: int = 1) -> DataFrame:
    """Share of the ``k`` most frequent values in all rows."""
    top = _with_total(df, col, "n").orderBy(F.col("n").desc(), F.col(col).asc()).limit(k)
    a = top.agg(F.sum("n").alias("s"), F.max("__total").alias("t"))
    # an all-NULL column has no top values: share 0
    return a.select(S.pct(F.coalesce(F.col("s"), F.lit(0)), F.coalesce(F.col("t"), F.lit(0)), digits).alias("concentracao"))


def kpis_general(df: DataFrame, keep: Column, zone: str = K.ZONE) -> DataFrame:
    """Total and filtered totals, difference, anomalies, clusters, high-risk
    rows and zones of the filtered set — one aggregation over the base table."""
    has = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("total"), F.count(F.when(keep, 1)).alias("filtrado")]
    aggs.append(F.count(F.when(keep & (F.col("anomalia") == -1), 1)).alias("anomalias") if "anomalia" in has
                else F.lit(0).cast("long").alias("anomalias"))
    aggs.append(F.count_distinct(F.when(keep, F.col("cluster"))).alias("clusters") if "cluster" in has
                else F.lit(0).cast("long").alias("clusters"))
    aggs.append(F.count(F.when(keep & (F.col("nivel_risco") == K.RISK_HIGH), 1)).alias("alto_risco")
                if "nivel_risco" in has else F.lit(None).cast("long").alias("alto_risco"))
    aggs.append(F.count_distinct(F.when(keep, F.col(zone))).alias("bairros"))
    return df.agg(*aggs).withColumn("diferenca", F.col("filtrado") - F.col("total"))


def kpis_cases(df: DataFrame, digits: int = 1) -> DataFrame:
    """Total, resolution rate, firearm cases, multi-victim cases, precincts."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col(K.STATUS) == K.STATUS_DONE, 1)).alias("__done"),
        F.count(F.when(F.col(K.WEAPON) == K.FIREARM, 1)).alias("arma_fogo"),
        F.count(F.when(F.col(K.VICTIMS) > 1, 1)).alias("multiplas_vitimas"),
        F.count_distinct(K.PRECINCT).alias("delegacias"),
    ).select("total", S.pct("__done", "total", digits).alias("taxa_resolucao"),
             "arma_fogo", "multiplas_vitimas", "delegacias")


def summary(df: DataFrame, ts: str = K.TS) -> DataFrame:
    """Total, zones, span in whole days (floor of elapsed time), types."""
    a = df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(K.ZONE).alias("bairros"),
               F.min(ts).alias("__a"), F.max(ts).alias("__b"), F.count_distinct(K.TYPE).alias("tipos"))
    # elapsed microseconds without any time-zone conversion (also for timestamp_ntz)
    span = F.floor(F.expr("timestampdiff(MICROSECOND, __a, __b)") / F.lit(86_400_000_000)).cast("long")
    return a.select("total", "bairros", span.alias("periodo_dias"), "tipos")


def risk_indicators(df: DataFrame, digits: int = 1) -> DataFrame:
    """Count and percent for firearm, multiple victims, multiple suspects."""
    a = df.agg(F.count(F.lit(1)).alias("t"),
               F.count(F.when(F.col(K.WEAPON) == K.FIREARM, 1)).alias("arma_fogo"),
               F.count(F.when(F.col(K.VICTIMS) > 1, 1)).alias("multiplas_vitimas"),
               F.count(F.when(F.col(K.SUSPECTS) > 1, 1)).alias("multiplos_suspeitos"))
    ind = ["arma_fogo", "multiplas_vitimas", "multiplos_suspeitos"]
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("indicador"), F.col(i).alias("n"), S.pct(i, "t", digits).alias("pct"))
        for i in ind])).alias("x")).select("x.*")


def anomalies_by(df: DataFrame, col: str, k: int | None = None, flag: str = "anomalia") -> DataFrame:
    """A1 on the anomalous rows (by hour, type or the top-k zones)."""
    f = frequency(df.where(F.col(flag) == -1), col)
    return f.limit(k) if k else f


def scope_counts(df: DataFrame, types: Sequence[str] = K.CASE_TYPES, type_col: str = K.TYPE) -> DataFrame:
    """Loaded rows and counts of the named types (0 if absent)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count(F.when(F.col(type_col) == t, 1)).alias(f"n_{i}") for i, t in enumerate(types)])


def latest(df: DataFrame, ts: str = K.TS, key: str = K.ID) -> DataFrame:
    """Newest first (ties by id)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).asc())


def most_severe(df: DataFrame, k: int = 10, key: str = K.ID) -> DataFrame:
    """Level 'Alta', index descending, first ``k``."""
    return (df.where(F.col("nivel_gravidade") == "Alta")
            .orderBy(F.col("indice_gravidade").desc(), F.col(key).asc()).limit(k))


def sample_rows(df: DataFrame, k: int, ts: str = K.TS, key: str = K.ID) -> DataFrame:
    """T4: the first ``k`` rows in an explicit order (time, then id)."""
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(key).asc()).limit(k)


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """T5."""
    return df.orderBy(*keys)


def anomaly_only_types(df: DataFrame, type_col: str = K.TYPE, flag: str = "anomalia") -> DataFrame:
    """O1: types seen among anomalies but never among normal rows (one grouped pass)."""
    seen = df.where(F.col(type_col).isNotNull()).groupBy(type_col).agg(
        F.max(F.col(flag) == -1).alias("a"), F.max(F.col(flag) == 1).alias("n"))
    return seen.where("a and not n").select(type_col)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """O3: sorted distinct non-NULL values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def distinct_list(df: DataFrame, col: str, sep: str = ", ") -> DataFrame:
    """O3 text form: distinct values sorted and joined (after de-duplication, so
    the collected set is bounded by the column's cardinality)."""
    d = df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    return d.agg(F.array_join(F.sort_array(F.collect_list("v")), sep).alias(f"lista_{col}"))
