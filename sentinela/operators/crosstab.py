"""Cross tables (A5–A8, A26, J7).  Long form (row, col, n) is primary; the wide
form is a pivot over the known (small) set of column values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators._common import counted, ensure_dow, ensure_hour
from sentinela.operators.profile import top_n
from sentinela.plans.hints import settled


def crosstab(df: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """A6 long form: contingency counts, NULL keys dropped."""
    return counted(df, [row, col], n).orderBy(row, col)


def crosstab_wide(df: DataFrame, row: str, col: str) -> DataFrame:
    """A6 wide form: one column per value of ``col``, missing cell = 0.

    The input is aggregated once to (row, col, n); that table is settled and
    supplies both the column names (as many as the result has columns) and
    the pivot, so the input is scanned a single time.
    """
    cells = settled(counted(df, [row, col]))
    return cells.groupBy(row).pivot(col).agg(F.first("n")).fillna(0).orderBy(row)


def crosstab_pct(df: DataFrame, row: str, col: str, digits: int = 6) -> DataFrame:
    """Row-normalised percentages.  The window runs over the aggregated
    table, partitioned by ``row`` (one partition holds one row's few cells)."""
    c = crosstab(df, row, col)
    w = Window.partitionBy(row)
    return c.withColumn("pct", S.round_half_up(F.col("n") / F.sum("n").over(w) * F.lit(100.0), digits))


def hour_weekday_matrix(df: DataFrame, count_col: str = K.TYPE, ts: str = K.TS) -> DataFrame:
    """A5: count of non-NULL ``count_col`` per hour × ISO weekday, all 168 cells.

    The 24 × 7 grid is generated from one range (no cross join) and the
    aggregated counts are joined onto it.
    """
    d = ensure_dow(ensure_hour(df, ts), ts)
    c = (d.where(F.col("hora").isNotNull() & F.col("dow").isNotNull())
         .groupBy("hora", "dow").agg(F.count(count_col).alias("n")))
    grid = df.sparkSession.range(0, 24 * 7).select(
        (F.col("id") / 7).cast("int").alias("hora"), (F.col("id") % 7 + 1).cast("int").alias("dow"))
    return (grid.join(c, ["hora", "dow"], "left")
            .select("hora", "dow", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("hora", "dow"))


def seasonality(df: DataFrame, month: str = "mes", type_col: str = K.TYPE, ts: str = K.TS) -> DataFrame:
    """Month × type counts, 0 for absent combinations of present values.

    One aggregation of the input to (month, type, n).  Each present type is
    given all present months (twelve at most) and the counts are joined on:
    no cross join, no pivot, one scan of the input.
    """
    d = df if month in df.columns else df.withColumn(month, F.month(ts))
    cells = settled(counted(d, [month, type_col]))
    months = [F.lit(r[0]) for r in cells.select(month).distinct().orderBy(month).collect()]
    if not months:
        return cells.select(month, type_col, F.col("n").cast("long").alias("n"))
    every = cells.select(type_col).distinct().withColumn(month, F.explode(F.array(*months)))
    return (every.join(cells, [month, type_col], "left")
            .select(month, type_col, F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(month, type_col))


def top_patterns_over_time(df: DataFrame, k: int = 3, method: str = K.METHOD, ts: str = K.TS) -> DataFrame:
    """A26 (+J3): month × method counts for the ``k`` most frequent methods.

    The top-k list has exactly ``k`` rows, so its broadcast is bounded.
    """
    top = F.broadcast(top_n(df, method, k).select(method))
    d = df.join(top, method, "left_semi").withColumn("mes_ano", S.month_key(ts))
    return counted(d, ["mes_ano", method]).orderBy("mes_ano", method)


def complete_calendar(counts: DataFrame, dim: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Impose a fixed key order from a dimension; absent keys get 0."""
    return (dim.join(counts, key, "left")
            .withColumn(n, F.coalesce(F.col(n), F.lit(0)).cast("long")).orderBy(key))
