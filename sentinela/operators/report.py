"""The numbers behind the exported report, as one long table
(secao, chave, n, pct)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.functions import scalar as S
from sentinela.operators import profile as P
from sentinela.operators._common import ensure_hour, n_rows
from sentinela.plans.hints import precounted


def report_tables(df: DataFrame, ts: str = K.TS, top_zones: int = 5) -> DataFrame:
    df = precounted(ensure_hour(df, ts), [K.STATUS, "hora", K.TYPE, K.ZONE])

    def row(secao, chave, n, pct):
        return [F.lit(secao).alias("secao"), (chave.cast("string") if chave is not None else
                                              F.lit(None).cast("string")).alias("chave"),
                n.cast("long").alias("n"), (pct if pct is not None else F.lit(None)).cast("double").alias("pct")]
    base = df.agg(n_rows(df).alias("t"), n_rows(df, F.col(K.STATUS) == K.STATUS_DONE).alias("r"))
    total = base.select(*row("total", None, F.col("t"), None))
    res = base.select(*row("resolucao", None, F.col("r"), S.pct("r", "t", 1)))
    peak = P.peak_hour(df, ts).select(*row("hora_pico", F.col("hora"), F.col("n"), None))
    types = P.share_table(df, K.TYPE).select(*row("tipo", F.col(K.TYPE), F.col("n"), F.col("pct")))
    zones = P.share_table(df, K.ZONE, top_zones).select(*row("bairro_top5", F.col(K.ZONE), F.col("n"), F.col("pct")))
    return total.unionByName(res).unionByName(peak).unionByName(types).unionByName(zones)
