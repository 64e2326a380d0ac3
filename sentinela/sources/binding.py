"""Binding of the canonical incident schema to the driver's test tables.

``occurrences``      = events ⨝ nation ⨝ region (one row per event).
``order_incidents``  = orders ⨝ customer ⨝ nation (dates over several years).

The expressions are written so that the same text runs in DuckDB (see
``sentinela.plans.oracle``), which gives an independent check of every
deterministic operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.plans.hints import bounded_broadcast

TYPE_OF_EVENT = {"click": "Violência Doméstica", "error": "Roubo", "purchase": "Estelionato",
                 "signup": "Ameaça", "view": "Furto"}
WEAPON_OF_K = ["Arma de Fogo", "Faca", "Arma Branca", "Sem Arma"]  # k % 5 = 0..3, else Outros


_SMALL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dimension(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    """A dimension table, broadcast if its size check passes.  The check (a
    bounded count) runs once per application and file, not once per query."""
    df = table(spark, sf_dir, name).select(*cols)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SMALL:
        _SMALL[key] = bounded_broadcast(df) is not df
    return F.broadcast(df) if _SMALL[key] else df


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident table bound to ``events`` (FIXTURES.md §2)."""
    ev = table(spark, sf_dir, "events")
    nation = dimension(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = dimension(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    k = F.get_json_object("props", "$.k").cast("int")
    etype = F.col("event_type")
    tipo = None
    for src, dst in TYPE_OF_EVENT.items():
        tipo = F.when(etype == src, dst) if tipo is None else tipo.when(etype == src, dst)
    kk = F.col("k")
    weapon = None
    for i, w in enumerate(WEAPON_OF_K):
        weapon = F.when(kk % 5 == i, w) if weapon is None else weapon.when(kk % 5 == i, w)
    weapon = weapon.otherwise("Outros")
    eid = F.col("event_id")
    status = F.when(eid % 10 < 6, K.STATUS_DONE).when(eid % 10 < 9, K.STATUS_OPEN) \
        .otherwise(K.STATUS_ARCHIVED)
    base = ev.select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    j = (base.join(nation, (F.col("user_id") % 25) == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    return j.select(
        eid.alias(K.ID),
        F.col("ts").alias(K.TS),
        tipo.alias(K.TYPE),
        F.col("n_name").alias(K.ZONE),
        (F.lit(-8.12) + ((eid * 7919) % 1000).cast("double") / F.lit(10000.0)).alias(K.LAT),
        (F.lit(-34.95) + ((eid * 104729) % 1000).cast("double") / F.lit(8000.0)).alias(K.LON),
        F.concat(F.lit("MO-"), (F.col("user_id") % 12).cast("string")).alias(K.METHOD),
        weapon.alias(K.WEAPON),
        F.when(kk % 3 == 0, "Feminino").when(kk % 3 == 1, "Masculino").alias(K.SEX),
        (F.col("user_id") % 101).cast("int").alias(K.AGE),
        (F.lit(1) + kk % 4).cast("int").alias(K.VICTIMS),
        (F.lit(1) + kk % 3).cast("int").alias(K.SUSPECTS),
        status.alias(K.STATUS),
        F.col("r_name").alias(K.PRECINCT),
    )


def order_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second binding with dates spread over years (month operators, F8, P21)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = dimension(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    st = F.col("o_orderstatus")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.col("o_orderkey").alias(K.ID),
        F.col("o_orderdate").alias(K.TS),
        F.col("o_orderpriority").alias(K.TYPE),
        F.col("n_name").alias(K.ZONE),
        F.col("c_mktsegment").alias(K.METHOD),
        F.when(st == "F", K.STATUS_DONE).when(st == "O", K.STATUS_OPEN).otherwise(K.STATUS_ARCHIVED)
         .alias(K.STATUS),
    )


def nation_zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone boxes for the binding: centres of the fixed boxes assigned by n_nationkey % 10,
    nations 20–24 left out (unknown zones)."""
    from sentinela.sources.dims import zone_boxes
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    slots = spark.createDataFrame([(i, z[0]) for i, z in enumerate(K.ZONE_BOXES)], "slot int, box string")
    boxes = zone_boxes(spark).join(slots, F.col("zone") == F.col("box")).drop("zone", "box")
    return (n.where(F.col("n_nationkey") < 20)
            .join(F.broadcast(boxes), (F.col("n_nationkey") % 10) == F.col("slot"))
            .select(F.col("n_name").alias("zone"), "lat_c", "lon_c", "radius"))
