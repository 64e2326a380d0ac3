"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm._base import row_index, stash

#: Buckets a source's documents are dealt into on each of the two levels that locate its cut.
FAN = 256


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add ``target`` to rows of (source, weight, source_size).

    The total is shared by weight; a source above ``max_epochs`` times its size
    is clamped there and what it gives up goes to the others by weight, until
    none is above. Each turn is one aggregate over the table of sources.
    """
    row = sources.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    total, level = row["total"] or 0, (row["total"] or 0, row["weight"] or 1)
    cap = F.col("source_size") * max_epochs
    while True:
        amount, weight = level
        above = F.col("weight") * amount >= cap * weight
        row = sources.agg(F.sum(F.when(above, cap).otherwise(0)).alias("held"),
                          F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        level = (total - (row["held"] or 0), row["weight"] or 0)
        if level == (amount, weight) or not level[1]:
            break
    share = (F.col("weight") * F.lit(amount)).cast("double") / F.lit(float(weight))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share))


def draw(key: Column, text: Column, seed: int) -> Column:
    """A seeded 60-bit draw of a document, the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"),
                    F.coalesce(F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _cut(rows: DataFrame, level: Column, known: DataFrame, name: str) -> DataFrame:
    """Add the bucket in which each source's running size passes ``rest``; ``offset`` becomes the size before it."""
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = (rows.groupBy("source", level.alias("b")).agg(F.sum("size").alias("n"))
            .select(F.col("source").alias("s"), "b", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before")))
    at = (sums.join(known, F.col("s").eqNullSafe(F.col("source")))
          .where(F.col("before") + F.col("offset") <= F.col("rest"))
          .groupBy("s").agg(F.max(F.struct("b", "before")).alias("m")))
    return (known.join(at, F.col("source").eqNullSafe(F.col("s")))
            .withColumn(name, F.col("m.b")).withColumn("offset", F.col("offset") + F.col("m.before")).drop("s", "m"))


def mix(df: DataFrame, key: str, source: str, text: str, carry: list[str] | None = None,
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 4) -> DataFrame:
    """``record`` (the columns ``carry``, all by default), size, source, weight, source_size, target and
    ``repeats`` of each row.

    Sources in code-point order, null last, weigh ``weights`` in turn. A source
    with target t and size s takes every document floor(t / s) times, and of the
    documents in seeded random order as many once more as come nearest to the
    rest, so its taken words miss the target by at most half a document (at the
    cut). The cut is located by two levels of ``FAN`` buckets of the draw, so a
    source with a third of all rows is summed in parts and only the rows of one
    bucket of 65,536 are put in order. Null and empty texts have size 0 and
    follow the same rule; a null key counts as the empty string; repeated rows
    are documents of their own; a very long text counts with all its words, so a
    source may miss its target by half of that; an empty table gives no rows; a
    source without words takes each document 0 times.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in (carry or df.columns)])
    docs = stash(df.select(record.alias("record"), F.col(f"`{source}`").alias("source"),
                           word_count(F.col(f"`{text}`")).alias("size"),
                           draw(F.col(f"`{key}`"), F.col(f"`{text}`"), seed).alias("draw")), "mix")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 strings compare byte by byte in Spark, which is code-point order.
    placed = row_index(sizes, [F.col("source").asc_nulls_last()])
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    weight = F.element_at(turn, (F.pmod("_idx", F.lit(len(weights))) + 1).cast("int"))
    sources = stash(placed.select("source", "source_size", weight.alias("weight")), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = (water_fill(sources, max_epochs).withColumn("whole", F.floor(rate))
             .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
             .withColumn("offset", F.lit(0).cast("long")))
    bits = FAN.bit_length() - 1
    first = F.shiftright("draw", 60 - bits)
    cell = F.shiftright("draw", 60 - 2 * bits)
    known = stash(_cut(docs, first, known, "b1"), "cut")
    edges = known.select(F.col("source").alias("s"), "b1")
    inside = docs.join(edges, F.col("source").eqNullSafe(F.col("s")) & (first == F.col("b1")))
    known = stash(_cut(inside, cell, known, "b2"), "cut").withColumnRenamed("source", "s")
    rows = docs.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("cell", cell)
    run = Window.partitionBy("source").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = (rows.where("cell = b2")
            .withColumn("extra", F.col("offset") + F.sum("size").over(run) - F.col("size") / 2.0 <= F.col("rest")))
    apart = rows.where("cell != b2").withColumn("extra", F.col("cell") < F.col("b2"))
    return (apart.unionByName(edge)
            .withColumn("repeats", F.col("whole") + F.when(F.col("extra") & (F.col("rest") > 0), 1).otherwise(0))
            .select("record", "size", "source", "weight", "source_size", "target", "repeats"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each record ``repeats`` times."""
    return (mixed.where("repeats > 0")
            .select("record", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy"))
            .select("record.*"))
