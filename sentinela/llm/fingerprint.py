"""Document fingerprints: threshold-scaled sketches of word shingles (DataFrame functions only).

A sketch keeps every shingle hash below a fixed fraction of the hash range, and
at least the ``FLOOR`` smallest, so a short text keeps all it has. Sketches of
parts merge into the sketch of the whole, and two of them are compared up to the
highest hash below which both are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.llm._base import WORD, row_index, stash

WIDTH, FRACTION, FLOOR = 5, 8, 16
#: Hashes are signed 64-bit; one in FRACTION lies below this.
LIMIT = -(1 << 63) + (1 << 64) // FRACTION
TOP = (1 << 63) - 1


def with_hashes(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: the distinct hashes of all word shingles (fewer words than a shingle: the whole sequence)."""
    words, count = F.col("_words"), F.size("_words")
    each = F.transform(F.sequence(F.lit(1), count - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))
    hashes = (F.when(count >= WIDTH, each).when(count > 0, F.array(F.xxhash64(words)))
              .otherwise(F.array().cast("array<bigint>")))
    return (df.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))
            .withColumn(name, F.array_distinct(hashes)).drop("_words"))


def with_sketch(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: struct of n (distinct shingles) and kept (ascending hashes).

    This departs from a pure threshold: where fewer than ``FLOOR`` hashes lie below
    it, the ``FLOOR`` smallest are kept, so that short texts can be compared.
    """
    below = F.filter("_hashes", lambda h: h < F.lit(LIMIT))
    return (with_hashes(df, text, "_hashes").withColumn("_below", below)
            .withColumn(name, F.struct(F.size("_hashes").alias("n"), F.when(
                F.size("_below") >= FLOOR, F.array_sort("_below"))
                .otherwise(F.slice(F.array_sort("_hashes"), 1, FLOOR)).alias("kept")))
            .drop("_hashes", "_below"))


def complete_to(sketch: Column) -> Column:
    """The highest hash below which a sketch is known to hold everything."""
    last = F.greatest(F.lit(LIMIT - 1), F.element_at(sketch["kept"], -1))
    return F.when(F.size(sketch["kept"]) >= sketch["n"], F.lit(TOP)).otherwise(last)


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    upto = F.least(complete_to(a), complete_to(b))
    left, right = (F.filter(x["kept"], lambda h: h <= upto) for x in (a, b))
    return F.size(F.array_intersect(left, right)), F.size(left), F.size(right)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two texts without words are alike, one without is like no other."""
    both, left, right = _common(a, b)
    return F.when((a["n"] == 0) & (b["n"] == 0), 1.0).otherwise(
        F.when(left + right > 0, both / (left + right - both)).otherwise(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1 (1 for a text without words)."""
    both, left, _ = _common(a, b)
    return F.when(a["n"] == 0, 1.0).otherwise(F.when(left > 0, both / left).otherwise(0.0))


def merged(a: Column, b: Column) -> Column:
    """Sketch of the union of both texts' shingles; n is exact when both hold all, else an estimate."""
    upto = F.least(complete_to(a), complete_to(b))
    kept = F.array_sort(F.filter(F.array_union(a["kept"], b["kept"]), lambda h: h <= upto))
    both, left, right = _common(a, b)
    n = F.when(upto == TOP, F.size(kept)).otherwise(
        F.greatest(F.size(kept) + 1, F.round((a["n"] + b["n"]) * F.size(kept) / F.greatest(left + right, F.lit(1)))))
    return F.struct(n.cast("int").alias("n"), kept.alias("kept"))


def as_text(sketch: Column) -> Column:
    """Distinct shingles, then the kept hashes in hexadecimal."""
    return F.concat(sketch["n"].cast("string"), F.lit(":"), F.array_join(F.transform(sketch["kept"], F.hex), ","))


def compare_with_edit(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sketches of each text, of its edit with the next document, and their likeness.

    Returns id, n_chars, edited, sketch, edited_sketch, near_edited, near_next.
    The edit replaces the last floor(n / 4) of the n code points by the first as
    many (or all) of the next document, in ascending key (null first; rows with
    the same key by a hash of the text), after the last the first. Repeated rows
    (same key and text) are one document and each gets its result; a null text
    is empty; a table with one document has itself as the next; very long texts
    keep one in eight of all their shingle hashes; an empty table gives no rows.

    The order is found on (key, hash, length) alone; texts are shuffled once, by
    key, and meet only the heads and sketches of their successors.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("version"), body.alias("body"))
    narrow = docs.select("id", "version", F.length("body").alias("n")).distinct()
    placed = stash(row_index(narrow, [F.col("id").asc_nulls_first(), F.col("version")]), "order")
    total = placed.count()
    follower = placed.select(F.pmod(F.col("_idx") - 1, F.lit(max(total, 1))).alias("_idx"),
                             F.col("id").alias("next_id"), F.col("version").alias("next_version"))
    pairs = placed.join(follower, "_idx").select(
        F.col("id").alias("own_id"), F.col("version").alias("own_version"),
        F.floor(F.col("n") / 4).cast("int").alias("take"), "next_id", "next_version")
    met = docs.join(pairs, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("version") == F.col("next_version")))
    heads = (with_sketch(met, F.col("body"), "next_sketch")
             .select("own_id", "own_version", F.substring("body", F.lit(1), F.col("take")).alias("head"), "next_sketch")
             .groupBy("own_id", "own_version")
             .agg(F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch")))
    rows = docs.join(heads, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version")))
    length = F.length("body")
    edited = F.concat(F.substring("body", F.lit(1), length - F.floor(length / 4).cast("int")), F.col("head"))
    rows = rows.select("id", length.cast("long").alias("n_chars"), "body", edited.alias("edited"), "next_sketch")
    rows = with_sketch(with_sketch(rows, F.col("body"), "sketch"), F.col("edited"), "edited_sketch")
    return rows.select("id", "n_chars", "edited", "sketch", "edited_sketch",
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
