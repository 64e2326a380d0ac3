"""Line deduplication over overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm._base import stash

LINES = 3


def line_windows(df: DataFrame, key: str, text: str, lines: int = LINES) -> DataFrame:
    """One row per window of ``lines`` consecutive lines: place (absent, id, version, pos) and a 96-bit hash."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"),
                     F.split(F.col(f"`{text}`"), "\n", -1).alias("lines"))
    starts = F.when(F.size("lines") >= lines, F.sequence(F.lit(0), F.size("lines") - lines))

    def window(i):
        part = F.slice("lines", i + 1, lines)
        blank = F.forall(part, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(i.alias("pos"), F.xxhash64(part).alias("h1"), F.hash(part).alias("h2"), blank.alias("blank"))

    found = rows.select("id", "version", F.explode(F.transform(starts, window)).alias("w")).where(~F.col("w.blank"))
    return found.select(F.struct(F.col("id").isNull().alias("absent"), "id", "version", F.col("w.pos").alias("pos"))
                        .alias("place"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))


def later_windows(windows: DataFrame, lines: int = LINES) -> DataFrame:
    """(id, version, first line, last line) that a later occurrence of a repeated window covers."""
    repeated = stash(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
                     .where("n > 1").select("h1", "h2", "first"), "repeated")
    same = ((F.col("place.id").eqNullSafe(F.col("first.id")))
            & (F.col("place.version").eqNullSafe(F.col("first.version"))))
    start = F.when(same, F.greatest(F.col("place.pos"), F.col("first.pos") + lines)).otherwise(F.col("place.pos"))
    return (windows.join(repeated, ["h1", "h2"]).where(F.col("place") > F.col("first"))
            .select("place.id", "place.version", start.alias("from"), (F.col("place.pos") + lines - 1).alias("to")))


def dedup_lines(df: DataFrame, key: str, text: str, lines: int = LINES) -> DataFrame:
    """``record`` (all columns), ``n_lines``, ``removed`` (ascending line numbers from 0) and the cleaned ``kept_text``.

    Windows of ``lines`` consecutive lines are hashed; of each window that
    occurs more than once the first occurrence stays, in order of key (null
    last), text version and position, and the lines that later occurrences
    cover go, overlapping covers merged. An occurrence that overlaps the first
    one inside the same document leaves the first one's lines alone. Windows of
    blank lines only do not count, so texts with fewer lines than a window,
    empty and null texts stay as they are. Repeated rows (same key and text)
    are one document: each gets the same result. A very long text is cut into
    its windows in one task, whole. An empty table gives no rows.

    Only hashes are shuffled to find repeats: counts are pre-aggregated in each
    task, and a window that a third of all documents share is joined as a
    skewed key that Spark splits. A document's own covers meet in one row.
    """
    windows = stash(line_windows(df, key, text, lines), "windows")
    covers = later_windows(windows, lines).groupBy("id", "version").agg(
        F.collect_set(F.struct("from", "to")).alias("spans"))
    spans = F.filter("spans", lambda s: s["from"] <= s["to"])
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"])))))
    covers = covers.select("id", "version", removed.alias("cut"))
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
                     F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("body"),
                     F.xxhash64(F.col(f"`{text}`")).alias("body_version"))
    joined = docs.join(covers, F.col("doc").eqNullSafe(F.col("id")) & (F.col("body_version") == F.col("version")), "left")
    parts = F.split("body", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    changed = F.coalesce(F.size("cut") > 0, F.lit(False))
    return joined.select("record", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce("cut", F.array().cast("array<int>")).alias("removed"),
                         F.when(changed, cleaned).otherwise(F.col("body")).alias("kept_text"))
