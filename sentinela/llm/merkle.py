"""Merkle manifest of a table: bitmap ranks give leaf places, keyed slot arrays reduce the levels.

The ids of each group become a compressed bitmap: one 64-bit word for each run
of 64 ids that has any. Partial words of all tasks merge by OR. A popcount
directory over the words says how many rows of the group come before a word; it
is a radix tree over the word number, so each step adds up at most a fixed
number of siblings and no task ever holds a group. A row's place is its word's
entry plus the popcount of the lower bits of the word, so rows are never
sorted. Leaves meet by place // 8, each in the slot place % 8 of an array, and
an array's hash is a leaf of the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentinela.llm._base import row_index, stash
from sentinela.plans.hints import bounded_broadcast

#: Children of an inner node.
FAN = 8
#: Bits of a key that a word of a bitmap holds, and that each level of its directory adds (64 together).
WORD, LEVELS = 6, (8, 14, 18, 18)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value for the hash: ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the inputs one after the other."""
    return F.sha2(F.concat(*parts), 256)


def bitmap_ranks(df: DataFrame, group: str, key: str) -> tuple[DataFrame, bool]:
    """Adds ``before`` (rows of the group with a smaller ``key``) and ``ties`` (rows with the row's own key); are there ties?

    ``key`` is a long; nulls come first, as ties of each other. ``group`` holds
    no null. A directory step adds up at most 2 ** 18 siblings.
    """
    word, low = F.shiftright(key, WORD), F.col(key).bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")
    rows = df.withColumn("_word", word).withColumn("_bit", low)
    some = rows.where(F.col(key).isNotNull())
    words = stash(some.groupBy(group, "_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("bits"),
                                                   F.count(F.lit(1)).alias("rows")), "words")
    # Bits count keys; what repeated keys have beyond one row is kept beside the bitmap.
    crowded = words.where("rows > bit_count(bits)").select(group, "_word")
    listed = "array<struct<bit:int,more:bigint>>"
    repeats = not crowded.isEmpty()
    if not repeats:
        words = words.withColumn("more", F.array().cast(listed))
    else:
        more = (some.join(crowded, [group, "_word"]).groupBy(group, "_word", "_bit").agg((F.count(F.lit(1)) - 1).alias("more"))
                .where("more > 0").groupBy(group, "_word")
                .agg(F.collect_list(F.struct(F.col("_bit").alias("bit"), "more")).cast(listed).alias("more")))
        words = words.join(more, [group, "_word"], "left").withColumn("more", F.coalesce("more", F.array().cast(listed)))
    # The directory, upwards: rows under each node, and rows under its smaller siblings.
    before = lambda *by: F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy("node").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    tables, level = [], words.select(group, F.col("_word").alias("node"), "rows")
    for bits in LEVELS:
        level = level.withColumn("parent", F.shiftright("node", bits)).withColumn("smaller", before(group, "parent"))
        level = level if tables else stash(level, "directory")  # the lowest has a row a word, the others few
        tables.append(level.select(group, "node", "parent", "smaller"))
        level = level.groupBy(group, F.col("parent").alias("node")).agg(F.sum("rows").alias("rows"))
    # All bits are used up: at most one node for negative keys and one for the others is left.
    nulls = stash(rows.where(F.col(key).isNull()).groupBy(group).agg(F.count(F.lit(1)).alias("nulls")), "nulls")
    starts = (level.withColumn("start", before(group)).join(bounded_broadcast(nulls), group, "left")
              .select(group, F.col("node").alias("parent"), (F.col("start") + F.coalesce("nulls", F.lit(0))).alias("start")))
    for table in reversed(tables):
        starts = table.join(starts, [group, "parent"]).select(group, F.col("node").alias("parent"), (F.col("start") + F.col("smaller")).alias("start"))
    ranks = stash(words.join(starts.withColumnRenamed("parent", "_word"), [group, "_word"])
                  .select(group, "_word", "bits", "more", "start"), "ranks")
    extra = F.aggregate(F.filter("more", lambda x: x["bit"] < F.col("_bit")), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    own = F.aggregate(F.filter("more", lambda x: x["bit"] == F.col("_bit")), F.lit(1).cast("long"), lambda a, x: a + x["more"])
    columns = [F.col(c) for c in df.columns]
    placed = some.join(ranks, [group, "_word"]).select(
        *columns, (F.col("start") + F.expr("bit_count(bits & ~shiftleft(-1L, _bit))") + extra).alias("before"), own.alias("ties"))
    first = rows.where(F.col(key).isNull()).join(bounded_broadcast(nulls), group).select(
        *columns, F.lit(0).cast("long").alias("before"), F.col("nulls").alias("ties"))
    return placed.unionByName(first), repeats or not nulls.where("nulls > 1").isEmpty()


def places(rows: DataFrame, group: str, key: str, leaf: str) -> DataFrame:
    """Adds ``place``, 0 upwards in each group by ``key``; rows that repeat a key go by the leaf, equal rows in any order."""
    kept, steps = rows.columns, [key, "_tie1", "_tie2"]
    rows = stash(rows.withColumn("_tie1", F.conv(F.substring(leaf, 1, 15), 16, 10).cast("long"))
                 .withColumn("_tie2", F.monotonically_increasing_id()), "leaves")
    done, open_rows = None, rows.withColumn("_in", F.col(group)).withColumn("place", F.lit(0).cast("long"))
    for step in steps:
        ranked, ties = bitmap_ranks(open_rows, "_in", step)
        ranked = stash(ranked.withColumn("place", F.col("place") + F.col("before")).drop("before"), "places")
        single = ranked.where("ties = 1").select(*kept, "place")
        done = single if done is None else done.unionByName(single)
        open_rows = ranked.where("ties > 1").drop("ties").withColumn(
            "_in", F.concat_ws(":", "_in", F.coalesce(F.col(step).cast("string"), F.lit("-"))))
        if not ties or step == steps[-1]:
            return done


def reduce_levels(nodes: DataFrame, group: str, key: str) -> list[DataFrame]:
    """Levels of the trees over (group, place, ``key`` digest): (group, node, n_up, slots, up).

    ``slots`` maps a slot to the digest there, ``up`` is the node's digest and
    ``n_up`` how many nodes its group has on the next level. A group is left
    out from the level on where one node remains.
    """
    counts = stash(nodes.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "counts")
    level = nodes.select(group, "place", F.col(key).alias("digest")).join(bounded_broadcast(counts), group)
    out, most = [], counts.agg(F.max("n")).first()[0] or 0
    while most > 1:
        slot = F.col("place").bitwiseAND(F.lit(FAN - 1)).cast("int")
        up = stash(level.where("n > 1").groupBy(group, F.shiftright("place", 3).alias("node"), F.shiftright(F.col("n") + FAN - 1, 3).alias("n_up"))
                   .agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("slot"), "digest"))).alias("slots"))
                   .withColumn("up", F.sha2(_joined(F.col("slots"), 0, FAN), 256)), "level")
        out.append(up)
        most = -(-most // FAN)
        level = up.select(group, F.col("node").alias("place"), F.col("up").alias("digest"), F.col("n_up").alias("n"))
    return out


def _joined(slots: Column, first: Column | int, last: Column | int) -> Column:
    """Digests in the slots from ``first`` up to ``last`` (exclusive), one after the other."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.concat(*[F.when((first <= i) & (F.lit(i) < last), F.coalesce(F.try_element_at(slots, F.lit(i)), F.lit("")))
                      .otherwise(F.lit("")) for i in range(FAN)])


def _beside(slots: Column, place: Column) -> Column:
    """What a proof needs of one level: the siblings left and right of a place in its run."""
    slot = place.bitwiseAND(F.lit(FAN - 1)).cast("int")
    return F.struct(_joined(slots, 0, slot).alias("l"), _joined(slots, slot + 1, FAN).alias("r"))


def _paths(levels: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """Nodes of the lowest level with ``path``, the siblings on each level above them, lowest first.

    ``above`` holds for each group what its subroot has: path, and columns that are handed down.
    """
    handed = [c for c in above.columns if c not in (group, "path")]
    path = None
    for level in reversed(levels):
        columns = [group, "node", "slots"]
        ends = level.where("n_up = 1").select(*columns).join(above, group).select(*columns, "path", *handed)
        if path is not None:
            over = path.withColumnsRenamed({"node": "over", "slots": "run"})
            inner = (level.where("n_up > 1").select(*columns, F.shiftright("node", 3).alias("over")).join(over, [group, "over"])
                     .withColumn("path", F.concat(F.array(_beside(F.col("run"), F.col("node"))), F.col("path"))))
            ends = ends.unionByName(inner.select(*columns, "path", *handed))
        path = ends
    return path


def fold(leaf: Column, path: Column) -> Column:
    """The root recomputed from a leaf and the siblings of each level."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def tampered_text(key: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the decimal key."""
    return F.when(F.crc32(key.cast("string")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def manifest(df: DataFrame, key: str, group: str, fields: list[str], text: str) -> DataFrame:
    """One row per row of ``df``: key, grp, place, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    A leaf is the hash of ``fields`` (each ``-`` if null, else byte count, ``:``,
    value). Leaves of a group ascend by ``key``; every eight become their hash
    until one, the subroot, is left (a lone leaf is its own subroot). Subroots
    by group (null first, UTF-8 bytewise) give the root the same way. ``proof``
    holds the siblings left and right of the path on each level from the leaf to
    the root. ``folded_root`` comes from these siblings and the leaf of the row
    as it is found, where ``text`` has A-Z in lower case if 3 divides the CRC-32
    of the decimal key; ``verified`` says that it is the root.

    A null group is a group. Rows without a key come first in their group and
    count as untouched. Rows that repeat a key are leaves of their own, ordered
    by their hash; equal rows take neighbouring places. Empty and very long
    texts are hashed whole in their task and never move; what is shuffled are
    hashes. Other columns of ``df`` play no part. An empty table gives no rows.
    """
    col = {c: F.col(f"`{c}`") for c in {*fields, key, group, text}}
    changed = {**col, text: tampered_text(col[key], col[text])}
    # One string for each group: "-" for null comes before "=" and a value.
    rows = df.select(col[key].cast("long").alias("key"), F.coalesce(F.concat(F.lit("="), col[group].cast("string")), F.lit("-")).alias("g"),
                     digest(*[field(col[c]) for c in fields]).alias("leaf"),
                     digest(*[field(changed[c]) for c in fields]).alias("found"))
    leaves = stash(places(rows, "g", "key", "leaf"), "leaves")
    levels = reduce_levels(leaves, "g", "leaf")
    single = leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("g")
    lone = leaves.join(bounded_broadcast(single), "g", "left_semi")
    subroots = lone.select("g", F.col("leaf").alias("subroot"))
    for level in levels:
        subroots = subroots.unionByName(level.where("n_up = 1").select("g", F.col("up").alias("subroot")))
    tops = row_index(subroots.withColumn("all", F.lit(0)), [F.col("g")], "place")
    upper = reduce_levels(tops, "all", "subroot")
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    if upper:
        root = upper[-1].first()["up"]
        path = _paths(upper, "all", upper[-1].select("all", nothing.alias("path")))
        above = (tops.withColumn("node", F.shiftright("place", 3)).join(path, "node")
                 .select("g", "subroot", F.lit(root).alias("root"),
                         F.concat(F.array(_beside(F.col("slots"), F.col("place"))), F.col("path")).alias("path")))
    else:
        above = tops.select("g", "subroot", F.col("subroot").alias("root"), nothing.alias("path"))
    above = stash(above, "above")
    columns = ["key", "g", "place", "leaf", "found", "subroot", "root", "path"]
    out = lone.join(above, "g").select(columns)
    if levels:
        # A run's leaves meet their siblings once, as one row, and part again in the task.
        runs = leaves.groupBy("g", F.shiftright("place", 3).alias("node")).agg(
            F.collect_list(F.struct("key", "place", "leaf", "found")).alias("own"))
        many = (runs.join(_paths(levels, "g", above), ["g", "node"])
                .select("g", "slots", "path", "subroot", "root", F.explode("own").alias("x")).select("*", "x.*")
                .withColumn("path", F.concat(F.array(_beside(F.col("slots"), F.col("place"))), F.col("path"))))
        out = out.unionByName(many.select(columns))
    proof = F.array_join(F.flatten(F.transform("path", lambda x: F.array(x["l"], x["r"]))), "")
    return (out.select("key", F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30)).alias("grp"), "place", "leaf", "subroot", "root",
                       F.col("path").alias("proof"), F.sha2(proof, 256).alias("proof_sha256"),
                       fold(F.col("found"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
