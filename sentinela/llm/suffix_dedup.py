"""Removing long passages that repeat, with a sparse suffix array.

Of all suffixes of all texts only those are retained that begin at a minimiser:
the word whose next ``PREFIX`` words hash lowest among the starts of a passage
of ``PASSAGE`` words. Equal passages select equal places, so every repeat of
that length shares a retained suffix. The suffixes are sorted over the cluster
and compared with their neighbours; those that share no prefix with one drop
out. The others are extended to the left and right over all passages that
selected them, and a passage that occurs at an earlier place is covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import _words as words
from sentinela.llm._base import for_python, row_index, stash

PASSAGE, PREFIX = 50, 20
#: A place is a text's number in order and a word position in one long.
POSITION_BITS = 28
#: A table of at most this many rows and array entries may be broadcast.
BROADCAST_ROWS, BROADCAST_ENTRIES = 200_000, 4_000_000


def selected(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each passage inside a text, and the minimiser that it selects (word numbers in the batch)."""
    width = PASSAGE - PREFIX + 1
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix, _ = rolling(hashes, PREFIX, 3)
    least = np.lib.stride_tricks.sliding_window_view(prefix, width).argmin(axis=1)
    counts = np.maximum(np.diff(bounds) - PASSAGE + 1, 0)
    start = np.arange(counts.sum()) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return start, start + least[start]


def rolling(hashes: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every run of ``width`` words."""
    out = []
    for s in (seed, seed + 1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            words.mixed(hashes + np.uint64(s)) * words.powers(words.BASE, len(hashes)), dtype=np.uint64)])
        run = (total[width:] - total[:-width]) * words.powers(words.INVERSE, len(hashes))[:len(hashes) - width + 1]
        out.append(words.mixed(run))
    return out[0], out[1]


def _suffixes(docs: DataFrame) -> DataFrame:
    """(id, version, c1, c2, n: words, at: positions, prefix: hashes) of rows (id, version, text)."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for begin, end in words.chunks(texts):
                hashes, bounds = words.word_hashes(texts[begin:end])
                kept = np.unique(selected(hashes, bounds)[1])
                prefix = rolling(hashes, PREFIX, 3)[0][kept].view(np.int64) if len(kept) else np.zeros(0, np.int64)
                cuts = np.searchsorted(kept, bounds).astype(np.int32)
                at = kept - np.repeat(bounds[:-1], np.diff(cuts))
                codes = [pa.array(words.sequence_hashes(hashes, bounds, s).view(np.int64)) for s in (1, 2)]
                own = [batch.column(c).slice(begin, end - begin) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, *codes, pa.array(np.diff(bounds).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(prefix))],
                    ["id", "version", "c1", "c2", "n", "at", "prefix"])

    return docs.mapInArrow(run, "id long, version long, c1 long, c2 long, n long, at array<int>, prefix array<long>")


def _with_neighbours(suffixes: DataFrame) -> DataFrame:
    """The places of (prefix, place) whose prefix a neighbour in sorted order shares.

    The range shuffle sorts by prefix and place, so a prefix with any number of
    places spreads over several tasks; each task compares the rows in its own
    stretch and hands on its two ends, which are compared in a small table.
    """
    def run(batches):
        last, last_alike, first = None, False, None

        def rows(place, end, prefix):
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(end, pa.bool_()),
                                               pa.array(prefix, pa.int64())], ["place", "end", "prefix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, place = (batch.column(c).to_numpy() for c in (0, 1))
            same = prefix[1:] == prefix[:-1]
            joins = last is not None and last[0] == prefix[0]
            if last is not None and joins and not last_alike:
                yield rows([last[1]], [False], [last[0]])
            alike = np.concatenate([[joins], same]) | np.concatenate([same, [False]])
            # The last row of a batch is held back if it is alone so far.
            yield rows(place[alike], np.zeros(alike.sum(), bool), prefix[alike])
            if first is None:
                first = (prefix[0], place[0])
            last, last_alike = (prefix[-1], place[-1]), bool(alike[-1])
        if first is not None:
            ends = dict.fromkeys([first, last])
            yield rows([p for _, p in ends], [True] * len(ends), [h for h, _ in ends])

    sorted_ = suffixes.repartitionByRange("prefix", "place").sortWithinPartitions("prefix", "place")
    found = stash(sorted_.mapInArrow(run, "place long, end boolean, prefix long"), "neighbours")
    ends = found.where("end")
    shared = ends.groupBy("prefix").agg(F.countDistinct("place").alias("n")).where("n > 1").select("prefix")
    return found.where("not end").select("place").union(ends.join(shared, "prefix").select("place")).distinct()


def _passages(texts: DataFrame) -> DataFrame:
    """(w1, w2, place) of every passage that selected one of the suffixes ``at`` of rows (number, at, text)."""
    def run(batches):
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            at, texts = batch.column(1), batch.column(2).cast(pa.binary()).to_pylist()
            for begin, end in words.chunks(texts):
                hashes, bounds = words.word_hashes(texts[begin:end])
                start, chosen = selected(hashes, bounds)
                if not len(start):
                    continue
                part = at.slice(begin, end - begin)
                wanted = part.flatten().to_numpy() + np.repeat(bounds[:-1], part.value_lengths().to_numpy())
                flag = np.zeros(len(hashes), bool)
                flag[wanted] = True
                start = start[flag[chosen]]
                own = np.searchsorted(bounds, start, "right") - 1
                w1, w2 = (w[start].view(np.int64) for w in rolling(hashes, PASSAGE, 11))
                place = (numbers[begin:end][own] << POSITION_BITS) | (start - bounds[own])
                for k in range(0, len(start), 1 << 16):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[k:k + (1 << 16)]) for x in (w1, w2, place)], ["w1", "w2", "place"])

    return texts.mapInArrow(run, "w1 long, w2 long, place long")


def _small(table: DataFrame, entries: str) -> DataFrame:
    """Marked for broadcast if its rows and array entries are few; else joined by a shuffle."""
    row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(entries)).alias("e")).first()
    return F.broadcast(table) if row["n"] <= BROADCAST_ROWS and (row["e"] or 0) <= BROADCAST_ENTRIES else table


def cut_words(text: str, spans: list[tuple[int, int]]) -> tuple[str, str]:
    """The text without the words of the spans (from, to exclusive), each up to the next word; spans as text."""
    _, begin, end, _ = words.spans([text.encode()])
    data, out, last = text.encode(), [], 0
    begin, listed = np.append(begin - 1, len(data)), []  # the joined bytes have one line feed ahead
    for a, b in spans:
        out.append(data[last:begin[a]])
        last = begin[b]
        listed.append(f"{a}:{b}")
    out.append(data[last:])
    return b"".join(out).decode(), ",".join(listed)


SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _merged(rows: pa.Array) -> pa.Array:
    """Overlapping or touching spans of each row merged, in order."""
    out = []
    for row in rows:
        a, b = (row.values.field(k).to_numpy() for k in (0, 1))
        order = np.argsort(a, kind="stable")
        a, reach = a[order], np.maximum.accumulate(b[order])
        first = np.concatenate([[True], a[1:] > reach[:-1]])
        last = np.append(np.flatnonzero(first)[1:] - 1, len(a) - 1)
        out.append([{"from": int(x), "to": int(y)} for x, y in zip(a[first], reach[last])])
    return pa.array(out, SPANS)


def repeated_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, version, spans: array of from, to) for each text in which a passage repeats; to null: the whole text."""
    for_python(df.sparkSession)
    body = F.col(f"`{text}`")
    docs = (df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("version"), body.alias("text"))
            .where("text is not null"))
    found = stash(_suffixes(docs), "suffixes")
    classes = stash(found.where(F.col("n") >= PASSAGE).groupBy("c1", "c2").agg(
        F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "version", "at", "prefix")).alias("m"))
        .select("c1", "c2", "m.*"), "classes")
    numbered = stash(row_index(classes.drop("c1", "c2"), [F.col("absent"), F.col("id"), F.col("version")], "number"),
                     "numbered")
    place = F.shiftleft("number", POSITION_BITS).bitwiseOR(F.col("s.at").cast("long"))
    suffixes = (numbered.select("number", F.explode(F.arrays_zip("at", "prefix")).alias("s"))
                .select(F.col("s.prefix").alias("prefix"), place.alias("place")))
    number = F.shiftright("place", POSITION_BITS)
    position = F.col("place").bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    kept = stash(_with_neighbours(suffixes).groupBy(number.alias("number")).agg(F.collect_list(position).alias("at"))
                 .join(numbered.select("number", "id", "version"), "number"), "kept")
    met = docs.join(_small(kept.withColumnsRenamed({"id": "kid", "version": "kv"}), "at"),
                    F.col("id").eqNullSafe(F.col("kid")) & (F.col("version") == F.col("kv")))
    # Made twice rather than kept: hashes do not compress, and making them costs one pass over few texts.
    passages = _passages(met.select("number", "at", "text"))
    firsts = stash(passages.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
                   .where("n > 1").select("w1", "w2", "first"), "firsts")
    mask = (1 << POSITION_BITS) - 1
    own_first = F.shiftright("first", POSITION_BITS) == number
    begin = F.when(own_first, F.greatest(position, F.col("first").bitwiseAND(mask).cast("int") + PASSAGE)).otherwise(position)
    later = (passages.join(firsts, ["w1", "w2"]).where("place > first")
             .select(number.alias("number"), begin.alias("from"), (position + PASSAGE).alias("to")))
    covers = (later.where(F.col("from") < F.col("to")).groupBy("number")
              .agg(F.collect_set(F.struct("from", "to")).alias("spans"))
              .withColumn("spans", F.arrow_udf(_merged, "array<struct<from:int,to:int>>")("spans"))
              .join(numbered.select("number", "id", "version"), "number").select("id", "version", "spans"))
    firsts_of = classes.select("c1", "c2", F.col("id").alias("fid"), F.col("version").alias("fv"))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.lit(None).cast("int").alias("to")))
    same = F.col("id").eqNullSafe(F.col("fid")) & (F.col("version") == F.col("fv"))
    copies = (found.select("id", "version", "c1", "c2").join(firsts_of, ["c1", "c2"]).where(~same)
              .select("id", "version", whole.alias("spans")).distinct())
    return stash(covers.union(copies), "covers")


def dedup_passages(df: DataFrame, key: str, text: str) -> DataFrame:
    """``record`` (all columns), ``n_words``, ``n_removed``, ``spans`` (word numbers from:to, comma-joined), ``kept_text``.

    A word goes if a passage of ``PASSAGE`` words around it also occurs at an
    earlier place, in order of key (null last), text version and position; an
    occurrence that overlaps the first one in the same text leaves the first
    one's words alone. Words are runs without ASCII white space, A-Z
    lower-cased. Shorter texts, empty and null ones stay as they are (null has 0
    words). Repeated rows (same key and text) are one text: each gets the same
    result. Very long texts are hashed whole, one at a time. An empty table gives
    no rows.

    Exact copies of a text are settled by one pre-aggregated hash. Passages
    selected by a suffix without a neighbour are never looked at again, so what
    is shuffled grows with the repeated part of the corpus.
    """
    covers = repeated_spans(df, key, text).withColumnsRenamed({"id": "cid", "version": "cv", "spans": "cover"})
    body = F.col(f"`{text}`")
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    docs = df.select(record.alias("record"), F.col(f"`{key}`").cast("long").alias("id"),
                     F.xxhash64(body).alias("version"), body.alias("text"))
    joined = docs.join(_small(covers, "cover"),
                       F.col("id").eqNullSafe(F.col("cid")) & (F.col("version") == F.col("cv")), "left")

    @F.arrow_udf("struct<n_words:long,n_removed:long,spans:string,kept_text:string>")
    def run(texts: pa.Array, covers: pa.Array) -> pa.Array:
        out = []
        for body, cover in zip(texts.to_pylist(), covers.to_pylist()):
            n = len(body.encode().split()) if body else 0
            spans = [(s["from"], n if s["to"] is None else s["to"]) for s in cover or []]
            kept, listed = cut_words(body, spans) if spans else (body, "")
            out.append((n, sum(b - a for a, b in spans), listed, kept))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)],
                                          ["n_words", "n_removed", "spans", "kept_text"])

    return joined.select("record", run("text", "cover").alias("r")).select("record", "r.*")
