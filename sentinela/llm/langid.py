"""Language identification by interpolated Kneser-Ney character models.

One character n-gram model per language, over words padded with a begin and an
end mark. All languages share one sorted array of n-gram hashes per order, with
a column of discounted probabilities and one of back-off weights for each
language. A text gets the language whose model has the lowest cross-entropy per
character; texts that fit even that one little better than letters in no order do
are rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import _words as words
from sentinela.llm._base import for_python, stash
from sentinela.plans.hints import bounded_broadcast

ORDER = 5
#: Bounds of the sample of labelled texts that a language's model is fitted on.
DOCS, CHARS = 2_000, 4_000_000
#: Where the limit of acceptance lies between labelled texts (0) and the same texts with their letters shuffled (1).
LENIENCE = 0.75
#: Characters, and texts, that the figures of all languages count for in the limit of each.
POOLED = 4_000, 4
#: Characters of distinct words scored at a time.
STEP = 1 << 17
BEGIN, END = 0x110000, 0x110001

_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


class Words:
    """The distinct words (runs of letters, lower-cased) of some texts, and where they occur."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        data = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = is_letter(data)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, end = edge[0::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            words.mixed(data.astype(np.uint64) + np.uint64(7)) * words.powers(words.BASE, len(data)), dtype=np.uint64)])
        hashes = (total[end] - total[begin]) * words.powers(words.INVERSE, len(data))[begin]
        _, first, self.which, self.counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.bounds = np.searchsorted(begin, np.cumsum([1, *(len(t) + 1 for t in lowered)]))
        self.sizes = end[first] - begin[first] + 2  # with both marks
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        at = np.arange(self.starts[-1]) - np.repeat(self.starts[:-1], self.sizes)
        self.at = at  # place in the word, 0 for the begin mark
        points = data[np.minimum(np.repeat(begin[first], self.sizes) + np.maximum(at - 1, 0), len(data) - 1)]
        self.points = np.where(at == 0, BEGIN, np.where(at == np.repeat(self.sizes, self.sizes) - 1, END, points))


def grams(points: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each character (wrong where it would leave the word)."""
    out = [words.mixed(points.astype(np.uint64) + np.uint64(1))]
    for n in range(2, ORDER + 1):
        context = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(words.mixed(context * np.uint64(0xA0761D6478BD642F) + points.astype(np.uint64) + np.uint64(n)))
    return out


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, n, gram, context, suffix, first, seen) of rows (lang, text): n-grams of all orders with their counts."""
    def run(batches):
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for begin, end in words.chunks([t.encode("utf-8", "replace") if t else None for t in own]):
                    w = Words(own[begin:end])
                    weight, hashes = np.repeat(w.counts, w.sizes), grams(w.points)
                    for n in range(1, ORDER + 1):
                        place = np.flatnonzero(w.at >= max(1, n - 1))
                        if not len(place):
                            continue
                        gram, first, which = np.unique(hashes[n - 1][place], return_index=True, return_inverse=True)
                        at = place[first]
                        zero = np.zeros(len(at), np.uint64)
                        yield pa.RecordBatch.from_pydict({
                            "lang": pa.array([lang] * len(at), pa.string()), "n": pa.array(np.full(len(at), n, np.int32)),
                            "gram": pa.array(gram.view(np.int64)),
                            "context": pa.array((hashes[n - 2][at - 1] if n > 1 else zero).view(np.int64)),
                            "suffix": pa.array((hashes[n - 2][at] if n > 1 else zero).view(np.int64)),
                            "first": pa.array(w.at[at] == n - 1),
                            "seen": pa.array(np.bincount(which, weight[place], len(at)).astype(np.int64))})

    return sample.mapInArrow(run, "lang string, n int, gram long, context long, suffix long, first boolean, seen long")


def _estimate(counts: DataFrame) -> DataFrame:
    """(lang, n, gram, alpha, weight): interpolated Kneser-Ney terms from the counts.

    Below the highest order an n-gram counts the distinct characters before it
    (all its occurrences if it begins a word). alpha is its discounted share of
    its context; weight is what the n-gram, as a context, leaves to the lower order.
    """
    left = counts.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(
        F.count(F.lit(1)).alias("before"))
    raw = (F.col("n") == ORDER) | F.col("first")
    kept = counts.join(left, ["lang", "n", "gram"], "left").select(
        "lang", "n", "gram", "context", F.when(raw, F.col("seen")).otherwise(F.coalesce("before", F.lit(1))).alias("c"))
    discount = kept.groupBy("lang", "n").agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"),
                                             F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    discount = discount.select("lang", "n", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
                               .otherwise(0.5).alias("d"))
    d = F.least(F.col("d"), F.lit(0.95))
    heads = kept.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
    heads = heads.join(discount, ["lang", "n"])
    alphas = kept.join(heads, ["lang", "n", "context"]).select(
        "lang", "n", "gram", ((F.col("c") - d) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("weight"))
    weights = heads.select("lang", (F.col("n") - 1).alias("n"), F.col("context").alias("gram"),
                           F.lit(None).cast("double").alias("alpha"), (d * F.col("types") / F.col("total")).alias("weight"))
    return alphas.unionByName(weights).groupBy("lang", "n", "gram").agg(
        F.max("alpha").alias("alpha"), F.max("weight").alias("weight"))


class Model:
    """Sorted n-gram hashes per order, with alpha and back-off weight for each language."""

    def __init__(self, rows: pd.DataFrame):
        self.langs = sorted(rows.lang.unique())
        column = {x: i for i, x in enumerate(self.langs)}
        self.hashes, self.alpha, self.weight = [], [], []
        for n in range(ORDER + 1):
            own = rows[rows.n == n]
            hashes, which = np.unique(own.gram.to_numpy(np.int64), return_inverse=True)
            at = (which, own.lang.map(column).to_numpy(int))
            alpha, weight = (np.full((len(hashes) + 1, len(self.langs)), x, np.float32) for x in (0, 1))
            alpha[at], weight[at] = own.alpha.fillna(0), own.weight.fillna(1)  # the last row is for unknown n-grams
            self.hashes.append(hashes)
            self.alpha.append(alpha)
            self.weight.append(weight)
        self.floor = 1.0 / (rows[(rows.n == 1) & rows.alpha.notna()].gram.nunique() + 1)  # one for all unseen characters
        self.rate, self.normal = 1.0, {}

    def _find(self, n: int, wanted: np.ndarray) -> np.ndarray:
        hashes = self.hashes[n]
        if not len(hashes):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, at, len(hashes))

    def bits(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """-log2 p of each character (0 for begin marks) under each language."""
        p = np.full((len(points), len(self.langs)), self.floor, np.float32)
        context = np.zeros(len(points), np.int64)  # the empty context is the only n-gram of order 0
        for n, hashes in enumerate(grams(points), 1):
            place = np.flatnonzero(at >= max(1, n - 1))
            found = np.full(len(points), len(self.hashes[n]))
            every = np.flatnonzero(at >= n - 1)
            found[every] = self._find(n, hashes[every].view(np.int64))
            p[place] = self.alpha[n][found[place]] + self.weight[n - 1][context[place]] * p[place]
            context = np.concatenate([[len(self.hashes[n])], found[:-1]])
        p[at == 0] = 1
        return -np.log2(p)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character of each text under each language, and its number of characters."""
        w = Words(texts)
        each = np.zeros((len(w.sizes), len(self.langs)))
        first = 0
        while first < len(w.sizes):
            last = max(first + 1, int(np.searchsorted(w.starts, w.starts[first] + STEP, "right")) - 1)
            a, b = w.starts[first], w.starts[last]
            each[first:last] = np.add.reduceat(self.bits(w.points[a:b], w.at[a:b]), w.starts[first:last] - a, axis=0)
            first = last
        run = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(each[w.which], axis=0)])
        size = np.concatenate([[0], np.cumsum((w.sizes - 1)[w.which])])
        a, b = w.bounds[:-1], w.bounds[1:]
        n = size[b] - size[a]
        return (run[b] - run[a]) / np.maximum(n, 1)[:, None], n

    def shares(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated probability of each language."""
        z = -entropy * (self.rate * np.sqrt(n))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def calibrate(self, rows: pd.DataFrame) -> None:
        """From labelled texts (right, entropies, entropies of the same text with its letters shuffled, n, and whether the
        models were fitted on it): the rate that makes the shares of the others most likely, and for each language a
        limit between the entropy of such texts and that of letters in no order. One rule for any number of texts: a
        language's fitted texts, and how much higher fresh ones are in all languages, stand for the fresh ones it lacks."""
        rows = rows[rows.n > 0]
        if not len(rows):
            return
        entropy, noise = np.array(rows.entropy.tolist()), np.array(rows.noise.tolist())
        n, fresh = rows.n.to_numpy(float), ~rows.seen.to_numpy(bool)
        right = rows.right.map({x: i for i, x in enumerate(self.langs)}).to_numpy(int)
        judged = fresh if fresh.any() else ~fresh

        def loss(rate: float) -> float:
            self.rate = rate
            return -np.log(np.maximum(self.shares(entropy[judged], n[judged])[np.arange(judged.sum()), right[judged]], 1e-9)).mean()

        self.rate = min(2.0 ** np.arange(-4, 7), key=loss)
        own, other = entropy[np.arange(len(right)), right], noise.min(axis=1)
        mean_of = lambda some: np.average(own[some], weights=n[some]) if some.any() else None
        of = [(mean_of((right == i) & ~fresh), mean_of((right == i) & fresh)) for i in range(len(self.langs))]
        # How much higher fresh texts are than fitted ones, over all languages.
        step = np.mean([b / a for a, b in of if a and b] or [1.0])
        middle = np.array([own[right == i].mean() if (right == i).any() else np.nan for i in range(len(self.langs))])
        spread = (n * (own - middle[right]) ** 2)[judged].mean()
        for i, (fitted, new) in enumerate(of):
            mine, size = (right == i) & fresh, n[(right == i) & fresh]
            if fitted is None and new is None:
                continue  # its texts have no letter, so none is ever put there
            # Fresh texts, and what the fitted ones let expect for POOLED characters and texts more.
            mean = (size @ own[mine] + POOLED[0] * (fitted * step if fitted else new)) / (size.sum() + POOLED[0])
            noisy = np.average(other[right == i], weights=n[right == i])
            wide = ((size * (own[mine] - mean) ** 2).sum() + POOLED[1] * spread) / (len(size) + POOLED[1])
            self.normal[i] = mean + LENIENCE * (noisy - mean), 3 * np.sqrt(wide)

    def accepts(self, best: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Texts whose entropy under the best language is below its limit, which is higher for short texts."""
        ok = n > 0
        for i, (limit, spread) in self.normal.items():
            ok &= ~((best == i) & (entropy[:, i] > limit + spread / np.sqrt(np.maximum(n, 1))))
        return ok


def fit(labelled: DataFrame, key: str, text: str, lang: str, docs: int = DOCS, chars: int = CHARS) -> Model:
    """Models of all languages in ``labelled`` (rows without a language or text do not count).

    At most about ``docs`` texts or ``chars`` characters of each language, picked
    by a hash of the key, are fitted (three of four, the one with the least hash
    in any case) and calibrated on (the rest); so a language with one text is
    learned, and the tables, which are broadcast, do not grow with the input.
    Counts and estimates are made by Spark. Without any labelled text the model
    has no language.
    """
    for_python(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"),
                           F.xxhash64(F.lit(5), F.col(f"`{key}`")).alias("draw")).where("lang is not null and text is not null")
    pick = F.pmod("draw", F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.min(pick).alias("first"))
    share = F.least(F.lit(1.0), F.lit(float(docs)) / F.col("docs"), F.lit(float(chars)) / F.greatest("chars", F.lit(1)))
    shares = stash(sizes.select("lang", share.alias("share"), "first"), "shares")
    picked = rows.join(bounded_broadcast(shares), "lang").where((pick <= F.col("share") * (1 << 30)) | (pick == F.col("first")))
    fold = F.when(pick == F.col("first"), 0).otherwise(F.pmod(F.shiftright("draw", 32), F.lit(4)))
    sample = stash(picked.select("lang", "text", fold.alias("fold")), "sample")
    counts = stash(_counts(sample.where("fold < 3").select("lang", "text"))
                   .groupBy("lang", "n", "gram", "context", "suffix", "first").agg(F.sum("seen").alias("seen")), "grams")
    model = Model(_estimate(counts).toPandas())
    if model.langs:
        model.calibrate(_entropies(sample.where("fold in (0, 3)"), model).toPandas())
    return model


def _entropies(sample: DataFrame, model: Model) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<entropy:array<double>,noise:array<double>,n:long>")
    def measure(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            letters = [c for c in text if c.isalpha()]
            np.random.Generator(np.random.PCG64(len(letters))).shuffle(letters)
            rest = iter(letters)
            (entropy, noise), n = shared.value.entropies([text, "".join(next(rest) if c.isalpha() else c for c in text)])
            rows.append({"entropy": entropy.tolist(), "noise": noise.tolist(), "n": int(n[0])})
        listed = pa.list_(pa.float64())
        return pa.array(rows, pa.struct([("entropy", listed), ("noise", listed), ("n", pa.int64())]))

    known = sample.where(F.col("lang").isin(model.langs))
    return known.select(F.col("lang").alias("right"), (F.col("fold") < 3).alias("seen"), measure("text").alias("m")).select("right", "seen", "m.*")


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``record`` (all columns) and ``found``: lang, score (calibrated, 0 to 1), entropy, letters, accepted.

    Null and empty texts and texts without a letter are ``und``, score 0 and not
    accepted, and so is every text if the model has no language. Ties go to the
    language first in order. Whole texts of any length count, one pass, no shuffle.
    """
    for_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,entropy:double,letters:long,accepted:boolean>")
    def run(column: pa.Array) -> pa.Array:
        m, out = shared.value, []
        texts = column.to_pylist()
        for begin, end in words.chunks(column.cast(pa.binary()).to_pylist()):
            if not m.langs:
                none = np.zeros(end - begin)
                out.append((["und"] * (end - begin), none, none, none.astype(int), none > 0))
                continue
            entropy, n = m.entropies(texts[begin:end])
            best, any_letter = entropy.argmin(axis=1), n > 0
            least = entropy[np.arange(len(best)), best]
            score = np.where(any_letter, m.shares(entropy, n)[np.arange(len(best)), best], 0.0)
            names = [m.langs[i] if k else "und" for i, k in zip(best, any_letter)]
            out.append((names, score, least, n, m.accepts(best, entropy, n)))
        columns = [np.concatenate([o[k] for o in out]) if out else [] for k in range(1, 5)]
        return pa.StructArray.from_arrays(
            [pa.array([x for o in out for x in o[0]], pa.string()), pa.array(columns[0], pa.float64()),
             pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.bool_())],
            ["lang", "score", "entropy", "letters", "accepted"])

    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(record.alias("record"), run(F.col(f"`{text}`")).alias("found"))
