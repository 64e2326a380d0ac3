"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities of a lexicon of word stems that is learned from
labelled texts, how near its words are to the second person, and rates of
capitals, punctuation and obfuscation (figures or signs within words, stretched
or spaced letters), with lexicon words found behind the obfuscation. The trees
are fitted to the logistic loss on histograms; isotonic regression on texts
that neither lexicon nor trees have seen turns their margins into chances.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm._base import for_python, stash

#: About so many labelled texts are fitted and calibrated on.
DOCS = 12_000
#: Lengths of word stems; a stem needs so many toxic texts, such odds against clean ones and so many standard deviations.
SHORT, LONGEST, TEXTS, ODDS, DEVIATIONS = 3, 12, 3, 3.0, 5.0
#: At most so many stems are kept, those with the most deviations first.
STEMS = 5_000
#: Trees, their depth, step, bins of a feature, ridge on a leaf.
ROUNDS, DEPTH, RATE, BINS, RIDGE = 60, 4, 0.15, 64, 1.0
#: Words on either side of a second person that count as near, and in the window for the densest part.
NEAR, WINDOW = 5, 20
#: Chunks a task remembers, and characters of a text it takes apart at once.
REMEMBER, STEP = 200_000, 1 << 18

# Second person in English, German, French and Spanish; figures and signs written for letters.
SECOND = ("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure "
          "tu te toi ton ta tes vous votre vos ti tuyo tus usted ustedes vosotros os vuestro").split()
_SECOND = frozenset(SECOND)
SIGNS = str.maketrans("0134578@$!|+", "oieastbasilt")

SPACE = re.compile(r"\s")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
FEATURES = ("words", "hits", "hit_density", "weight_density", "weight", "largest", "different", "strong_density", "densest",
            "second", "near_share", "near_density", "upper", "capital_words", "exclamations", "questions", "signs", "figures",
            "mixed_words", "hidden_density", "stretched")


def stems(word: str) -> list[str]:
    """The word with an end mark, and its beginnings of ``SHORT`` to ``LONGEST`` letters."""
    return [word + "$", *(word[:k] for k in range(SHORT, min(len(word), LONGEST) + 1))]


def plain(chunk: str) -> str:
    """A chunk in lower case without the signs around it."""
    word = chunk.lower()
    return word if word.isalpha() else word.strip("".join({c for c in word if not c.isalnum()}))


def revealed(word: str) -> str:
    """The letters that an obfuscated word stands for; the empty string if it is not obfuscated."""
    if word.isalpha() and not STRETCHED.search(word):
        return ""
    letters = "".join(c for c in STRETCHED.sub(r"\1", word.translate(SIGNS)) if c.isalpha())
    return letters if letters != word and any(c.isalpha() for c in word) else ""


class Chunks(dict):
    """Row in ``grid`` of each chunk known so far: what it adds to the features by itself.

    Chunks that add the same share a row; each one found in the lexicon has its own.
    """

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.begins = lexicon, {s[:SHORT] for s in lexicon}
        self.shared: dict[tuple, int] = {}
        self.grid, self.used = np.zeros((1 << 10, 13)), 0

    def weight(self, word: str) -> float:
        if word[:SHORT] not in self.begins and word + "$" not in self.lexicon:
            return 0.0
        return max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0) if word else 0.0

    def _row(self, added: tuple) -> int:
        at = self.used
        if at == len(self.grid):
            self.grid = np.concatenate([self.grid, np.zeros_like(self.grid)])
        self.grid[at] = added
        self.used += 1
        return at

    def __missing__(self, chunk: str) -> int:
        n = len(chunk)
        if chunk.isalpha() and chunk.islower():
            word, letters, upper, figures, bang, ask = chunk, n, 0, 0, 0, 0
        else:
            word, letters, upper = plain(chunk), sum(map(str.isalpha, chunk)), sum(map(str.isupper, chunk))
            figures, bang, ask = sum(map(str.isdigit, chunk)), chunk.count("!"), chunk.count("?")
        weight, stretched = self.weight(word), STRETCHED.search(word) is not None
        hidden = 0.0 if word.isalpha() and not stretched else self.weight(revealed(word))
        added = (max(weight, hidden), word in _SECOND, letters, upper, letters > 2 and upper == letters, bang, ask,
                 n - letters - figures - bang - ask, figures, letters > 0 and not word.isalpha(),
                 hidden > weight, stretched, len(word) == 1 and letters == 1)
        at = self.shared.get(added) if not added[0] else None
        if at is None:
            at = self._row(added)
            if not added[0]:
                self.shared[added] = at
        self[chunk] = at
        return at


def blocks(text: str) -> Iterator[list[str]]:
    """The chunks of a text, from about ``STEP`` characters at a time."""
    a = 0
    while a < len(text):
        end = SPACE.search(text, min(a + STEP, len(text)))
        b = end.start() if end else len(text)
        yield text[a:b].split()
        a = b + 1


class Features:
    """Dense features of texts for a lexicon (stem -> weight)."""

    def __init__(self, lexicon: dict[str, float]):
        self.known = Chunks(lexicon)

    def of(self, text: str | None) -> np.ndarray:
        """One row of ``FEATURES``; zeros for null and empty texts and texts of white space."""
        if len(self.known) > REMEMBER:
            self.known = Chunks(self.known.lexicon)
        parts = [np.fromiter(map(self.known.__getitem__, part), np.int64, len(part)) for part in blocks(text or "")]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n = len(at)
        if not n:
            return np.zeros(len(FEATURES))
        own, counts = np.unique(at, return_counts=True)
        total = counts @ self.known.grid[own]
        weight, hidden = self.known.grid[at, 0], total[10]
        if total[12] >= SHORT:
            for word, a in spaced(text, self.known.grid[at, 12] > 0):
                value = self.known.weight(word)
                if value > weight[a]:
                    weight[a], hidden = value, hidden + 1
        letters, hits = max(total[2], 1.0), np.flatnonzero(weight)
        near = densest = 0
        if len(hits):
            densest = int((np.searchsorted(hits, hits + WINDOW) - np.arange(len(hits))).max())
            if total[1]:
                persons = np.flatnonzero(self.known.grid[at, 1])
                after = np.searchsorted(persons, hits)
                gap = np.minimum(np.abs(hits - persons[np.minimum(after, len(persons) - 1)]),
                                 np.abs(hits - persons[np.maximum(after - 1, 0)]))
                near = int((gap <= NEAR).sum())
        mass = weight.sum()
        return np.array([np.log1p(n), np.log1p(len(hits)), len(hits) / n, mass / n, np.log1p(mass), weight.max(),
                         np.log1p(len(np.unique(at[hits]))), (weight >= 2).sum() / n, densest, total[1] / n,
                         near / max(len(hits), 1), near / n, total[3] / letters, total[4] / n, total[5] / n, total[6] / n,
                         total[7] / n, total[8] / n, total[9] / n, hidden / n, total[11] / n])


def spaced(text: str, single: np.ndarray) -> Iterator[tuple[str, int]]:
    """Words written as letters with spaces between them, with the place of their first chunk; ``single`` marks lone letters."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    runs = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= SHORT]
    first, i = 0, 0
    for part in blocks(text) if runs else ():
        last = first + len(part)
        while i < len(runs) and runs[i][0] < last:  # a run that two blocks share is cut there
            a, b = runs[i]
            yield "".join(plain(c) for c in part[max(a, first) - first:b - first]), max(a, first)
            if b > last:
                break
            i += 1
        first = last


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown level by level on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        bins = self._bins(x)
        margin = np.full(len(y), self.start)
        for _ in range(ROUNDS if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self._value(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int64)

    def _grow(self, bins: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature (-1: none) and last bin to the left for each inner node of a full tree, and the leaves' values."""
        n, width = bins.shape
        inner = (1 << DEPTH) - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, size = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(size)
            total = [np.bincount(local, w, size) for w in (gradient, curve)]
            for f in range(width):
                key = local * BINS + bins[:, f]
                g, h = (np.bincount(key, w, size * BINS).reshape(size, BINS).cumsum(axis=1) for w in (gradient, curve))
                rest_g, rest_h = total[0][:, None] - g, total[1][:, None] - h
                gain = (g ** 2 / (h + RIDGE) + rest_g ** 2 / (rest_h + RIDGE) - (total[0] ** 2 / (total[1] + RIDGE))[:, None])
                gain[(h < 0.5) | (rest_h < 0.5)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(size), at]
                better = value > best + 1e-9
                best[better], feature[first:first + size][better], cut[first:first + size][better] = value[better], f, at[better]
            node = self._down(node, feature, cut, bins)
        leaf = node - inner
        g, h = (np.bincount(leaf, w, 1 << DEPTH) for w in (gradient, curve))
        return feature, cut, RATE * g / (h + RIDGE)

    @staticmethod
    def _down(node: np.ndarray, feature: np.ndarray, cut: np.ndarray, bins: np.ndarray) -> np.ndarray:
        f = feature[node]
        right = (f >= 0) & (bins[np.arange(len(node)), np.maximum(f, 0)] > cut[node])
        return 2 * node + 1 + right

    def _value(self, tree: tuple, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = self._down(node, tree[0], tree[1], bins)
        return tree[2][node - len(tree[0])]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = self._bins(x), np.full(len(x), self.start)
        for tree in self.trees:
            out += self._value(tree, bins)
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and chances between which the non-decreasing least-squares fit is interpolated (pool adjacent violators)."""
    points, own = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # sum, count, first and last margin
    for m, s, n in zip(points, np.bincount(own, y), np.bincount(own)):
        blocks.append([s, n, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    return (np.array([m for b in blocks for m in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)]))


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.trees = lexicon, None
        self.points, self.chances = np.zeros(1), np.zeros(1)
        self._features: Features | None = None

    @property
    def features(self) -> Features:
        """One for all batches of a Python worker, so chunks are looked at once."""
        if self._features is None:
            self._features = Features(self.lexicon)
        return self._features

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_features": None}

    def fit(self, x: np.ndarray, y: np.ndarray, unseen: np.ndarray) -> None:
        """Trees on the rows that are not ``unseen``, calibration on those that are (on all rows if there are none)."""
        if not len(y):
            return
        fitted = ~unseen if (~unseen).any() else unseen
        self.trees = Trees(x[fitted], y[fitted])
        rest = unseen if unseen.any() else fitted
        self.points, self.chances = isotonic(self.trees.margins(x[rest]), y[rest])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margins(x), self.points, self.chances) if self.trees else np.zeros(len(x))


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Stems whose texts are far more often toxic than clean, with the logarithm of the odds of their occurrences."""
    def run(batches):
        texts: dict[str, list[int]] = {}
        words: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict[str, int] = {}
                for part in blocks(text or ""):
                    for chunk in part:
                        own[chunk] = own.get(chunk, 0) + 1
                every: set[str] = set()
                for chunk, n in own.items():
                    word = plain(chunk)
                    word = revealed(word) or word
                    if len(word) >= SHORT:
                        every.update(stems(word))
                        words.setdefault(word, [0, 0])[y] += n
                for s in every:
                    texts.setdefault(s, [0, 0])[y] += 1
        seen = {s: [0, 0] for s in texts}
        for word, n in words.items():
            for s in stems(word):
                seen[s][0] += n[0]
                seen[s][1] += n[1]
        names = ["stem", "clean", "toxic", "clean_words", "toxic_words"]
        keys = list(texts)
        for a in range(0, len(keys), 10_000):
            part = keys[a:a + 10_000]
            columns = [[texts[s][0] for s in part], [texts[s][1] for s in part], [seen[s][0] for s in part], [seen[s][1] for s in part]]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c, pa.int64()) for c in columns)], names)

    sizes = {r["y"]: r for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    if len(sizes) < 2:
        return {}
    counts = (sample.select("text", "y").mapInArrow(run, "stem string, clean long, toxic long, clean_words long, toxic_words long")
              .groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "clean_words", "toxic_words")]))
    odds = F.log((F.col("toxic") + 0.5) / float(sizes[1]["n"]) / ((F.col("clean") + 0.5) / float(sizes[0]["n"])))
    n = float(sizes[1]["n"]), float(sizes[0]["n"])
    pooled = (F.col("toxic") + F.col("clean")) / sum(n)
    deviations = (F.col("toxic") / n[0] - F.col("clean") / n[1]) / F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
    chars = float(sizes[1]["chars"] or 1), float(sizes[0]["chars"] or 1)
    weight = F.log((F.col("toxic_words") + 0.5) / chars[0] / ((F.col("clean_words") + 0.5) / chars[1]))
    kept = (counts.select("stem", weight.alias("weight"), deviations.alias("deviations"))
            .where((F.col("toxic") >= TEXTS) & (odds >= float(np.log(ODDS))) & (deviations >= DEVIATIONS) & (weight > 0))
            .orderBy(F.desc("deviations"), "stem").limit(STEMS))
    return {r["stem"]: float(r["weight"]) for r in kept.collect()}


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, size: int = DOCS) -> Model:
    """A model learned from the texts of ``docs`` that ``labels`` (key, label 0 or 1) marks.

    At most about ``size`` labelled texts, picked by a hash of the key: three of
    four give the lexicon and the trees, the rest the calibration. Keys with
    several labels count as toxic if one says so; labels without key or value
    do not count. Without any labelled text every score is 0; with one class
    only, scores are its share.
    """
    for_python(docs.sparkSession)
    marks = (labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y in (0, 1)")
             .groupBy("k").agg(F.max("y").alias("y")))
    marks = marks.withColumn("draw", F.xxhash64(F.lit(11), "k"))
    share = min(1.0, size / max(marks.count(), 1))
    picked = marks.where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)))  # about ``size`` rows: small enough to broadcast
    sample = stash(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "k")
                   .select("text", "y", (F.pmod(F.shiftright("draw", 32), F.lit(4)) == 3).alias("unseen")), "sample")
    model = Model(_lexicon(sample.where("not unseen")))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.features.of(t).tolist() for t in column.to_pylist()], pa.list_(pa.float64()))

    # An order of its own: histograms add up floats, and reruns shall agree.
    rows = sorted((tuple(r["x"]), r["y"], r["unseen"]) for r in sample.select(features("text").alias("x"), "y", "unseen").collect())
    if rows:
        model.fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool))
    return model


def score(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``record`` (all columns) and ``score``, the chance (0 to 1) that the text is toxic.

    Whole texts of any length count; null and empty texts and texts of white
    space have features of zero and get the score of those. Repeated texts have
    the same score. One pass, no shuffle. An empty table gives no rows.
    """
    for_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        rows = [shared.value.features.of(t) for t in column.to_pylist()]
        return pa.array(shared.value.scores(np.array(rows).reshape(len(rows), len(FEATURES))), pa.float64())

    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(record.alias("record"), run(F.col(f"`{text}`")).alias("score"))
