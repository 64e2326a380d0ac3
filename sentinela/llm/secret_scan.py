"""Secret scanning: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Texts are cut into tokens (runs of word characters, runs of other signs). Each
token is tagged as the begin of a secret, inside one, or outside, from its
shape, the tokens next to it and features of the whole text; the best tag
sequence is found by Viterbi. The weights are trained on texts in which the
patterns found a value.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import _words as words
from sentinela.llm._base import for_python

#: Patterns and least lengths of the base spans (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "crf")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Texts with and without a base span that the weights are trained on, at most; tokens around a span; steps.
SAMPLE, AROUND, STEPS = 500, 24, 120
#: Words that announce a secret.
KEYWORDS = ("password", "passwd", "pwd", "passphrase", "secret", "secret_key", "token", "auth_token", "access_token",
            "access_key", "api_key", "api-key", "apikey", "key", "private_key", "credential", "credentials", "bearer",
            "authorization")
#: Signs between name and value, and alphabets of values, of the made-up secrets in training texts.
JOINTS = (" = \"", ": ", ":", "=", " ", " is ", " -> ", "\": \"")
SHAPES = tuple(map(tuple, (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
                           string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits,
                           string.hexdigits[:16], string.ascii_letters + string.digits + "_-")))
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
NEVER = -1e4


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, leftmost non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A run of 24 and more is the whole run: a shorter one fails and holds no other.
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


_CLASS = np.full(256, 2, np.int8)  # 0 white space, 1 word character, 2 other sign
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-", *range(0x80, 0x100)]] = 1


def _among(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _UPPER, _LOWER = _among(range(0x30, 0x3A)), _among(range(0x41, 0x5B)), _among(range(0x61, 0x7B))
_HEX, _WIDE = _DIGIT | _among(b"abcdef"), _among(range(0x80, 0x100))
_SETS, _QUOTES = _among(b"=:"), _among(b"\"'`")


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64),
                            np.cumsum(words.BYTE[data] * words.powers(words.BASE, len(data)), dtype=np.uint64)])
    return (total[end] - total[begin]) * words.powers(words.INVERSE, len(data))[begin]


class Tokens:
    """Tokens of some texts with their features."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        kind = _CLASS[data]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        inside = kind[edge] > 0
        stop = np.append(edge[1:], len(data))
        self.begin, self.end = edge[inside], stop[inside]
        self.offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.begin, self.offsets)
        self.x = self._features(data, kind)

    def _features(self, data: np.ndarray, kind: np.ndarray) -> np.ndarray:
        begin, end, n = self.begin, self.end, len(self.begin)

        def count(flags: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
            return run[end] - run[begin]

        size = end - begin
        digit, upper, lower, hexes, wide = (count(s[data]) for s in (_DIGIT, _UPPER, _LOWER, _HEX, _WIDE))
        sort = _DIGIT[data] * np.int8(1) + _UPPER[data] * np.int8(2) + _LOWER[data] * np.int8(3)
        turns = count(np.concatenate([[False], (sort[1:] != sort[:-1]) & (kind[1:] == 1) & (kind[:-1] == 1)])) / np.maximum(size, 1)
        word = kind[begin] == 1 if n else np.zeros(0, bool)
        low = np.where(_UPPER[data], data + np.uint8(32), data)
        keyword = word & np.isin(_hashes(low, begin, end), _KEYWORDS) if n else word
        sets, quotes = count(_SETS[data]) > 0, count(_QUOTES[data]) > 0
        mixed = word & (digit > 0) & (upper + lower > 0)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

        def near(flags: np.ndarray, by: int) -> np.ndarray:
            """Whether the token ``by`` places on (before, if negative) in the same text has the flag."""
            out = np.zeros(n, bool)
            if by < 0:
                out[-by:] = flags[:by] & (text[-by:] == text[:by])
            elif by < n:
                out[:-by] = flags[by:] & (text[:-by] == text[by:])
            return out

        told = near(keyword, -1) | near(keyword, -2) | near(keyword, -3)
        given = near(sets, -1) | near(sets, -2)
        per_text = np.maximum(np.diff(self.bounds), 1)
        share = lambda flags: np.add.reduceat(np.append(flags, 0), self.bounds[:-1]) * (np.diff(self.bounds) > 0) / per_text
        shape = [word, ~word, word & (size <= 3), word & (size > 3) & (size < 8), word & (size >= 8) & (size < 12),
                 word & (size >= 12) & (size < 16), word & (size >= 16) & (size < 20), word & (size >= 20) & (size < 32),
                 word & (size >= 32), word & (digit == size), mixed, word & (digit == 0), word & (upper == size),
                 word & (lower == size), word & (upper > 0) & (lower > 0), word & (hexes == size) & (size >= 16),
                 word & (digit + upper == size) & mixed, turns > 0.15, turns > 0.3, wide > 0, keyword, sets, quotes,
                 mixed & (size >= 16), mixed & (size >= 16) & (turns > 0.15)]
        around = [near(keyword, -1), near(keyword, -2), near(keyword, -3), near(sets, -1), near(sets, -2),
                  near(quotes, -1), near(quotes, 1), near(mixed & (size >= 12), -1), near(~word, -1), near(~word, 1),
                  told, given, told & given, told & mixed, told & given & word & (size >= 6), told & mixed & (size >= 12)]
        file = [share(keyword)[text] > 0, share(~word)[text] > 0.2, share(mixed)[text] > 0.1]
        x = np.ones((n, len(shape) + len(around) + len(file) + 1), np.float32)
        for i, flags in enumerate(shape + around + file):
            x[:, i] = flags
        return x


_KEYWORDS = np.concatenate([_hashes(np.frombuffer(k.encode(), np.uint8), np.array([0]), np.array([len(k)])) for k in KEYWORDS])


class Crf:
    """Weights of features (features x tags) and of tag pairs (from, to)."""

    def __init__(self, features: int):
        self.w = np.zeros((features, 3))
        self.t = np.zeros((3, 3))
        self.w[-1, OUTSIDE] = 2.0
        self.t[OUTSIDE, INSIDE] = NEVER

    def _log_pass(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores and the log sum of all paths of padded sequences (count x length x tags)."""
        count, length, _ = e.shape
        f, b = np.full(e.shape, NEVER), np.zeros(e.shape)
        f[:, 0] = e[:, 0] + self.t[OUTSIDE]
        for i in range(1, length):
            step = np.logaddexp.reduce(f[:, i - 1, :, None] + self.t, axis=1) + e[:, i]
            f[:, i] = np.where(mask[:, i, None], step, f[:, i - 1])
        b[:, -1] = self.t[:, OUTSIDE]
        for i in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(self.t + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
            b[:, i] = np.where(mask[:, i + 1, None], step, self.t[:, OUTSIDE])
        return f, b, np.logaddexp.reduce(f[:, -1] + self.t[:, OUTSIDE], axis=1)

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = STEPS) -> None:
        """Gradient ascent on the log likelihood of padded sequences, with a small penalty on large weights."""
        hot = np.eye(3)[y] * mask[:, :, None]
        tokens = mask.sum()
        before = np.concatenate([np.full((len(y), 1), OUTSIDE), y[:, :-1]], axis=1)
        seen = np.zeros((3, 3))
        np.add.at(seen, (before[mask], y[mask]), 1)
        size_w, size_t = np.full(self.w.shape, 1e-8), np.full((3, 3), 1e-8)
        for _ in range(steps):
            e = x @ self.w
            f, b, z = self._log_pass(e, mask)
            tags = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
            first = np.exp(self.t[OUTSIDE] + e[:, 0] + b[:, 0] - z[:, None]).sum(axis=0)
            pairs = (f[:, :-1, :, None] + self.t + (e[:, 1:] + b[:, 1:])[:, :, None, :]) - z[:, None, None, None]
            expected = (np.exp(pairs) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            expected[OUTSIDE] += first
            up_w = np.einsum("stf,stk->fk", x, hot - tags) / tokens * 100 - 0.002 * self.w
            up_t = (seen - expected) / tokens * 100 - 0.002 * np.where(self.t == NEVER, 0, self.t)
            up_t[OUTSIDE, INSIDE] = 0
            size_w, size_t = size_w + up_w ** 2, size_t + up_t ** 2
            self.w += 0.5 * up_w / np.sqrt(size_w)
            self.t += 0.5 * up_t / np.sqrt(size_t)

    def spans(self, tokens: Tokens) -> list[tuple[int, int]]:
        """First and last token of each secret on the best path of every text.

        A run of tokens can only be tagged if it scores more than the same run
        outside, transitions at their best. Tokens in no such run are outside on
        the best path, so Viterbi only has to pass over the stretches of others.
        """
        n = len(tokens.begin)
        if not n:
            return []
        e = tokens.x @ self.w.astype(np.float32)
        slack = max(0.0, float(self.t.max() - self.t[OUTSIDE, OUTSIDE]))
        gain = np.maximum(e[:, BEGIN], e[:, INSIDE]).astype(np.float64) - e[:, OUTSIDE] + slack
        apart = np.zeros(n, bool)
        apart[tokens.bounds[:-1][np.diff(tokens.bounds) > 0]] = True  # first tokens of texts
        at = np.arange(n) + np.cumsum(apart)  # a place of its own between texts
        lined = np.full(at[-1] + 2, -1e6)
        lined[at] = gain

        def best_up_to(g: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0.0], np.cumsum(g)])
            return run[1:] - np.minimum.accumulate(run)[:-1]

        live = (best_up_to(lined) + best_up_to(lined[::-1])[::-1] - lined)[at] > -slack - 1e-6
        places = np.flatnonzero(live)
        if not len(places):
            return []
        cuts = np.flatnonzero((np.diff(places) > 1) | apart[places[1:]]) + 1
        return [s for part in np.split(places, cuts) for s in self._viterbi(e[part], int(part[0]))]

    def _viterbi(self, e: np.ndarray, first: int) -> list[tuple[int, int]]:
        score, back = self.t[OUTSIDE] + e[0], []
        for i in range(1, len(e)):
            step = score[:, None] + self.t
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + e[i]
        tag = int((score + self.t[:, OUTSIDE]).argmax())
        tags = [tag]
        for choice in reversed(back):
            tag = int(choice[tag])
            tags.append(tag)
        out: list[list[int]] = []
        for i, tag in enumerate(reversed(tags)):
            if tag == BEGIN:
                out.append([first + i, first + i])
            elif tag == INSIDE:
                out[-1][1] = first + i
        return [(a, b) for a, b in out]


def _labelled(body: str, values: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and tags of the tokens around each value (code points), or of stretches of a text without one."""
    tokens = Tokens([body.encode()])
    n = len(tokens.begin)
    tags, centres = np.full(n, OUTSIDE), []
    for start, end in values:
        a, b = len(body[:start].encode()) + 1, len(body[:end].encode()) + 1
        own = np.flatnonzero((tokens.begin < b) & (tokens.end > a))
        if len(own):
            tags[own[0]], tags[own[1:]] = BEGIN, INSIDE
            centres.append(int(own[0]))
    out = []
    for c in centres or range(AROUND, n + AROUND, max(8 * AROUND, n // 4)):
        a, b = max(0, c - AROUND), min(n, c + AROUND)
        y = tags[a:b].copy()
        y[:1] = np.where(y[:1] == INSIDE, BEGIN, y[:1])
        out.append((tokens.x[a:b], y))
    return [(x, y) for x, y in out if len(y)]


def _planted(body: str, at: int, draw: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A stretch of the text around ``at`` with a made-up secret: the patterns know few names, signs and shapes."""
    pick = lambda options: options[int(draw.integers(0, len(options)))]
    shape = pick(SHAPES)
    value = "".join(pick(shape) for _ in range(int(draw.integers(12, 41))))
    head = body[max(0, at - 120):at] + pick(KEYWORDS) + pick(JOINTS)
    return head + value + pick(('"', " ", "\n", "; ")) + body[at:at + 120], [(len(head), len(head) + len(value))]


def train(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Crf:
    """Weights from about ``sample`` texts with a base span and as many without, picked by a hash of key and text.

    Silver labels: the values of the base spans, and made-up secrets of further
    names, signs and shapes put into the same texts. Training sequences are the
    tokens around each value and stretches of the texts without one.
    """
    pattern = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|(?-i)AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    body = F.col(f"`{text}`")
    rows = df.where(body.isNotNull()).select(body.alias("text"), body.rlike(pattern).alias("hit"), (F.xxhash64(
        F.lit(6), F.col(f"`{key}`"), body).bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))).alias("draw"))
    counts = {r["hit"]: r["n"] for r in rows.groupBy("hit").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("hit"), sample / max(counts.get(True, 0), sample)).otherwise(sample / max(counts.get(False, 0), sample))
    picked = rows.where(F.col("draw") < share).select("text", "hit").distinct().collect()
    texts = [sorted(r["text"] for r in picked if r["hit"] == side) for side in (True, False)]
    sequences, draw = [], np.random.Generator(np.random.PCG64(sample))
    for bodies in texts:
        for body in bodies:
            found = [(start, end) for _, _, end, start in base_spans(body)]
            sequences += _labelled(body, found)
            for at, _ in found or [(body.find(" ", int(draw.integers(0, len(body) + 1))) + 1, 0)]:
                sequences += _labelled(*_planted(body, at, draw))
    features = Tokens([b"x"]).x.shape[1]
    model = Crf(features)
    if any((y == BEGIN).any() for _, y in sequences):
        length = max(len(y) for _, y in sequences)
        x = np.zeros((len(sequences), length, features), np.float32)
        y, mask = np.full((len(sequences), length), OUTSIDE), np.zeros((len(sequences), length), bool)
        for i, (sx, sy) in enumerate(sequences):
            x[i, :len(sy)], y[i, :len(sy)], mask[i, :len(sy)] = sx, sy, True
        model.train(x, y, mask)
    return model


def scan(df: DataFrame, text: str, model: Crf) -> DataFrame:
    """``record`` (all columns) and ``found``: array of (start, kind, end), by start and then kind.

    Offsets are code points, the end exclusive. Base spans are those of the
    patterns; a ``crf`` span is added where the tagger finds a secret that no
    base span covers or touches. Null and empty texts have none. Whole texts of
    any length are scanned, one pass, no shuffle. A model trained without any
    secret tags nothing.
    """
    for_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<start:int,kind:string,end:int>>")
    def run(column: pa.Array) -> pa.Array:
        texts, out = [t or "" for t in column.to_pylist()], []
        data = [t.encode() for t in texts]
        for begin, end in words.chunks(data):
            tokens = Tokens(data[begin:end])
            tagged: dict[int, list] = {}
            for a, b in shared.value.spans(tokens):
                own = int(np.searchsorted(tokens.bounds, a, "right")) - 1
                tagged.setdefault(own, []).append((int(tokens.begin[a]), int(tokens.end[b])))
            for i in range(begin, end):
                spans = [(s, kind, e) for s, kind, e, _ in base_spans(texts[i])]
                shift = int(tokens.offsets[i - begin])
                for a, b in tagged.get(i - begin, []):
                    start = len(data[i][:a - shift].decode())
                    stop = start + len(data[i][a - shift:b - shift].decode())
                    if not any(s < stop and start < e for s, k, e in spans if k < 3):
                        spans.append((start, 3, stop))
                out.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(spans)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])))

    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(record.alias("record"), run(F.col(f"`{text}`")).alias("found"))
