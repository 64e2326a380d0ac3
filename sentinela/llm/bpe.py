"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

For each piece of text an Aho-Corasick automaton over the vocabulary finds the
longest token at every position. The encoder walks the piece taking the longest
token that is compatible with the one before, falls back to shorter prefixes,
and backs out of positions from which no compatible token leads on; positions
found to be dead ends are never tried twice, so the work is linear. Two tokens
are compatible if merging by rank would leave the cut between them, and the
only sequence whose neighbours are all compatible is what the merges produce.
"""

from __future__ import annotations

import json
from array import array
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm._base import for_python

#: The byte-level pre-tokenizer's pattern (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept in a task's memory of pieces and of token pairs; beyond that the memory starts anew.
PIECES, PAIRS = 200_000, 100_000


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: itself if printable, else 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """Tokens as bytes by id, merges as pairs of ids by rank, and the added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names, model = byte_names(), spec["model"]
    ids = model["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for name, i in ids.items():
        tokens[i] = name.encode() if name in added else bytes(names[c] for c in name)
    for name, i in added.items():
        tokens[i] = name.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {"tokens": tokens, "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges], "added": added}


class Encoder:
    def __init__(self, vocabulary: dict):
        tokens, merges = vocabulary["tokens"], vocabulary["merges"]
        special = set(vocabulary["added"].values())
        self.length = [len(t) for t in tokens]
        self.rank = [0] * len(tokens)  # 0: a single byte
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)
        self.merge = {}
        for rank, (a, b, ab) in enumerate(merges, 1):
            if self.rank[ab]:
                raise ValueError("two merges make the same token")
            self.rank[ab], self.parts[ab], self.merge[a, b] = rank, (a, b), rank
        self.automaton, known = ahocorasick.Automaton(), {}
        for i, t in enumerate(tokens):
            if i not in special and (self.rank[i] or len(t) == 1):
                known[t.decode("latin-1")] = i
                if len(t) > 1:
                    self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.byte = [known[chr(b)] for b in range(256)]
        self.shorter: list[int | None] = [None] * len(tokens)  # the longest token that is a proper prefix
        for t, i in known.items():
            self.shorter[i] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), None)
        self.pattern = regex.compile(PATTERN)
        self.added = vocabulary["added"]
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the cut between two neighbouring tokens; remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a, b] = self._cut_stays(a, b)
        return known

    def _cut_stays(self, a: int, b: int) -> bool:
        """Undo the merges on both sides, latest first: no pair across the cut may have had its turn earlier.

        Of equal ranks the one further left comes first: the left token's before
        the pair's, the pair's before the right token's.
        """
        turn = float("inf")
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < turn:
                return False
            if self.rank[a] > self.rank[b]:
                turn, a = self.rank[a], self.parts[a][1]
            elif self.rank[b]:
                turn, b = self.rank[b] + 1, self.parts[b][0]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Tokens of one piece, given as one character for each byte."""
        size, length, shorter, fits = len(text), self.length, self.shorter, self.pairs.get
        byte = self.byte
        longest = [byte[b] for b in text.encode("latin-1")]
        for end, token in self.automaton.iter(text):
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        dead, at, token, last = bytearray(size + 1), 0, longest[0], None
        while True:
            while token is not None:
                if not dead[at + length[token]]:
                    if last is None:
                        break
                    good = fits((last, token))
                    if good or good is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token is None:
                dead[at] = 1
                back = out.pop()
                at, token, last = at - length[back], shorter[back], out[-1] if out else None
                continue
            out.append(token)
            at += length[token]
            if at == size:
                return out
            last, token = token, longest[at]

    def _learn(self, piece: str) -> bytes:
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        units = piece if piece.isascii() else piece.encode().decode("latin-1")
        packed = array("i", self.piece(units)).tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed 32-bit integers; added tokens in the text keep their own ids."""
        known, learn, out = self.pieces.get, self._learn, []
        for part in self.apart.split(text) if self.added else [text]:
            if part in self.added:
                out.append(np.int32(self.added[part]).tobytes())
            elif part:
                out += [known(p) or learn(p) for p in self.pattern.findall(part)]
        return b"".join(out)


class Decoder:
    """All tokens in one run of bytes, and the offset at which each begins."""

    def __init__(self, vocabulary: dict):
        tokens = vocabulary["tokens"]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.array([0, *accumulate(map(len, tokens))], np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of the id runs ids[bounds[i]:bounds[i + 1]]; ids outside the vocabulary add nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.start) - 1), ids, -1)
        begin = np.where(ids < 0, 0, self.start[ids])
        size = np.where(ids < 0, 0, self.start[ids + 1] - self.start[ids])
        ends = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
        out, cut = self.bytes[places].tobytes(), ends[bounds]
        return [out[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


_TABLES: dict = {}


def _table(kind: type, shared) -> Encoder | Decoder:
    """The tables of a broadcast vocabulary, built once in a Python worker."""
    at = (kind, shared.value["path"])
    if at not in _TABLES:
        _TABLES[at] = kind(shared.value)
    return _TABLES[at]


class Bpe:
    """Column functions of one vocabulary file; its tables (a fixed size) are broadcast.

    Null texts are empty, an empty text has no ids; texts of any length are
    encoded whole, piece by piece. Null ids add nothing to a decoded text, and
    bytes that are not UTF-8 become U+FFFD.
    """

    def __init__(self, spark: SparkSession, path: str):
        for_python(spark)
        shared = spark.sparkContext.broadcast(read_vocabulary(path) | {"path": path})

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return _encoded(_table(Encoder, shared), texts)

        @F.arrow_udf("string")
        def decode(rows: pa.Array) -> pa.Array:
            return _decoded(_table(Decoder, shared), rows)

        @F.arrow_udf("struct<ids:array<int>,decoded:string>")
        def both(texts: pa.Array) -> pa.Array:
            ids = _encoded(_table(Encoder, shared), texts)
            return pa.StructArray.from_arrays([ids, _decoded(_table(Decoder, shared), ids)], ["ids", "decoded"])

        self.encode, self.decode, self.both = encode, decode, both


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    rows = [encoder.encode(t) if t else b"" for t in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _decoded(decoder: Decoder, rows: pa.ListArray) -> pa.Array:
    out: list[str] = []
    for at in range(0, len(rows), 16):  # the working arrays of a few documents at a time
        part = rows.slice(at, 16).fill_null([])
        bounds = np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))])
        ids = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        out += decoder.decode(ids.astype(np.int64), bounds.astype(np.int64))
    return pa.array(out, pa.string())


def tokenize(df: DataFrame, text: str, path: str) -> DataFrame:
    """``record`` (all columns), ``ids`` and ``decoded`` of each row's text; one narrow pass, no shuffle."""
    bpe = Bpe(df.sparkSession, path)
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(record.alias("record"), bpe.both(F.col(f"`{text}`")).alias("r")).select("record", "r.*")
