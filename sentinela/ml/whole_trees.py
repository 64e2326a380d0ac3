"""Trees grown whole in one place, from the bins of all their rows.

A tree is a stack of blocks of nodes. A block with more than ``BLOCK`` rows is
cut by histograms until its nodes can be dealt to blocks of that size; these
are finished level by level while their rows lie in the processor's cache.

Trees that differ only in the least draws of a leaf are the same down to the
nodes where the best cut leaves too few: they are grown as one, and part there.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np

BINS = 32
#: Rows of a block, rows summed at once, and rows a node from which a histogram has all bins.
BLOCK, AT_ONCE, DENSE = 1 << 18, 1 << 20, 40
#: Most draws of a row that are kept in one number, and most bits of class and draws that are looked up.
MOST, LOOKED_UP = (1 << 26) - 1, 14


def keep_freed_memory() -> None:
    """Arrays of a few hundred kilobytes are made and freed all the time: half of the time would go to getting their pages anew."""
    with contextlib.suppress(AttributeError, OSError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 28)   # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)   # M_TRIM_THRESHOLD


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix64)."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def child_keys(key: np.ndarray, side: int) -> np.ndarray:
    return mix(key * np.uint64(2) + np.uint64(1 + side))


def tried(key: np.ndarray, features: int, some: int) -> np.ndarray:
    """The features tried at each node: nodes x some."""
    with np.errstate(over="ignore"):
        h = mix(key[:, None] ^ mix(np.arange(features, dtype=np.uint64))[None, :])
    return h.argsort(axis=1, kind="stable")[:, :some]


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a, b], axis=1).reshape(2 * len(a), *a.shape[1:])


class Packed:
    """Bins of rows, five bits each in one number."""

    FEATURES = 12

    def __init__(self, code: np.ndarray):
        self.code = code

    @classmethod
    def of(cls, bins: np.ndarray):
        code = np.zeros(len(bins), np.int64)
        for f in range(bins.shape[1]):
            code |= bins[:, f].astype(np.int64) << (5 * f)
        return cls(code)

    def __len__(self) -> int:
        return len(self.code)

    def __getitem__(self, at):
        return Packed(self.code[at])

    def bin(self, feature: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The bin of each row in the feature of its node."""
        out = self.code >> (5 * feature)[node]
        out &= 31
        return out

    def joined(self, other):
        return Packed(np.concatenate([self.code, other.code]))


class Flat:
    """Bins of rows with more features than a number holds."""

    def __init__(self, bins: np.ndarray):
        self.bins = bins

    def __len__(self) -> int:
        return len(self.bins)

    def __getitem__(self, at):
        return Flat(self.bins[at])

    def bin(self, feature: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.bins[np.arange(len(self.bins)), feature[node]].astype(np.int64)

    def joined(self, other):
        return Flat(np.concatenate([self.bins, other.bins]))


def rows_of(bins: np.ndarray):
    return Packed.of(bins) if bins.shape[1] <= Packed.FEATURES else Flat(np.ascontiguousarray(bins))


@dataclass
class Rules:
    """What the trees have in common; ``least``: least draws in a leaf, ascending, one for each of the trees grown as one."""

    least: np.ndarray
    classes: int
    features: int
    some: int
    deepest: int
    weights: np.ndarray | None = None    # of the classes
    bits: int = 8                        # of the draws of a row


@dataclass
class Block:
    """Nodes that are worked on together, the rows (bins, class and draws, node) of those that may be cut, and the ``held``
    rows, which only follow the cuts."""

    rows: Packed | Flat
    tag: np.ndarray          # class << bits | draws
    node: np.ndarray
    held: Packed | Flat
    number: np.ndarray       # of a held row
    place: np.ndarray        # node of a held row
    counts: np.ndarray       # draws of each class: nodes x classes
    can: np.ndarray          # whether a node may be cut
    key: np.ndarray
    depth: np.ndarray
    mask: np.ndarray         # which of the trees grown as one the node belongs to, a bit each
    own: np.ndarray          # number of the node in the tree


def lowest(mask: np.ndarray, least: np.ndarray) -> np.ndarray:
    return least[np.log2(mask & -mask).astype(np.int64)]


def may_cut(counts: np.ndarray, depth: np.ndarray, mask: np.ndarray, rules: Rules) -> np.ndarray:
    return (depth < rules.deepest) & ((counts > 0).sum(axis=1) > 1) & (counts.sum(axis=1) >= 2 * lowest(mask, rules.least))


def total(columns: Sequence[np.ndarray]) -> np.ndarray:
    out = columns[0].copy()
    for c in columns[1:]:
        out += c
    return out


def gini(left: Sequence[np.ndarray], whole: Sequence[np.ndarray], least: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """How much a cut lessens the Gini impurity, times the rows (-1: not allowed), and the draws to the left; by class."""
    drawn = a = total(left)
    n = total(whole)
    b = n - a
    allowed = np.minimum(a, b) >= least
    if weights is not None:
        left, whole = [x * v for x, v in zip(left, weights)], [x * v for x, v in zip(whole, weights)]
        a, n = total(left), total(whole)
        b = n - a
    over = lambda squares, rows: np.divide(squares, rows, out=squares, where=rows > 0)
    right = [t - x for x, t in zip(left, whole)]
    gain = over(total([x * x for x in left]), a)
    gain += over(total([x * x for x in right]), b)
    gain -= over(total([x * x for x in whole]), n)
    allowed &= gain > 1e-9
    gain[~allowed] = -1.0
    return gain, drawn


class Cuts:
    """The best cut of each node so far; ties go to the feature tried first and the lowest bin."""

    def __init__(self, nodes: int, classes: int):
        self.feature, self.cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        self.gain, self.left = np.zeros(nodes), np.zeros((nodes, classes))

    def offer(self, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, left: np.ndarray) -> None:
        at = np.flatnonzero(gain > self.gain)
        self.feature[at], self.cut[at], self.gain[at], self.left[at] = feature[at], cut[at], gain[at], left[:, at].T


def all_bins(rows, tag: np.ndarray, node: np.ndarray, chosen: np.ndarray, counts: np.ndarray, least: np.ndarray, rules: Rules) -> Cuts:
    """The best cut of each node among the features ``chosen`` (nodes x some), from histograms of all bins."""
    (k, some), classes = chosen.shape, rules.classes
    found, sums = Cuts(k, classes), np.zeros((some, classes, k, BINS))
    for first in range(0, len(node), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        mine, here, w = rows[part], node[part], (tag[part] & ((1 << rules.bits) - 1)).astype(float)
        base = ((tag[part] >> rules.bits) * k + here) * BINS
        for slot in range(some):
            at = mine.bin(chosen[:, slot], here)
            at += base
            sums[slot] += np.bincount(at, w, classes * k * BINS).reshape(classes, k, BINS)
    every, whole = np.arange(k), [counts[:, c, None] for c in range(classes)]
    for slot in range(some):
        left = sums[slot].cumsum(axis=2)
        gain, _ = gini(list(left), whole, least[:, None], rules.weights)
        at = gain.argmax(axis=1)
        found.offer(chosen[:, slot], at, gain[every, at], left[:, every, at])
    return found


def bins_met(rows, tag: np.ndarray, node: np.ndarray, chosen: np.ndarray, counts: np.ndarray, least: np.ndarray, rules: Rules) -> Cuts:
    """The same from sums over the bins that a node's rows have. Every node has rows."""
    (k, some), classes = chosen.shape, rules.classes
    found, drawn = Cuts(k, classes), int(counts.sum())
    low = rules.bits + (classes - 1).bit_length()
    bits = drawn.bit_length()
    each = min(classes, max(1, 63 // bits))    # as many classes as fit are added up in one number
    words = [range(c, min(c + each, classes)) for c in range(0, classes, each)]

    def packed(tag: np.ndarray) -> list[np.ndarray]:
        y, w = tag >> rules.bits, tag & ((1 << rules.bits) - 1)
        return [np.where((y >= c.start) & (y < c.stop), w << (bits * np.clip(y - c.start, 0, each - 1)), 0) for c in words]

    known = packed(np.arange(1 << low)) if low <= LOOKED_UP else None
    small = ((k << 5) << low) < 1 << 31
    base = ((node << 5) << low) | tag
    whole = np.ascontiguousarray(counts.T)
    for slot in range(some):
        s = rows.bin(chosen[:, slot], node)
        s <<= low
        s |= base
        s = np.sort(s.astype(np.int32) if small else s)
        place = s >> low
        ends = np.append(np.flatnonzero(place[1:] != place[:-1]), len(place) - 1)
        s &= (1 << low) - 1
        place = place[ends]
        of = place >> 5
        first = np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1)
        left = []
        for i, word in enumerate(words):
            sums = np.cumsum(known[i][s] if known else packed(s.astype(np.int64))[i])[ends]
            before = np.zeros(k, np.int64)
            before[1:] = sums[first[1:] - 1]
            sums -= before[of]
            left += [((sums >> (bits * j)) & ((1 << bits) - 1)).astype(float) for j in range(len(word))]
        gain, _ = gini(left, [c[of] for c in whole], least[of], rules.weights)
        top = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain == top[of])[::-1]
        at = np.zeros(k, np.int64)
        at[of[hit]] = hit
        found.offer(chosen[:, slot], (place[at] & 31).astype(np.int64), top, np.stack([c[at] for c in left]))
    return found


def step(b: Block, rules: Rules, seen, numbers) -> Block | None:
    """Cuts the nodes of a block; ``seen`` is told of them, ``numbers(n)`` gives the first of n new node numbers."""
    k, least = len(b.key), rules.least
    n, cuts = b.counts.sum(axis=1), Cuts(k, rules.classes)
    open_ = np.flatnonzero(b.can)
    if len(open_):
        node = b.node if len(open_) == k else (np.cumsum(b.can) - 1)[b.node]
        how = bins_met if len(node) < DENSE * len(open_) else all_bins
        found = how(b.rows, b.tag, node, tried(b.key[open_], rules.features, rules.some), b.counts[open_], lowest(b.mask[open_], least), rules)
        cuts.feature[open_], cuts.cut[open_], cuts.left[open_] = found.feature, found.cut, found.left
    cutting = cuts.feature >= 0
    fewer = cuts.left.sum(axis=1)
    fewer = np.minimum(fewer, n - fewer)
    keep, redo = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for v, most in enumerate(least):
        bit = cutting & ((b.mask >> v) & 1 > 0)
        keep |= (bit & (fewer >= most)).astype(np.int64) << v
        redo |= (bit & (fewer < most) & (n >= 2 * most)).astype(np.int64) << v
    done = np.flatnonzero(cutting)
    child = numbers(2 * len(done))
    left = np.zeros(k, np.int64)
    left[done] = child + 2 * np.arange(len(done))
    seen(b, cuts, left, keep, b.mask & ~keep & ~redo)
    if not len(done):
        return None
    again, of = np.flatnonzero(redo), lambda a: np.repeat(a[done], 2)
    counts = np.concatenate([pairs(cuts.left[done], b.counts[done] - cuts.left[done]), b.counts[again]])
    key = np.concatenate([pairs(child_keys(b.key[done], 0), child_keys(b.key[done], 1)), b.key[again]])
    depth, mask = np.concatenate([of(b.depth) + 1, b.depth[again]]), np.concatenate([of(keep), redo[again]])
    can = may_cut(counts, depth, mask, rules)
    rank = np.full(k, -2)
    rank[done] = 2 * np.arange(len(done))
    copy = np.zeros(k, np.int64)
    copy[again] = 2 * len(done) + np.arange(len(again))
    closed = np.append(~can, [True, True])    # the last two: not cut

    def below(rows, place, some, also):
        """New nodes of rows, and which rows go on: those in ``some`` of the new nodes, and once more in nodes ``also``."""
        new = rank[place]
        new += rows.bin(cuts.feature, place) > cuts.cut[place]
        on = np.flatnonzero(some[new])
        more = np.flatnonzero(also[place]) if len(again) else on[:0]
        return np.concatenate([on, more]) if len(more) else on, np.concatenate([new[on], copy[place[more]]]) if len(more) else new[on]

    cuts.feature = np.maximum(cuts.feature, 0)
    stay, node = below(b.rows, b.node, ~closed, redo > 0)
    hold, place = below(b.held, b.place, np.append(np.ones(len(can), bool), [False, False]), redo > 0)
    return Block(b.rows[stay], b.tag[stay], node, b.held[hold], b.number[hold], place, counts, can, key, depth, mask,
                 np.append(child + np.arange(2 * len(done)), b.own[again]))


def parted(b: Block) -> list[Block]:
    """The nodes of a block dealt to blocks of up to ``BLOCK`` rows (a larger node is one for itself)."""
    sizes = np.bincount(b.node, minlength=len(b.key)) + np.bincount(b.place, minlength=len(b.key))
    of, filled, count = np.zeros(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if filled and filled + n > BLOCK:
            filled, count = 0, count + 1
        of[i], filled = count, filled + n
    first = np.searchsorted(of, np.arange(count + 2))
    small = np.uint16 if count < 1 << 16 else np.int64
    ways = [np.argsort(of.astype(small)[x], kind="stable") for x in (b.node, b.place)]
    ends = [np.concatenate([[0], np.cumsum(np.bincount(of[x], minlength=count + 1))]) for x in (b.node, b.place)]
    out = []
    for i in range(count + 1):
        a, h = ways[0][ends[0][i]:ends[0][i + 1]], ways[1][ends[1][i]:ends[1][i + 1]]
        own = slice(first[i], first[i + 1])
        out.append(Block(b.rows[a], b.tag[a], b.node[a] - first[i], b.held[h], b.number[h], b.place[h] - first[i],
                         *(x[own] for x in (b.counts, b.can, b.key, b.depth, b.mask, b.own))))
    return out


def grow(rows, y: np.ndarray, draws: np.ndarray, held, key: np.uint64, rules: Rules, seen) -> int:
    """Grows a tree of the rows that it draws, and leads the ``held`` rows down; the number of its nodes (the root is 0).

    ``seen(block, cuts, left, keep, leaf)`` is told, for each node of a block, the cut, the number of the left child (the
    right one follows), and for which of the trees grown as one (bits) it is cut here or a leaf.
    """
    used = [1]

    def numbers(n: int) -> int:
        used[0] += n
        return used[0] - n

    y, draws = y.astype(np.int64), draws.astype(np.int64)
    if len(draws) and draws.max() > MOST:  # more than fits beside the class: the row counts several times
        times = -(-draws // MOST)
        at = np.repeat(np.arange(len(draws)), times)
        rows, y, draws = rows[at], y[at], np.minimum(MOST, draws[at] - MOST * (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)))
    rules = replace(rules, bits=int(draws.max(initial=1)).bit_length())
    none, whole = np.zeros(1, np.int64), np.full(1, (1 << len(rules.least)) - 1)
    counts = np.bincount(y, draws, rules.classes).reshape(1, -1)
    stack = [Block(rows, (y << rules.bits) | draws, np.zeros(len(rows), np.int64), held, np.arange(len(held)), np.zeros(len(held), np.int64),
                   counts, may_cut(counts, none, whole, rules), np.array([key], np.uint64), none, whole, none)]
    del rows, y, draws
    while stack:
        b = stack.pop()
        while b is not None:
            large, before = len(b.node) + len(b.place) > BLOCK, len(b.key)
            if large and before >= 64:
                stack += parted(b)
                break
            b = step(b, rules, seen, numbers)
            if large and b is not None and 1 < len(b.key) <= before:  # it hardly parts
                stack += parted(b)
                break
    return used[0]
