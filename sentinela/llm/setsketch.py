"""Near-duplicate documents by SetSketch registers.

A register holds how often the base must be divided out of the smallest of the
exponentially distributed hashes of a set: floor(1 - log_b(min)), truncated to
16 bits. Registers of a union are the larger of both (mergeable), and with a
base near 1 two sets share a register with a chance near their Jaccard
similarity (locality-sensitive). Bands of registers make candidate pairs, a
maximum-likelihood estimate over all registers drops the unlikely ones, and the
rest is verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.llm import _words as words
from sentinela.llm._base import for_python, stash
from sentinela.llm.components import components
from sentinela.plans.hints import bounded_broadcast

WIDTH = 5
#: A pair at the least similarity shares no band with a chance of (1 - 0.75^3)^30, below 1 in 10 million.
BANDS, ROWS = 30, 3
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Estimates spread by at most 0.046 around a similarity of 0.75; pairs this far below it are not verified.
MARGIN = 0.23
#: Members of a group, and entries of their differences, in a block of which two meet in one task; columns of the
#: differences compared at a time.
BLOCK, ENTRIES, COLUMNS = 128, 200_000, 1 << 12
#: Rows of a cell compared with all others at a time.
STRIP = 256
#: Hubs that a band bucket gets one after the other, each for the members unlike the ones before.
HUBS = 3
#: Members of a bucket, and their shingles, in a block of the search of what its hubs leave, and equal registers of a
#: pair that it looks for: at the least similarity of 0.75 fewer occur with a chance below 1 in 10 million.
REST, SHINGLES, EQUAL = 2048, 2_000_000, 40

_random = np.random.Generator(np.random.PCG64(314159))
_FACTOR = _random.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _random.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)


def registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS) of the non-empty sets shingles[bounds[i]:bounds[i + 1]]."""
    least = np.empty((len(bounds) - 1, REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(words.mixed_light(shingles, _FACTOR[i], _SHIFT[i]), bounds[:-1])
    uniform = ((least >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Band number and its three registers in one long, sets x BANDS."""
    r = regs.astype(np.int64).reshape(len(regs), BANDS, ROWS)
    return (np.arange(BANDS) << 48) | (r[:, :, 0] << 32) | (r[:, :, 1] << 16) | r[:, :, 2]


def unpack(keys: np.ndarray) -> np.ndarray:
    """The registers in band keys (sets x BANDS)."""
    return np.stack([(keys >> s) & 0xFFFF for s in (32, 16, 0)], axis=2).reshape(len(keys), REGISTERS)


def likely(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, steps: int = 50) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets from all registers and the set sizes, on a grid."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, steps + 1)[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = (above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny))
             + equal * np.log(np.maximum(1 - more - less, tiny)))
    return j[np.arange(len(j)), score.argmax(axis=1)]


def shingle_set(text: str) -> set:
    """The shingles themselves, as a verification needs them."""
    w = text.encode().lower().split()
    return {b" ".join(w[i:i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set()


def sketch(docs: DataFrame) -> DataFrame:
    """Adds c1, c2 (hashes of the word sequence, null without words), n (shingles) and keys (band keys) to (id, version)
    of rows (id, version, text)."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for begin, end in words.chunks(texts):
                hashes, bounds = words.word_hashes(texts[begin:end])
                shingles, firsts = words.shingle_hashes(hashes, bounds, WIDTH)
                full = np.diff(firsts) > 0
                n = np.array([len(np.unique(shingles[a:b])) for a, b in zip(firsts[:-1], firsts[1:])], np.int64)
                lists = np.zeros((len(full), BANDS), np.int64)
                if full.any():
                    lists[full] = band_keys(registers(shingles, np.append(firsts[:-1][full], firsts[-1])))
                rows = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                c1, c2 = (pa.array(words.sequence_hashes(hashes, bounds, s).view(np.int64), mask=~full) for s in (1, 2))
                keys = pa.ListArray.from_arrays(pa.array(rows), pa.array(lists[full].ravel()))
                own = [batch.column(c).slice(begin, end - begin) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, c1, c2, pa.array(n), keys],
                                                 ["id", "version", "c1", "c2", "n", "keys"])

    return docs.mapInArrow(run, "id long, version long, c1 long, c2 long, n long, keys array<long>")


def _estimated(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (hub, node) whose estimate from the registers is at least ``least``."""
    def side(name: str, size: str, keys: str) -> DataFrame:
        return sketches.select(F.col("node").alias(name), F.col("n").alias(size), F.col("keys").alias(keys))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (unpack(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)) for c in (2, 3))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (4, 5))
            keep = pa.array(likely(a, na, b, nb) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["hub", "node"])

    return (pairs.join(side("hub", "n1", "k1"), "hub").join(side("node", "n2", "k2"), "node")
            .select("hub", "node", "k1", "k2", "n1", "n2").mapInArrow(run, "hub long, node long"))


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (hub, node) with the sizes of both full shingle sets, of their intersection, and what they differ in.

    ``differ`` holds a hash of each shingle that only one of the two has.
    """
    def run(batches):
        known: dict = {}

        def shingles(node: int, body: str) -> set:
            if node not in known:
                if len(known) >= 8:
                    known.clear()
                known[node] = shingle_set(body)
            return known[node]

        for batch in batches:
            rows, held = [], 0
            for hub, node, text_a, text_b in zip(*batch.columns):
                hub, node = hub.as_py(), node.as_py()
                a, b = shingles(hub, text_a.as_py()), shingles(node, text_b.as_py())
                differ = np.fromiter((_short(x) for x in a ^ b), np.int64)
                rows.append((hub, node, len(a), len(b), len(a & b), differ))
                held += len(differ)
                if held > ENTRIES:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

    def side(name: str, body: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("text").alias(body))

    return (pairs.join(side("hub", "t1"), "hub").join(side("node", "t2"), "node").select("hub", "node", "t1", "t2")
            .mapInArrow(run, "hub long, node long, n_hub long, n_node long, both long, differ array<long>"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, differ = zip(*rows)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in differ])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.ListArray.from_arrays(
        pa.array(bounds), pa.array(np.concatenate(differ)))], ["hub", "node", "n_hub", "n_node", "both", "differ"])


def _short(shingle: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(shingle, digest_size=8).digest(), "little", signed=True)


def reaches(both: Column, n_a: Column, n_b: Column, least: tuple[int, int]) -> Column:
    return both * least[1] >= (n_a + n_b - both) * least[0]


def _blocked(tagged: DataFrame, group: str, size: int, weight: Column, most: int) -> DataFrame:
    """The rows of ``tagged`` (``group``, node, label, ...) with main and the cells x, y in which they meet.

    Groups with one label are left out. A cell holds a block of the group's main
    label (x from 0) or of the other members (x below 0) and block y of the
    others, so members under one label never meet for each other's sake. Blocks
    hold about ``size`` rows and ``most`` of ``weight``.
    """
    per_label = tagged.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("e"))
    blocks = lambda n, e: F.ceil(F.greatest(n / size, e / most))
    groups = stash(per_label.groupBy(group).agg(
        F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label", "e")).alias("m"), F.sum("n").alias("n"),
        F.sum("e").alias("e")).where("labels > 1").select(
            group, F.col("m.label").alias("top"), blocks(F.col("m.n"), F.col("m.e")).alias("xs"),
            blocks(F.col("n") - F.col("m.n"), F.col("e") - F.col("m.e")).alias("ys")), "open")
    rows = tagged.join(bounded_broadcast(groups), group).withColumn("main", F.col("label") == F.col("top"))
    spread = lambda n: F.pmod(F.xxhash64("node"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mine = spread(F.col("ys"))
    main = F.transform(upto(F.col("ys")), lambda y: cell(spread(F.col("xs")), y))
    other = F.concat(F.transform(upto(F.col("xs")), lambda x: cell(x, mine)),
                     F.transform(upto(mine + 1), lambda x: cell(-1 - x, mine)),
                     F.transform(F.filter(upto(F.col("ys")), lambda y: y > mine), lambda y: cell(-1 - mine, y)))
    return (rows.select(*tagged.columns, "main", F.explode(F.when(F.col("main"), main).otherwise(other)).alias("c"))
            .select(*tagged.columns, "main", "c.x", "c.y"))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a cell are compared with which."""
    main = table.column("main").to_numpy()
    return (np.flatnonzero(main), np.flatnonzero(~main)) if table.column("x")[0].as_py() >= 0 else (np.arange(len(main)),) * 2


def _across(compared: DataFrame, labels: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (hub, node) of members of one hub's group, in different components, that are similar enough.

    What two members have in common follows from where they differ from the
    hub: it is the hub's size, less what each lacks of it, and plus the
    differences that they share. So no text is needed, and a task that holds a
    block of members under the group's main label and a block of the others
    (or two blocks of others) gives only links that join components (a spanning
    forest of its cell). Members under one label are never compared.
    """
    tagged = stash(compared.select("hub", "node", "n_hub", "n_node", "both", "differ")
                   .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "tagged")
    cells = _blocked(tagged, "hub", BLOCK, F.size("differ"), ENTRIES)

    def run(table: pa.Table) -> pa.Table:
        node, label, n_hub, n, both = (table.column(c).to_numpy() for c in ("node", "label", "n_hub", "n_node", "both"))
        left, right = _sides(table)
        differ = table.column("differ").combine_chunks()
        lengths = differ.value_lengths().to_numpy()
        shared = _shared(differ.flatten().to_numpy(), np.repeat(np.arange(len(node)), lengths), left, right, len(node))
        lacks = n_hub - both
        common = n_hub[0] - lacks[left][:, None] - lacks[right][None, :] + shared
        total = n[left][:, None] + n[right][None, :] - common
        return _forest(common * least[1] >= total * least[0], node, label, left, right)

    return cells.groupBy("hub", "x", "y").applyInArrow(run, "hub long, node long").distinct()


def _forest(link: np.ndarray, node: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """Of the links (left x right) those that join two labels not joined yet: fewer than there are members."""
    root: dict = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i in np.flatnonzero(link.any(axis=1)):
        own = right[link[i]]
        others, first = np.unique(label[own], return_index=True)
        for other, at in zip(others.tolist(), first):
            x, y = find(int(label[left[i]])), find(other)
            if x != y:
                root[x] = y
                out.append(sorted((int(node[left[i]]), int(node[own[at]]))))
    return pa.table({"hub": pa.array([a for a, _ in out], pa.int64()), "node": pa.array([b for _, b in out], pa.int64())})


def _open(table: pa.Table) -> tuple[np.ndarray, ...]:
    """node, label, left, right, and which of left and right may be links that no hub's group held: under different
    labels, with enough equal registers, in the first bucket that they share."""
    node, label = (table.column(c).to_numpy() for c in ("node", "label"))
    left, right = _sides(table)
    may = label[left][:, None] != label[right][None, :]
    at: dict = {}
    for i, own in enumerate(table.column("hubs").to_pylist()):
        for h in own or ():
            at.setdefault(h, []).append(i)
    side = np.zeros((2, len(node)), np.int64)
    side[0, left], side[1, right] = np.arange(len(left)), np.arange(len(right))
    in_left, in_right = np.isin(np.arange(len(node)), left), np.isin(np.arange(len(node)), right)
    for group in map(np.array, at.values()):
        if len(group) > 1:
            may[np.ix_(side[0, group[in_left[group]]], side[1, group[in_right[group]]])] = False
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    regs, band = np.ascontiguousarray(unpack(keys).astype(np.uint16).T), table.column("key")[0].as_py() >> 48
    for i in range(0, len(left), STRIP):
        part = may[i:i + STRIP]
        if not part.any():
            continue
        equal = np.zeros(part.shape, np.uint8)
        for r in regs:
            equal += r[left[i:i + STRIP]][:, None] == r[right][None, :]
        part &= equal >= EQUAL
        for k in range(band):  # a pair counts in the first bucket that it shares
            part &= keys[left[i:i + STRIP], k][:, None] != keys[right, k][None, :]
    return node, label, left, right, may


def _left_over(left: DataFrame, members: DataFrame, labels: DataFrame, compared: DataFrame, sketches: DataFrame,
               texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (hub, node) that join components and that no hub's group held, as a spanning forest of each cell.

    ``left`` (key, node) are bucket members unlike their bucket's first hub; in
    the other buckets all members are in that hub's group. Members of these
    buckets under different labels meet in cells, first with their registers
    alone; members with a likely partner then meet again with the hashes of
    their full sets. A cell gives its members with a likely partner and then its
    links between labels, never its pairs.
    """
    tagged = stash(members.select("key", "node").join(left.select("key").distinct(), "key").join(labels, "node", "left")
                   .withColumn("label", F.coalesce("label", "node")).join(sketches.select("node", "n"), "node"), "unlike")
    pairs = compared.select("hub", "node")
    grouped = (pairs.union(pairs.select("hub", F.col("hub").alias("node")).distinct())
               .groupBy("node").agg(F.collect_list("hub").alias("hubs")))
    facts = stash(tagged.select("node").distinct().join(grouped, "node", "left").join(sketches.select("node", "keys"), "node"), "facts")
    cells = _blocked(tagged, "key", REST, F.col("n"), SHINGLES)

    def likely_members(table: pa.Table) -> pa.Table:
        node, _, a, b, may = _open(table)
        some = np.union1d(a[may.any(axis=1)], b[may.any(axis=0)]).astype(np.int64)
        return table.select(["key", "x", "y", "node", "label", "main"]).take(pa.array(some))

    columns = "key long, x long, y long, node long, label long, main boolean"
    some = stash(cells.join(facts, "node").select("key", "x", "y", "node", "label", "main", "hubs", "keys")
                 .groupBy("key", "x", "y").applyInArrow(likely_members, columns), "likely")
    sets = stash(_sets(texts.join(some.select("node").distinct(), "node", "left_semi")), "sets")

    def links(table: pa.Table) -> pa.Table:
        node, label, a, b, may = _open(table)
        held = table.column("shingles").combine_chunks()
        n = held.value_lengths().to_numpy().astype(np.int64)
        common = _shared(held.flatten().to_numpy(), np.repeat(np.arange(len(node)), n), a, b, len(node))
        total = n[a][:, None] + n[b][None, :] - common
        return _forest(may & (common * least[1] >= total * least[0]), node, label, a, b)

    return (some.join(facts, "node").join(sets, "node").groupBy("key", "x", "y")
            .applyInArrow(links, "hub long, node long").distinct())


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): the hashes of the full shingle set of each text."""
    def run(batches):
        for batch in batches:
            bodies = batch.column(1).cast(pa.binary()).to_pylist()
            for begin, end in words.chunks(bodies):
                hashes, bounds = words.word_hashes(bodies[begin:end])
                shingles, firsts = words.shingle_hashes(hashes, bounds, WIDTH)
                sets = [np.unique(shingles[a:b]).view(np.int64) for a, b in zip(firsts[:-1], firsts[1:])]
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(
                    pa.array(at), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _shared(values: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each pair of left and right owners how many of their values are the same."""
    side = np.zeros((2, n), bool)
    side[0, left] = side[1, right] = True
    found, column = np.unique(values, return_inverse=True)
    held = [np.bincount(column[s[owner]], minlength=len(found)) for s in side]
    useful = np.flatnonzero((held[0] > 0) & (held[1] > 0))
    place = np.full(len(found), -1)
    place[useful] = np.arange(len(useful))
    column = place[column]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(useful), COLUMNS):
        part = (column >= first) & (column < first + COLUMNS)
        grid = np.zeros((n, min(COLUMNS, len(useful) - first)), np.float32)
        grid[owner[part], column[part] - first] = 1
        out += grid[left] @ grid[right].T
    return out.astype(np.int64)


def _joined(compared: DataFrame, texts: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) in the groups of ``compared`` that join what the groups hold, and the components that they make."""
    linked = reaches(F.col("both"), F.col("n_hub"), F.col("n_node"), least)
    ends = [F.col("hub").alias("a"), F.col("node").alias("b")]
    links = compared.where(linked).select(ends)
    labels = components(links)
    across = _compared(stash(_across(compared, labels, least), "across"), texts)
    more = stash(across.where(linked).select(ends), "links")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    return links, labels


def near_duplicates(df: DataFrame, key: str, text: str, least: tuple[int, int] = (75, 100)) -> DataFrame:
    """One row per row of ``df``: id, version (a hash of the text), n_shingles, component_id, kept.

    Texts with 100 * intersection >= 75 * union (``least``) of their distinct
    five-word shingles are linked; component_id is the smallest key reachable
    over links, kept marks that document. A text of fewer words is one shingle;
    without words, empty or null, it has none and is linked with nothing. Rows
    without a key link others but are only kept where no row of their group has
    a key (component_id is null then). Rows that repeat a key are documents of
    their own. An empty table gives no rows.

    Equal word sequences become one node first, so copies cost a pre-aggregated
    count. In each band bucket every node is paired with one hub, the node with
    the fullest buckets over all bands, which in a group of copies is the text
    they come from; nodes that the estimate finds unlike it get a hub of their
    own, up to ``HUBS`` times. Hub pairs that the estimate leaves are compared
    on their full sets and the links joined into components. A hub's group that
    still holds several components is then searched across them, in blocks, so
    no link between different components is left out, and pairs inside one are
    never listed. Last, members of a bucket that no group held together and
    that are still in different components meet in blocks: by registers, and
    those with a likely partner by the hashes of their full sets. So each pair
    of a bucket is in one component, was compared in a hub's group, is unlikely
    or is compared there. A block gives only links that join components, which
    are confirmed on the texts. Texts move only for nodes in a candidate pair;
    very long ones weigh more, so fewer of them share a block.
    """
    for_python(df.sparkSession)
    body = F.col(f"`{text}`")
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("version"), body.alias("text"))
    rough = least[0] / least[1] - MARGIN
    sketched = stash(sketch(docs), "sketches")
    classes = stash(sketched.where("c1 is not null").groupBy("c1", "c2")
                    .agg(F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "version", "n", "keys")).alias("m"))
                    .select("c1", "c2", "m.id", "m.version", "m.n", "m.keys", F.monotonically_increasing_id().alias("node")), "classes")
    bands = classes.select("node", F.explode("keys").alias("key"))
    full = stash(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "full")
    members = stash(bands.join(full, "key"), "members")
    scores = stash(members.groupBy("node").agg(F.sum("size").alias("score")), "scores")
    involved = stash(classes.drop("c1", "c2").join(scores.select("node"), "node"), "involved")
    named = involved.select("node", F.col("id").alias("own"), F.col("version").alias("own_version"))
    texts = stash(docs.join(named, F.col("id").eqNullSafe(F.col("own")) & (F.col("version") == F.col("own_version")))
                  .select("node", "text").dropDuplicates(["node"]), "texts")
    near, unlike, left = None, None, members.select("key", "node")
    for _ in range(HUBS):
        hubs = left.join(scores, "node").groupBy("key").agg(
            F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("m")).select("key", (-F.col("m.minus")).alias("hub"))
        paired = stash(left.join(stash(hubs, "hubs"), "key").where("node != hub"), "pairs")
        close = stash(_estimated(paired.select("hub", "node").distinct(), involved, rough), "near")
        near = close if near is None else near.union(close)
        left = stash(paired.join(close, ["hub", "node"], "left_anti").select("key", "node"), "left")
        unlike = left if unlike is None else unlike
        if left.isEmpty():
            break
    compared = stash(_compared(near.distinct(), texts), "compared")
    links, labels = _joined(compared, texts, least)
    more = stash(_left_over(unlike, members, labels, compared, involved, texts, least), "more")
    if not more.isEmpty():
        sure = _compared(more, texts).where(reaches(F.col("both"), F.col("n_hub"), F.col("n_node"), least))
        labels = components(links.union(stash(sure.select(F.col("hub").alias("a"), F.col("node").alias("b")), "links")))
    groups = stash(classes.select("node", "id").join(labels, "node", "left").select(
        "node", "id", F.coalesce("label", "node").alias("label")), "groups")
    roots = stash(groups.groupBy("label").agg(F.min("id").alias("root")), "roots")
    named = stash(groups.join(roots, "label").select("node", "root")
                  .join(classes.select("node", "c1", "c2"), "node"), "named")
    root = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("root"))
    return (sketched.join(named, ["c1", "c2"], "left")
            .select("id", "version", F.col("n").alias("n_shingles"), root.alias("component_id"),
                    F.coalesce(F.col("id") == root, root.isNull()).alias("kept")))


def drop_near_duplicates(df: DataFrame, key: str, text: str, least: tuple[int, int] = (75, 100)) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the document with the smallest key stays.

    Of rows that repeat key and text one stays. Rows without a key go if a row
    with a key is in their group.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    docs = df.select(F.col(f"`{key}`").alias("own"), F.xxhash64(F.col(f"`{text}`")).alias("own_version"),
                     record.alias("record"))
    found = stash(near_duplicates(df, key, text, least), "groups")
    gone = found.where("not kept").select("id", "version").distinct()
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_version") == F.col("version"))
    rows = docs.join(bounded_broadcast(gone), same, "left_anti")
    repeats = found.where("kept and id is not null").groupBy("id", "version").agg(F.count(F.lit(1)).alias("n"))
    if not repeats.where("n > 1").isEmpty():
        rows = (rows.where("own is not null").dropDuplicates(["own", "own_version"])
                .unionByName(rows.where("own is null")))
    return rows.select("record.*")
