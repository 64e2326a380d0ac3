import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.corpus import SPACE, empty_documents, near_groups, odd_documents, odd_rows, sentence
from sentinela.llm import queries as Q

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


# connected components

@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    from sentinela.llm.components import components
    rnd = random.Random(kind)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(80)],
             "random": [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)], "none": []}[kind]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = defaultdict(lambda: 10**9)
    for x in root:
        least[find(x)] = min(least[find(x)], x)
    assert got == {x: least[find(x)] for x in root}


# near duplicates

def near_check(rows, expected):
    assert Counter((r[0], r[1], r[2]) for r in rows) == Counter(expected)
    for key, _, component, kept in rows:
        assert kept == (key == component if component is not None else True)


def test_op3(spark):
    rows = [tuple(r) for r in Q.op3_near_dedup(spark, SF).collect()]
    near_check(rows, near_groups([(r.doc_id, r.text) for r in documents(spark)]))


def test_near_duplicates_odd_rows(spark):
    from sentinela.llm.setsketch import drop_near_duplicates, near_duplicates
    docs = odd_documents(spark)
    rows = [(r.id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, "doc_id", "text").collect()]
    near_check(rows, near_groups(odd_rows()))
    assert near_duplicates(empty_documents(spark), "doc_id", "text").count() == 0
    left = drop_near_duplicates(docs, "doc_id", "text")
    assert left.columns == docs.columns
    keys = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert keys == sorted({r[0] for r in rows if r[3] and r[0] is not None})


def test_chains_and_large_groups(spark):
    """A text and many edits of it, edits of edits that only reach it over others, and a group below the threshold."""
    from sentinela.llm.setsketch import near_duplicates
    rnd = random.Random(7)

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        return " ".join(w)

    base, far, chain = sentence(rnd, 200), sentence(rnd, 200), [sentence(rnd, 150)]
    for _ in range(8):
        chain.append(edited(chain[-1], 4))
    texts = ([edited(base, rnd.randint(0, 9)) for _ in range(150)] + [base] + [edited(far, 9) for _ in range(30)]
             + chain + [sentence(rnd, 40) for _ in range(20)])
    rnd.shuffle(texts)
    data = list(enumerate(texts))
    rows = near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), "doc_id", "text")
    near_check([(r.id, r.n_shingles, r.component_id, r.kept) for r in rows.collect()], near_groups(data))


def test_passages_shared_by_many(spark):
    """Random subsets of common passages: the hub of a bucket is unlike most of its members, also like pairs of them."""
    from sentinela.llm.setsketch import near_duplicates
    rnd = random.Random(2)
    pool = [" ".join(f"w{p}x{rnd.randrange(10**6)}" for _ in range(30)) for p in range(40)]
    held = [rnd.sample(range(40), 20) for _ in range(600)]
    held += [rnd.sample(own, 18) + rnd.sample([p for p in range(40) if p not in own], 2) for own in held[:100]]
    rnd.shuffle(held)
    data = list(enumerate(" ".join(pool[p] for p in sorted(own)) for own in held))
    rows = near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), "doc_id", "text")
    near_check([(r.id, r.n_shingles, r.component_id, r.kept) for r in rows.collect()], near_groups(data))


def cell_table(rows):
    import pyarrow as pa
    names = ["key", "x", "y", "node", "label", "main", "hubs", "keys"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


@pytest.mark.parametrize("x", [-1, 0])
def test_cells_open_every_likely_pair(x):
    """In its first common bucket each likely pair under two labels that no hub held is open, and no other."""
    from sentinela.llm.setsketch import BANDS, EQUAL, REGISTERS, _open, band_keys
    rnd = np.random.default_rng(5)
    regs = rnd.integers(0, 2, (160, REGISTERS)).astype(np.uint16)
    regs[40:80] = np.where(rnd.random((40, REGISTERS)) < 0.25, 9, regs[:40])
    keys, node = band_keys(regs), np.arange(160)
    hubs, label, main = [[i % 3] if i < 30 else None for i in node], node // 2, node % 4 < 2
    wanted = {(a, b) for a in range(160) for b in range(a) if label[a] != label[b] and (regs[a] == regs[b]).sum() >= EQUAL
              and (keys[a] == keys[b]).any() and not (a < 30 and b < 30 and a % 3 == b % 3) and (x < 0 or main[a] != main[b])}
    found = []
    for key in np.unique(keys):
        own = np.flatnonzero((keys == key).any(axis=1))
        n, _, left, right, may = _open(cell_table([(key, x, 0, i, label[i], main[i], hubs[i], keys[i]) for i in own]))
        found += [(max(n[left[i]], n[right[j]]), min(n[left[i]], n[right[j]])) for i, j in zip(*np.nonzero(may))]
    assert len(wanted) > 1000 and set(found) == wanted and len(found) == len(wanted) * (2 if x < 0 else 1)
    assert BANDS * 3 == REGISTERS


def test_forest_joins_what_the_links_join():
    from sentinela.llm.setsketch import _forest
    rnd = np.random.default_rng(6)
    for n, share in ((40, 0.02), (40, 0.3), (1, 1.0)):
        node, label = rnd.permutation(1000)[:n], rnd.integers(0, max(1, n // 2), n)
        link = np.triu(rnd.random((n, n)) < share, 1)
        side = np.arange(n)
        out = _forest(link, node, label, side, side).to_pydict()
        of = dict(zip(node.tolist(), label.tolist()))

        def parts(edges):
            root = {x: x for x in of.values()}
            for a, b in edges:
                a, b = root[of[a]], root[of[b]]
                root = {k: (b if v == a else v) for k, v in root.items()}
            return {frozenset(k for k in root if root[k] == v) for v in root.values()}

        edges = [(int(node[i]), int(node[j])) for i, j in zip(*np.nonzero(link))]
        kept = list(zip(out["hub"], out["node"]))
        assert parts(edges) == parts(kept) and len(kept) < max(n, 1) and {tuple(sorted(e)) for e in kept} <= {tuple(sorted(e)) for e in edges}


def test_rows_of_a_large_group_grow_with_it(spark, monkeypatch):
    """Near copies of one short text, with links between some of them only: scratch rows follow the group's size."""
    from sentinela.llm import setsketch
    rnd = random.Random(9)
    base = sentence(rnd, 60).split()

    def copy():
        w = list(base)
        for _ in range(rnd.randint(1, 6)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        return " ".join(w)

    written, stash = {}, setsketch.stash
    monkeypatch.setattr(setsketch, "stash", lambda df, name: written.setdefault(name, []).append(stash(df, name)) or written[name][-1])
    counts = []
    for n in (1000, 3000):
        written.clear()
        data = [(i, copy()) for i in range(n)]
        rows = setsketch.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), "doc_id", "text").collect()
        if n == 1000:
            near_check([(r.id, r.n_shingles, r.component_id, r.kept) for r in rows], near_groups(data))
        counts.append({name: sum(df.count() for df in frames) for name, frames in written.items()})
    small, large = counts
    for name in set(large) - {"likely"}:  # pairs, members and links follow the group; three times the rows
        assert large[name] <= max(4 * small.get(name, 0), 300), (name, small.get(name), large[name])
    assert large["likely"] <= large["members"]  # at most once a member of a bucket, while it is one block


def test_sketches_merge_and_estimate():
    from sentinela.llm.setsketch import band_keys, likely, merge, registers, unpack
    from sentinela.llm._words import mixed
    x = mixed(np.arange(1, 4001, dtype=np.uint64))
    a, b, u = (registers(s, np.array([0, len(s)])) for s in (x[:3000], x[1000:], x))
    assert (merge(a, b) == u).all() and (unpack(band_keys(a)) == a).all()
    estimates = []
    for k in range(40):
        y = mixed(np.arange(10**6 * k, 10**6 * k + 4000, dtype=np.uint64))
        a, b = (registers(s, np.array([0, len(s)])) for s in (y[:3400], y[600:]))
        estimates.append(likely(a, np.array([3400.0]), b, np.array([3400.0]))[0])
    assert abs(np.mean(estimates) - 0.7) < 0.03 and np.std(estimates) < 0.1


# mixing

def mix_check(rows, sizes):
    """rows: (key, size, source, source_size, target, repeats)."""
    total, by = sum(sizes.values()), defaultdict(list)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, target, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, total
    while True:
        open_ = [s for s in names if s not in target]
        over = [s for s in open_ if free * weight[s] / sum(weight[x] for x in open_) >= 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free -= 3 * sizes[s]
    target |= {s: free * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for key, size, source, source_size, aim, repeats in rows:
        by[source].append((size, repeats))
        assert source_size == sizes[source] and aim == pytest.approx(target[source]) and 0 <= repeats <= 3
    for s, own in by.items():
        taken = sum(n * k for n, k in own)
        assert abs(taken - target[s]) <= max(n for n, _ in own) / 2 + 1e-6
        assert max(k for _, k in own) - min(k for _, k in own) <= 1


def test_op4(spark):
    docs = {r.doc_id: r for r in documents(spark)}
    sizes = Counter()
    for r in docs.values():
        sizes[r.source] += len(SPACE.findall(r.text))
    rows = Q.op4_mixing(spark, SF).collect()
    again = Q.op4_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(docs)
    mix_check([(r.doc_id, r.size, docs[r.doc_id].source, r.source_size, r.target, r.taken // max(r.size, 1)) for r in rows], sizes)


def test_mixing_odd_rows(spark):
    from sentinela.llm.mixing import mix, repeat_rows
    sizes = Counter()
    for r in odd_rows():
        sizes[r[3]] += len(SPACE.findall(r[1] or ""))
    docs = odd_documents(spark)
    mixed = mix(docs, "doc_id", "source", "text")
    rows = mixed.collect()
    assert len(rows) == len(odd_rows())
    mix_check([(r.record.doc_id, r.size, r.source, r.source_size, r.target, r.repeats) for r in rows], sizes)
    out = repeat_rows(mixed)
    assert out.columns == docs.columns and out.count() == sum(r.repeats for r in rows)
    assert mix(empty_documents(spark), "doc_id", "source", "text").count() == 0
    blank = mix(docs.where("text is null"), "doc_id", "source", "text").collect()
    assert all(r.target == 0 and r.repeats == 0 for r in blank)


# sharding

def test_op8(spark):
    import zlib
    docs = {r.doc_id: (r.text or "").encode() for r in documents(spark)}
    rows = Q.op8_sharding(spark, SF).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.size == len(docs[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id])
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.grown_shard for r in rows}) == 17
    again = Q.op8_sharding(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_op8_shuffles_whole_documents(spark, monkeypatch):
    from sentinela.llm import sharding
    given, shuffle = [], sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, *a, **k: given.append(df.columns) or shuffle(df, *a, **k))
    Q.op8_sharding(spark, SF)
    assert given == [spark.read.parquet(f"{SF}/documents.parquet").columns]


def test_sharding_odd_rows(spark, tmp_path):
    from sentinela.llm.sharding import shard_of, shuffle_into_shards, write_shards
    docs = odd_documents(spark)
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    out = shuffle_into_shards(docs, "doc_id", 4, weight, bucket_bytes=2000)
    rows = out.collect()
    assert Counter(tuple(r.record) for r in rows) == Counter(odd_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    own = {r.doc_id: r.s for r in docs.select("doc_id", shard_of(F.col("doc_id"), 4, 1).alias("s")).collect()}
    assert all(own[r.record.doc_id] == r.shard for r in rows)
    assert shuffle_into_shards(empty_documents(spark), "doc_id", 4, weight).count() == 0
    write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows) and {"_shard", "_slot"} < set(back.columns)


def test_shards_are_shuffled(spark):
    """Neighbours by key end up anywhere: the order in a shard is not the order of keys."""
    from sentinela.llm.sharding import shuffle_into_shards
    rows = shuffle_into_shards(spark.range(4000).withColumnRenamed("id", "k"), "k", 2, F.lit(100)).collect()
    for shard in (0, 1):
        order = [r.record.k for r in sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)]
        assert 1800 < len(order) < 2200
        rising = sum(a < b for a, b in zip(order, order[1:])) / len(order)
        assert 0.45 < rising < 0.55 and abs(np.corrcoef(range(len(order)), order)[0, 1]) < 0.1


# top-k

def test_top_k_odd_vectors(spark):
    from sentinela.llm.topk import quantised, top_k
    rnd = random.Random(11)
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(40)]) for i in range(300)]
    vectors += [(300 + i, list(vectors[5][1])) for i in range(40)]                     # ties
    vectors += [(400, None), (420, [1.0, None] + [0.0] * 38), (440, [float("nan")] * 40), (460, [float("inf")] + [0.0] * 39),
                (480, []), (500, [2.0, -3.0]), (520, [1e12, -1e12] + [0.5] * 38), (521, [-1e12] * 40), (None, [1.0] * 40)]
    vectors += [vectors[20], (40, [3.0] * 40), (40, [-2.0] * 40), (41, vectors[40][1]), (60, vectors[40][1]), (60, vectors[41][1])]  # keys repeated
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string").repartition(3)
    got = Counter(tuple(r) for r in top_k(df, "vec_id", quantised(F.col("embedding")), F.pmod("vec_id", F.lit(20)) == 0, 7).collect())
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    limit, want = lambda s: max(-2**63, min(2**63 - 1, s)), Counter()
    for n, (q, own) in enumerate(fine):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(fine) if m != n)[:7]
            want.update((q, k, i, limit(-s)) for k, (s, i) in enumerate(scores, 1))
    assert got == want
    none = top_k(df.where("false"), "vec_id", quantised(F.col("embedding")), F.pmod("vec_id", F.lit(20)) == 0)
    assert none.count() == 0


def test_search_prunes_exactly():
    from sentinela.llm.topk import Search
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-200, 200, (64, 12))
    data = np.concatenate([centres[:, [k]] + rnd.integers(-9, 9, (64, 100)) for k in range(12)], axis=1).astype(float)
    ids = np.arange(data.shape[1])
    pairs = np.stack([ids, ids + 7])  # ids and row numbers
    found = Search(pairs[:, :40], data[:, :40], 20)
    for a in range(0, len(ids), 300):
        found.add(pairs[:, a:a + 300], data[:, a:a + 300])
    rows = found.rows()
    scores = (data[:, :40].T @ data).astype(int)
    for q in range(40):
        best = sorted((-scores[q, i], i) for i in ids if i != q)[:20]
        own = rows[rows.query_id == q]
        assert list(zip(-own.score, own.vec_id)) == best
