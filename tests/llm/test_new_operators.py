"""Toxicity, centroid clustering and the Merkle manifest."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.corpus import empty_documents, odd_documents, odd_rows
from sentinela.llm import queries as Q

SF, SF001 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# toxicity

def test_op11(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in Q.op11_toxicity(spark, SF001).collect()}
    assert set(rows) == set(docs)
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in rows.values() if r.held_out and r.doc_id in toxic]
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    clean = [r.predicted for r in held if not toxic[r.doc_id]]
    assert sum(caught) >= 0.75 * len(caught) > 10 and sum(clean) <= 0.03 * len(clean)


def test_isotonic_is_the_least_squares_fit():
    from sentinela.llm.toxicity import isotonic
    draw = np.random.Generator(np.random.PCG64(2))
    x = np.round(draw.random(200), 2)
    y = (draw.random(200) < x ** 2).astype(float)
    points, chances = isotonic(x, y)
    at = np.unique(x)
    mean, n = np.array([y[x == v].mean() for v in at]), np.array([(x == v).sum() for v in at])
    run = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[0], np.cumsum(mean * n)])
    # min-max formula of the monotone least-squares fit
    fit = [max(min((total[b] - total[a]) / (run[b] - run[a]) for b in range(i + 1, len(run))) for a in range(i + 1)) for i in range(len(at))]
    assert np.interp(at, points, chances) == pytest.approx(fit)
    assert (np.diff(chances) >= -1e-12).all()


def test_trees_find_the_best_first_cut_and_lower_the_loss():
    from sentinela.llm import toxicity as X
    draw = np.random.Generator(np.random.PCG64(3))
    x = draw.integers(0, 12, (400, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (draw.random(400) < 0.1)).astype(float)
    trees = X.Trees(x, y)
    share = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - share, np.full(len(y), share * (1 - share))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + X.RIDGE)
    best = max(((value(x[:, f] <= c) + value(x[:, f] > c), f, c) for f in range(3) for c in range(11)))
    feature, cut, _ = trees.trees[0]
    assert feature[0] == best[1] == 1 and trees.edges[1][cut[0]] == best[2]
    loss = []
    for n in range(0, X.ROUNDS + 1, 10):
        part = X.Trees.__new__(X.Trees)
        part.edges, part.start, part.trees = trees.edges, trees.start, trees.trees[:n]
        p = 1 / (1 + np.exp(-part.margins(x)))
        loss.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    assert all(a > b for a, b in zip(loss, loss[1:]))


def test_features_by_hand():
    from sentinela.llm import toxicity as X
    f = X.Features({"idiot$": 3.0, "scum": 1.5})
    of = lambda t: dict(zip(X.FEATURES, f.of(t)))
    assert not f.of(None).any() and not f.of("").any() and not f.of(" \n").any()
    a = of("You are an IDIOT! scummy one")
    assert a["hit_density"] == pytest.approx(2 / 6) and a["weight_density"] == pytest.approx(4.5 / 6)
    assert a["largest"] == 3 and a["near_share"] == 1 and a["second"] == pytest.approx(1 / 6) and a["densest"] == 2
    assert a["capital_words"] == pytest.approx(1 / 6) and a["exclamations"] == pytest.approx(1 / 6) and a["hidden_density"] == 0
    for hidden in ("1d10t", "i.d.i.o.t", "idiiiiot", "i d i o t", "(1D10T)"):
        assert of(f"what an {hidden}")["hidden_density"] > 0, hidden
    assert of("plain 1984 words")["hidden_density"] == 0
    far = of("you " + "word " * 10 + "idiot")
    assert far["near_share"] == 0 and far["hits"] == pytest.approx(math.log(2))
    long = "word " * 200_000 + "idiot " * 3  # several blocks
    assert of(long)["densest"] == 3 and of(long)["words"] == pytest.approx(math.log1p(200_003))


def test_toxicity_odd_rows(spark):
    from sentinela.llm.toxicity import fit, score
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(30)] + [(3, 1, "x"), (None, 1, "x"), (5, None, "x"), (6, 7, "x")],
                                   "doc_id long, toxic int, text string")
    model = fit(docs, labels, "doc_id", "text", "toxic")
    rows = score(docs, "text", model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.record.text, r.score) == r.score
    assert by[None] == by[""]
    none = fit(empty_documents(spark), labels, "doc_id", "text", "toxic")
    assert {r.score for r in score(docs, "text", none).collect()} == {0.0}
    assert {r.score for r in score(docs, "text", fit(docs, labels.where("false"), "doc_id", "text", "toxic")).collect()} == {0.0}
    assert score(empty_documents(spark), "text", model).count() == 0
    one = fit(docs, labels.where("toxic = 1"), "doc_id", "text", "toxic")
    assert {r.score for r in score(docs, "text", one).collect()} == {1.0}


def test_toxicity_of_a_planted_lexicon(spark):
    from sentinela.llm.toxicity import fit, score
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(900):
        body = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        toxic = i % 6 == 0
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            body.insert(rnd.randrange(len(body)), rnd.choice(["zonker", "zonkerish", "quibnit"]))
        rows.append((i, " ".join(body), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = F.col("doc_id") < 600
    found = score(df.where(~known), "text", fit(df.where(known), df.where(known), "doc_id", "text", "toxic")).collect()
    assert sum((r.score >= 0.7) != bool(r.record.toxic) for r in found) <= 0.02 * len(found)


# centroid clustering

def plain_k_means(rows, size, k, rounds, scale, seed):
    """Rows (key, vector) by comparing every vector with every centroid, in whole numbers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        for j, own in by.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    last = (1 << 63) - 1
    ends = [(i, *near(v)) for i, v in kept]
    sums = {}
    for _, d, j in ends:
        sums[j] = sums.get(j, 0) + min(d, last)
    return [(i, j, min(d, last), min(sums[j], last), min(sum(sums.values()), last), [str(x) for x in centroids[j]]) for i, d, j in ends]


def test_clusters_equal_brute_force(spark):
    from sentinela.llm.centroids import cluster
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(5)
    got = sorted(tuple(r) for r in cluster(df, "vec_id", "embedding", 64, 8, 10, 1024.0, "3").collect())
    assert got == sorted(plain_k_means([(r.vec_id, r.embedding) for r in df.collect()], 64, 8, 10, 1024, "3"))
    few = Q.op12_centroids(spark, SF).collect()
    by = {r[0]: r for r in got}
    assert len(few) == len(got)
    for r in few:
        want = by[r.vec_id]
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia) == want[1:5]
        assert r.centroid_sha256 == hashlib.sha256(",".join(want[5]).encode()).hexdigest()


def test_clusters_odd_vectors(spark):
    from sentinela.llm.centroids import cluster
    nan, inf = float("nan"), float("inf")
    usual = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [3.0, -1.0]), (None, [1.0, 1.0]), (5, [nan, 1.0]), (5, [inf, 1.0]),
             (6, [None, 1.0]), (7, None), (8, [1.0]), (8, []), (8, [1.0, 2.0, 3.0]), (9, [3.0, -1.0]), (10, [-0.0001, 0.0])]
    large = usual + [(4, [1e30, -1e30]), (11, [2e9, 0.0]), (12, [-1e300, 1e299])]
    for rows in (usual, large, usual[4:11], []):
        df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, key string, cluster int")
        for k in (3, 20):
            got = [tuple(r) for r in cluster(df, "vec_id", "embedding", 2, k, 4, 1024.0, "3").collect()]
            assert sorted(got, key=str) == sorted(plain_k_means(rows, 2, k, 4, 1024, "3"), key=str)


def test_threshold_walk_stops_early_and_keeps_ties():
    from sentinela.llm.centroids import Lists
    grid = [[100 * i, 100 * i, 0] for i in range(30)] + [[0, 0, 2]]
    lists = Lists(grid)
    x = np.array([[3, 1, 1], [1004, 1009, 0], [0, 0, 1], [2950, 2950, -4]])
    number, distance, took = lists.nearest(x)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(grid)) for v in x.tolist()]
    assert [(int(d), int(j)) for d, j in zip(distance, number)] == want
    assert want[2][1] == 0 and (took[[0, 2]] < len(grid)).all()


# Merkle manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def written(value):
    if value is None:
        return b"-"
    body = str(value).encode()
    return str(len(body)).encode() + b":" + body


def tree(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [digest(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], levels


def beside(levels, i):
    out = []
    for level in levels:
        a = i // 8 * 8
        run = level[a:a + 8]
        out.append(("".join(run[:i - a]), "".join(run[i - a + 1:])))
        i //= 8
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows of ``FIELDS``, in memory."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], digest(*map(written, r)), r))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {x: tree([y[1] for y in by[x]]) for x in by}
    root, top = tree([trees[x][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, (key, leaf, r) in enumerate(by[lang]):
            path = beside(trees[lang][1], i) + beside(top, k)
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and r[4] is not None:
                r = (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))
            end = digest(*map(written, r))
            for a, b in path:
                end = digest(a, end, b)
            out.append((key, leaf, trees[lang][0], root, digest(*[x for p in path for x in p]), end, end == root))
    return out


def sides(spark, df):
    from sentinela.llm.merkle import manifest
    out = manifest(df, "doc_id", "lang", FIELDS, "text")
    got = [(r.key, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()]
    return sorted(got, key=str), sorted(plain_manifest([tuple(r) for r in df.select(*FIELDS).collect()]), key=str)


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()]
    assert sorted(map(tuple, Q.op13_merkle(spark, SF).collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_manifest_odd_rows(spark):
    df = odd_documents(spark)
    got, want = sides(spark, df.unionByName(df.where("doc_id > 20")))
    assert got == want
    from sentinela.llm.merkle import manifest
    assert manifest(empty_documents(spark), "doc_id", "lang", FIELDS, "text").count() == 0


def test_manifest_wide_ids_lone_leaves_and_many_groups(spark):
    rnd = random.Random(5)
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, 63, 64, 65, 1 << 40, -(1 << 40)] + [rnd.randrange(-(1 << 62), 1 << 62) for _ in range(60)]
    rows = [(i, "s", rnd.choice(["en", "fr"]), 3, f"Text {i}") for i in ids]
    rows += [(i, "s", f"L{i}", 3, "Lone") for i in range(70)] + [(5, None, "", None, None)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for part in (rows, rows[:1], rows[:9]):
        got, want = sides(spark, spark.createDataFrame(part, schema).repartition(4))
        assert got == want


def test_bitmap_ranks(spark):
    from sentinela.llm.merkle import bitmap_ranks
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), rnd.choice([None, *range(-70, 70), 1 << 45])) for _ in range(400)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("g", T.StringType()), T.StructField("k", T.LongType())]))
    ranked, ties = bitmap_ranks(df, "g", "k")
    place = lambda k: -(1 << 70) if k is None else k
    assert ties
    for r in ranked.collect():
        own = [place(k) for g, k in rows if g == r.g]
        assert (r.before, r.ties) == (sum(k < place(r.k) for k in own), own.count(place(r.k)))
