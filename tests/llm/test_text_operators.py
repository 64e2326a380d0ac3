import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.corpus import SPACE, covered, empty_documents, in_order, odd_documents, odd_rows
from sentinela.llm import queries as Q

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    from sentinela.llm.bpe import Encoder, read_vocabulary
    return Encoder(read_vocabulary(VOCABULARY))


def ids_of(encoder, text):
    import numpy as np
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab eo'st.1 \n\t<|endoftext|>é漢", max_size=60)))
def test_bpe_equals_library(library, encoder, text):
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_long_pieces(library, encoder):
    rnd = random.Random(5)
    for text in ("a" * 5000, "ab" * 3000, "".join(rnd.choice("etaoin") for _ in range(20000)), " " * 3000 + "x"):
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_decode_any_ids(library):
    import numpy as np

    from sentinela.llm.bpe import Decoder, read_vocabulary
    rnd, decoder = random.Random(1), Decoder(read_vocabulary(VOCABULARY))
    runs = [[rnd.randrange(50257) for _ in range(rnd.randint(0, 30))] for _ in range(300)]
    bounds = np.cumsum([0, *map(len, runs)])
    assert decoder.decode(np.array(sum(runs, []), np.int64), bounds) == [
        library.decode(r, skip_special_tokens=False) for r in runs]


def test_op1(spark, library):
    rows = Q.op1_bpe(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_odd_rows(spark, library):
    from sentinela.llm.bpe import tokenize
    rows = tokenize(odd_documents(spark), "text", VOCABULARY).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        text = r.record.text or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text
    assert tokenize(empty_documents(spark), "text", VOCABULARY).count() == 0


def test_line_dedup_odd_rows(spark):
    from sentinela.llm.line_dedup import dedup_lines
    docs = in_order(odd_rows())
    cover = dict(zip(docs, covered([t.split("\n") for _, t in docs], 3)))
    rows = dedup_lines(odd_documents(spark), "doc_id", "text").collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        text = r.record.text
        if text is None:
            assert (r.n_lines, r.removed, r.kept_text) == (0, [], None)
            continue
        gone, lines = cover[r.record.doc_id, text], text.split("\n")
        assert set(r.removed) == gone and r.n_lines == len(lines)
        assert r.kept_text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert any(cover.values())
    assert dedup_lines(empty_documents(spark), "doc_id", "text").count() == 0


def passages_check(rows, docs):
    lower = {c: c + 32 for c in range(65, 91)}
    cover = dict(zip(docs, covered([SPACE.findall(t.translate(lower)) for _, t in docs], 50)))
    for key, text, n_words, n_removed, spans, kept in rows:
        if text is None:
            assert (n_words, n_removed, kept) == (0, 0, None)
            continue
        gone, found = cover[key, text], set()
        for span in filter(None, spans.split(",")):
            a, b = map(int, span.split(":"))
            found.update(range(a, b))
        own = SPACE.findall(text)
        assert found == gone and n_removed == len(gone) and n_words == len(own), key
        assert SPACE.findall(kept) == [x for i, x in enumerate(own) if i not in gone]
        assert gone or kept == text
    assert any(cover.values())


def test_suffix_dedup_odd_rows(spark):
    from sentinela.llm.suffix_dedup import dedup_passages
    rows = dedup_passages(odd_documents(spark), "doc_id", "text").collect()
    assert len(rows) == len(odd_rows())
    passages_check([(r.record.doc_id, r.record.text, r.n_words, r.n_removed, r.spans, r.kept_text) for r in rows],
                   in_order(odd_rows()))
    assert dedup_passages(empty_documents(spark), "doc_id", "text").count() == 0


def test_op9(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = Q.op9_suffix_dedup(spark, SF).collect()
    assert len(rows) == len(texts)
    passages_check([(r.doc_id, dict(texts)[r.doc_id], r.n_words, r.n_removed, r.spans, r.text) for r in rows],
                   in_order(texts))


def test_neighbours_over_batches(spark):
    """Runs of equal prefixes are found whole, over batches and partitions; single ones drop out."""
    from sentinela.llm.suffix_dedup import _with_neighbours
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 300), i) for i in range(500)] + [(1000, i) for i in range(500, 900)]
    df = spark.createDataFrame(pairs, "prefix long, place long")
    count = {}
    for p, _ in pairs:
        count[p] = count.get(p, 0) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = sorted(r.place for r in _with_neighbours(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    assert found == sorted(i for p, i in pairs if count[p] > 1)


def xx(hash_, x):
    import xxhash
    value = xxhash.xxh64(x.encode(), seed=hash_ & ((1 << 64) - 1)).intdigest()
    return value - (1 << 64) if value >= 1 << 63 else value


def sketch(text):
    """Hashes kept of a text and the hash up to which they are complete."""
    words, limit = SPACE.findall(text.lower()), -(1 << 63) + (1 << 61)
    hashes = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i:i + 5]:
            h = xx(h, w)
        hashes.add(h)
    below = sorted(h for h in hashes if h < limit)
    kept = below if len(below) >= 16 else sorted(hashes)[:16]
    return len(hashes), kept, (1 << 63) - 1 if len(kept) == len(hashes) else max(limit - 1, kept[-1])


def like(a, b):
    if not a[0] and not b[0]:
        return 1.0
    upto = min(a[2], b[2])
    x, y = ({h for h in s[1] if h <= upto} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def fingerprint_check(rows, docs):
    """rows: (key, text) -> columns; docs: (key, text) in order of key."""
    for i, (key, text) in enumerate(docs):
        n, after = len(text), docs[(i + 1) % len(docs)][1]
        edited = text[:n - n // 4] + after[:n // 4]
        r = rows[key, text]
        a, b = sketch(text), sketch(edited)
        assert r["n_chars"] == n
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == f"{a[0]}:" + ",".join(f"{h & ((1 << 64) - 1):X}" for h in a[1])
        assert r["edited_fingerprint"] == f"{b[0]}:" + ",".join(f"{h & ((1 << 64) - 1):X}" for h in b[1])
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, sketch(after)))


def test_op10(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op10_fingerprints(spark, SF).collect()
    assert len(rows) == len(texts)
    fingerprint_check({(r.doc_id, texts[r.doc_id]): r.asDict() for r in rows}, sorted(texts.items()))
    near = sorted(r.near_edited for r in rows)
    assert near[len(near) // 2] > 0.4 and sum(r.near_edited >= r.near_next for r in rows) > 0.95 * len(rows)


def test_fingerprint_odd_rows(spark):
    from sentinela.llm.fingerprint import compare_with_edit
    docs = odd_documents(spark)
    rows = compare_with_edit(docs, "doc_id", "text").collect()
    assert len(rows) == len(odd_rows())
    # keys that occur once, between neighbours that occur once
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    by = {r.id: r for r in rows}
    for key in range(11, 50):
        text, after = texts[key], texts[key + 1]
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        assert by[key].edited == edited and by[key].n_chars == len(text)
        assert by[key].near_edited == pytest.approx(like(sketch(text), sketch(edited)))
    assert compare_with_edit(empty_documents(spark), "doc_id", "text").count() == 0
    one = compare_with_edit(docs.where("doc_id = 11"), "doc_id", "text").collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketches_merge(spark):
    from sentinela.llm.fingerprint import containment, merged, with_sketch
    rnd = random.Random(8)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    a, b, both = " ".join(w[:2004]), " ".join(w[2000:]), " ".join(w)
    df = spark.createDataFrame([(a, b, both)], "a string, b string, c string")
    for c in "abc":
        df = with_sketch(df, F.col(c), f"s{c}")
    r = df.select(merged(F.col("sa"), F.col("sb")).alias("m"), "sc", containment(F.col("sa"), F.col("sc")).alias("in"),
                  containment(F.col("sc"), F.col("sa")).alias("of")).first()
    assert r.m.kept == r.sc.kept and abs(r.m.n - r.sc.n) < 200
    assert r["in"] == 1.0 and abs(r.of - 2 / 3) < 0.1


def test_encode_and_decode_columns(spark, library):
    """The separate column functions agree with the library, null ids and texts included."""
    from sentinela.llm.bpe import Bpe
    bpe = Bpe(spark, VOCABULARY)
    df = spark.createDataFrame([("a b c",), (None,), ("é <|endoftext|>",)], "t string")
    rows = df.select("t", bpe.encode("t").alias("i")).collect()
    assert [r.i for r in rows] == [library.encode(r.t or "", add_special_tokens=False).ids for r in rows]
    ids = spark.createDataFrame([([64, None, 50257, -1, 65],), (None,), ([],)], "i array<int>")
    assert [r.d for r in ids.select(bpe.decode("i").alias("d")).collect()] == [library.decode([64, 65]), "", ""]
