"""Each stage against brute force on its own input, and the whole chain."""

from collections import Counter

import public_tokenizers

import corpus_pipeline as P
from llm.corpus import SPACE, covered, empty_documents, in_order, near_groups, odd_documents
from sentinela.llm._base import stash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lines_by_hand(rows):
    docs = in_order(rows)
    cover = dict(zip(docs, covered([t.split("\n") for _, t in docs], 3)))
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None))
            continue
        gone = cover[r[0], r[1]]
        kept = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        if not gone or SPACE.search(kept):
            out.append((r[0], kept))
    return out


def chain(spark, docs, sf_dir=SF):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    columns = docs.columns
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        docs = stash(stage(spark, docs, sf_dir), "test")
        if name != "tokens":
            assert docs.columns == columns, name
            after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "language":
            letters = [r[:2] for r in before if any(c.isalpha() for c in r[1] or "")]
            assert not Counter(after) - Counter(letters)
            assert len(after) >= 0.99 * len(letters)
        elif name == "lines":
            assert Counter(after) == Counter(lines_by_hand(before))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_duplicates":
            groups = near_groups(before)
            keep = Counter({(r[0], r[1]): 1 for r, g in zip(before, groups) if r[0] is not None and r[0] == g[2]})
            keep += Counter((None, r[1]) for r, g in zip(before, groups) if r[0] is None and g[2] is None)
            assert Counter(after) == keep
        elif name == "mixture":
            assert set(after) <= {r[:2] for r in before}
            total = sum(len(SPACE.findall(r[1] or "")) for r in before)
            assert abs(sum(len(SPACE.findall(t or "")) for _, t in after) - total) <= 0.35 * total
        else:
            rows = docs.collect()
            assert len(rows) == len(before) and all(r.round_trip for r in rows)
            ids = Counter((r.doc_id, tuple(r.token_ids)) for r in rows)
            assert ids == Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in before)
    return docs


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "mixture", "tokens"]
    last = chain(spark, docs)
    assert Counter(r.doc_id for r in P.run(spark, SF).collect()) == Counter(r.doc_id for r in last.collect())


def test_stages_on_odd_rows(spark):
    chain(spark, odd_documents(spark))


def test_stages_on_an_empty_table(spark):
    docs = empty_documents(spark)
    for _, stage in P.STAGES:
        docs = stash(stage(spark, docs, SF), "test")
    assert docs.count() == 0
