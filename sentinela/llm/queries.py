"""One query per corpus operator over the whole table it is meant for, and SQL twins where SQL can say it.

The queries only derive the digest columns of their contracts; the work is in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm._base import table

SHARDS = 16


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    import public_tokenizers

    from sentinela.llm.bpe import tokenize
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokenize(docs, "text", public_tokenizers.path("byte_bpe_50k.json"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("record.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by integer inner product for every 20th vector, against all vectors."""
    from sentinela.llm.topk import quantised, top_k
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", quantised(F.col("embedding")),
                 F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents and the one of each that stays."""
    from sentinela.llm.setsketch import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source: words that each document contributes."""
    from sentinela.llm.mixing import mix
    mixed = mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", carry=["doc_id"])
    return mixed.select("record.doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("repeats")).alias("taken"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned on three of four folds of them."""
    from sentinela.llm.langid import fit, identify
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out), "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), "text", model)
    doc_id = F.col("record.doc_id")
    return found.select(doc_id, F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                        F.col("found.lang").alias("lang_pred"), "found.score", "found.entropy", "found.accepted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and what the tagger adds."""
    from sentinela.llm.secret_scan import scan, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, "text", train(docs, "doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select("record.doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of three-line passages."""
    from sentinela.llm.line_dedup import dedup_lines
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("record.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                      F.array_join("removed", ",").alias("removed"), F.col("kept_text").alias("text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shuffled shards, by law ``key``."""
    from sentinela.llm.sharding import shard_of, shuffle_into_shards
    size = lambda text: (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")
    sharded = shuffle_into_shards(table(spark, sf_dir, "documents"), "doc_id", SHARDS, size(F.col("text")), seed=1)
    doc_id, text = F.col("record.doc_id"), F.col("record.text")
    return sharded.select(doc_id, size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
                          F.lit("key").alias("law"), "shard", "slot", shard_of(doc_id, SHARDS + 1, 1).alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 50 words and more that occur at an earlier place."""
    from sentinela.llm.suffix_dedup import dedup_passages
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("record.doc_id", "n_words", "n_removed", "spans", F.col("kept_text").alias("text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of all documents, compared with an edit and the next document."""
    from sentinela.llm.fingerprint import as_text, compare_with_edit
    out = compare_with_edit(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_text(F.col("sketch")).alias("fingerprint"),
                      as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two of three folds."""
    from sentinela.llm.toxicity import fit, score
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda key: F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = score(docs, "text", fit(docs, labels, "doc_id", "text", "toxic"))
    return found.select("record.doc_id", held_out(F.col("record.doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64-dimensional vectors in eight clusters after ten rounds, nearest centroids by the threshold algorithm."""
    from sentinela.llm.centroids import cluster
    out = cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", size=64, k=8, rounds=10, scale=1024.0, seed="3")
    return out.select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                      F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by language, and what a tampering of every third one does to the root."""
    from sentinela.llm.merkle import manifest
    out = manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], "text")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_top_k, op3_near_dedup, op4_mixing, op5_language_id, op6_secret_scan, op7_line_dedup, op8_sharding, op9_suffix_dedup, op10_fingerprints,
                                    op11_toxicity, op12_centroids, op13_merkle)}



def _centroids_sql(rounds: int = 10, k: int = 8, size: int = 64) -> str:
    """The rounds one after the other: distances, nearest centroid, floor of the mean."""
    near = lambda i: f"""
x{i} AS (SELECT rid, c, sum((x - y) * (x - y)) AS dist FROM v JOIN c{i} USING (d) GROUP BY rid, c),
n{i} AS MATERIALIZED (SELECT rid, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM x{i} GROUP BY rid)"""  # noqa: E731
    moved = lambda i: f""",
m{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM v JOIN n{i} USING (rid) GROUP BY c, d),
c{i + 1} AS MATERIALIZED (SELECT c, d, CAST(CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS y
                          FROM c{i} LEFT JOIN m{i} USING (c, d))"""  # noqa: E731
    return f"""
WITH r AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e,
                               row_number() OVER () AS rid
           FROM embeddings WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT rid, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM r),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c FROM r),
c0 AS MATERIALIZED (SELECT c, d, x AS y FROM s JOIN v USING (rid) WHERE c < {k}),""" + ",".join(
        near(i) + moved(i) for i in range(rounds)) + "," + near(rounds) + f""",
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n{rounds} JOIN r USING (rid) JOIN h USING (c)
"""


def _field_sql(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of decimal text t, bit by bit.
_CRC_SQL = """(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) FOR x IN string_split(t, '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(i AS BIGINT) FOR i IN range(8)]),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)))"""

_MERKLE_SQL = f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT *, xor({_CRC_SQL}, CAST(4294967295 AS BIGINT)) % 3 = 0 AS hit
                                  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS t FROM documents)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf_sql('text')} AS leaf,
       CASE WHEN hit THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
            ELSE {_leaf_sql('text')} END AS found,
       row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
     FROM k),
t AS (SELECT lang, 0 AS lvl, place, leaf AS h, n FROM d
      UNION ALL
      SELECT lang, lvl + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (n + 7) // 8
      FROM t WHERE n > 1 GROUP BY lang, lvl, place // 8, n),
tree AS MATERIALIZED (SELECT * FROM t),
subs AS MATERIALIZED (SELECT lang, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS upper,
                             count(*) OVER () AS n FROM tree WHERE n = 1),
u AS (SELECT 0 AS lvl, upper AS place, subroot AS h, n FROM subs
      UNION ALL
      SELECT lvl + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, place // 8, n),
top AS MATERIALIZED (SELECT * FROM u),
-- every document's place on each level of its language's tree and of the tree above
p AS (SELECT d.rid, d.lang, CAST(x.lvl AS BIGINT) AS lvl, d.place // CAST(pow(8, x.lvl) AS BIGINT) AS place, true AS low
      FROM d JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) x ON d.lang IS NOT DISTINCT FROM x.lang
      UNION ALL
      SELECT d.rid, NULL, s.depth + x.lvl, s.upper // CAST(pow(8, x.lvl) AS BIGINT), false
      FROM d JOIN subs s ON d.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) x),
q AS (SELECT p.rid, p.lvl, p.place, x.place AS other, x.h FROM p JOIN tree x
        ON p.low AND p.lang IS NOT DISTINCT FROM x.lang AND p.lvl = x.lvl AND p.place // 8 = x.place // 8
      UNION ALL
      SELECT p.rid, p.lvl, p.place, x.place, x.h FROM p JOIN d USING (rid) JOIN subs s ON d.lang IS NOT DISTINCT FROM s.lang
        JOIN top x ON NOT p.low AND p.lvl - s.depth = x.lvl AND p.place // 8 = x.place // 8),
b AS MATERIALIZED (SELECT rid, lvl, coalesce(string_agg(h, '' ORDER BY other) FILTER (other < place), '') AS l,
                          coalesce(string_agg(h, '' ORDER BY other) FILTER (other > place), '') AS r FROM q GROUP BY rid, lvl),
f AS (SELECT rid, CAST(0 AS BIGINT) AS lvl, found AS acc FROM d
      UNION ALL
      SELECT f.rid, f.lvl + 1, sha256(b.l || f.acc || b.r) FROM f JOIN b ON f.rid = b.rid AND f.lvl = b.lvl),
g AS (SELECT rid, arg_max(acc, lvl) AS folded_root FROM f GROUP BY rid),
o AS (SELECT rid, string_agg(l || r, '' ORDER BY lvl) AS proof FROM b GROUP BY rid)
SELECT d.doc_id, d.leaf, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(o.proof, '')) AS proof_sha256,
       g.folded_root, g.folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM d JOIN subs s ON d.lang IS NOT DISTINCT FROM s.lang JOIN g USING (rid) LEFT JOIN o USING (rid)
"""

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE = {
    "op12_centroids": _centroids_sql(),
    "op13_merkle": _MERKLE_SQL,
    "op2_top_k": """
WITH v AS MATERIALIZED (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e,
                  row_number() OVER () AS rid
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id AS query_id, rid AS query_rid, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v WHERE vec_id % 20 = 0),
c AS (SELECT vec_id, rid, unnest(e) AS y, generate_subscripts(e, 1) AS d FROM v),
s AS (SELECT query_id, query_rid, vec_id, rid, CAST(sum(x * y) AS BIGINT) AS score FROM q JOIN c USING (d)
      WHERE query_rid <> rid GROUP BY query_id, query_rid, vec_id, rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, pos, l[pos + 1:pos + 3] AS part
      FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM d WHERE len(l) >= 3)
      WHERE regexp_matches(array_to_string(l[pos + 1:pos + 3], ' '), '[^\x20\x09-\x0D]')),
o AS (SELECT part, first(doc_id ORDER BY doc_id, pos) AS first_doc, first(pos ORDER BY doc_id, pos) AS first_pos
      FROM w GROUP BY part HAVING count(*) > 1),
c AS (SELECT doc_id, CASE WHEN doc_id = first_doc THEN greatest(pos, first_pos + 3) ELSE pos END AS a, pos + 2 AS b
      FROM w JOIN o USING (part) WHERE doc_id <> first_doc OR pos <> first_pos),
r AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM c),
x AS (SELECT doc_id, unnest(l) AS t, unnest(range(0, len(l))) AS line FROM d),
k AS (SELECT x.doc_id, count(r.line) AS n_removed,
             coalesce(string_agg(CAST(r.line AS VARCHAR), ',' ORDER BY x.line) FILTER (r.line IS NOT NULL), '') AS removed,
             coalesce(string_agg(t, chr(10) ORDER BY x.line) FILTER (r.line IS NULL), '') AS text
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.line = r.line GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(removed, '') AS removed, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size,
                  CAST('0x' || substr(md5('4:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
                       || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 1.0 / w, source NULLS LAST) AS k FROM s),
p AS (SELECT *, (SELECT sum(source_size) FROM s)
                - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
f AS (SELECT *, w * a >= 3 * source_size * ws AS held FROM p),
l AS (SELECT a, ws FROM f WHERE NOT held ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN held THEN CAST(3 * source_size AS DOUBLE)
             ELSE CAST(w * (SELECT a FROM l) AS DOUBLE) / CAST((SELECT ws FROM l) AS DOUBLE) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND run - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""",
}
