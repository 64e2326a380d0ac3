"""From raw documents to tokens in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared scratch folder as Parquet and reads it back as the next one's
docs. All stages but the last return the columns of ``documents``. Nulls, empty
texts, repeated rows and empty tables follow the rules in the operators'
docstrings; further columns of docs pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm._base import stash, table
from sentinela.llm.bpe import tokenize
from sentinela.llm.langid import fit, identify
from sentinela.llm.line_dedup import dedup_lines
from sentinela.llm.mixing import mix, repeat_rows
from sentinela.llm.setsketch import drop_near_duplicates

#: No SQL for the whole: language models, near duplicates and tokens are checked against brute force instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits the language model of some language; null texts and texts without letters go."""
    found = identify(docs, "text", fit(docs, "doc_id", "text", "lang"))
    return found.where("found.accepted").select("record.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line passages; a text of which only white space is left goes."""
    out = dedup_lines(docs, "doc_id", "text")
    emptied = (F.size("removed") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    columns = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return out.where(~F.coalesce(emptied, F.lit(False))).select(
        *[columns.get(c, F.col(f"record.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs, "doc_id", "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's target takes it (up to three times, or not at all)."""
    return repeat_rows(mix(docs, "doc_id", "source", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    import public_tokenizers

    out = tokenize(docs, "text", public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("record.doc_id", "record.lang", "record.source", F.size("ids").cast("long").alias("n_tokens"),
                      F.col("ids").alias("token_ids"),
                      (F.col("decoded") == F.coalesce("record.text", F.lit(""))).alias("round_trip"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
