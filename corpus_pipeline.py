"""A training-data pipeline: quality rules, line dedup, near-dedup, packing; each stage is one of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_runs, packing, quality, weighted_minhash
from tidemark.llm.common import materialize, tidy

#: The vocabulary file; None: word_bpe_49k.json of the installed public_tokenizers.
TOKENIZER: str | None = None


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity bands; all columns as they were.

    Null and empty texts have no words, so they go; a null lang is judged as a language of its own; rows with equal
    or null doc_id are judged one by one; a very long text is scored whole; an empty table stays empty.
    """
    scored = materialize(quality.score(docs, quality.train(docs), trained_on_docs=True), "pipeline-scored")
    return quality.judge(scored).where("kept").select("row.*")


@tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with later copies of repeated line runs cut out of text; n_chars follows the text.

    Rows equal in doc_id and text are one document and are cut alike; null doc_ids come after all others; a null text
    stays null; a text of repeated lines only becomes empty; an empty table stays empty; all columns are kept.
    """
    cut = line_runs.dedup_lines(docs)
    kept = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("n_deleted") > 0, F.char_length("text")).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[v.alias(c) for c, v in kept.items()])


@tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id, nulls last; of rows with that doc_id one.

    Each null text is a class of its own and stays; empty texts are one class; an empty table stays empty; all columns
    are kept.
    """
    return weighted_minhash.mark_near(docs).where("first").select("row.*")


@tidy
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its sequence and offset; the last stage, so no other columns are returned.

    A null or empty text is one piece of one token; longer texts than a sequence are cut; rows with equal or null
    doc_id are packed one by one; an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, TOKENIZER or public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("packing", best_fit_packing)]

#: Perplexity, sampling and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again. Runs share nothing but the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
