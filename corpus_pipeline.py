"""A training corpus from ``documents``: five stages, each of one operator of codexmill.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.llm import decontaminate, line_dedup, minhash, quality, sentencepiece_scan
from codexmill.llm.common import cut, discard, small_or_shuffled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that pass the base rules and both heads stay."""
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), passing=True)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their frequent lines; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that with the smallest id (nulls last).

    Where ids are null or repeated the rows are numbered in the order of their ids, so that
    each counts by itself.
    """
    whole = dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    rows = docs.withColumn("_row", F.col("doc_id"))
    if not whole or not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        order = docs.withColumn("_at", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "_at")
        rows = cut(order.withColumn("_row", F.monotonically_increasing_id()))
    gone = minhash.near_duplicates(rows, "_row").filter("not kept").select("_row")
    return rows.join(small_or_shuffled(cut(gone)), "_row", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chunks, n_tokens, tokens and the text that the tokens decode to."""
    return sentencepiece_scan.encode(docs, sentencepiece_scan.read_model(), decoded="text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_frequent_lines),
    ("minhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("sentencepiece", to_tokens),
]

#: The quality heads and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are kept in the shared folder."""
    docs, kept = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            discard(*kept)  # the stage before has been read to its end
            kept = [docs]
    return docs
