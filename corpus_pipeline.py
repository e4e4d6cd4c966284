"""The corpus pipeline: stages over ``documents``, each an operator of lexmill.llm.

Every stage but the last returns the columns of its input; ``run`` writes each stage's rows and reads them back as the
next one's, in the folder that all executors share.

Defined cases: a stage treats nulls, empty texts, repeated rows and empty tables as its operator does. Near-dedup keeps
one row of each component, so repeated rows of one doc_id become one (that of the smallest hash over all columns); rows
without doc_id stay. Mixing repeats rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, line_dedup, mixing, near_dedup, quality
from lexmill.llm.store import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model).where(F.col("predicted") == 1).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that other documents keep."""
    rows = line_dedup.dedup_lines(docs)
    cut = F.col("n_dropped") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(new).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id; of its rows that of the smallest hash."""
    marks = near_dedup.near_components(docs, percent=80).where(F.col("kept") & F.col("doc_id").isNotNull())
    ids = Scratch(spark, "kept").cut(marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "ids")
    known = docs.where(F.col("doc_id").isNotNull())
    # an id that occurs once needs no choice; the hint keeps one plan at every size: texts are shuffled, never sorted
    out = known.join(ids.where(F.col("n") == 1).hint("shuffle_hash"), "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    several = ids.where(F.col("n") > 1)
    if not several.isEmpty():
        # written, so that the join may split a doc_id with very many rows and the choice among them combines before its shuffle
        again = Scratch(spark, "kept").cut(known.join(several, "doc_id", "left_semi"), "again")
        one = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each pass over a document. Documents weigh as the quality classifier scores them.

    Stages return the columns of documents only, so the score is worked out again: the same model, as its samples are.
    """
    model = quality.fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.toDF(*[c if c == "text" else f"own_{c}" for c in docs.columns])
    rows = quality.score_documents(rows, model).drop("predicted").toDF(*docs.columns, "quality__")
    return mixing.mix_documents(rows, quality="quality__").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the text that the ids decode to."""
    out = bpe.round_trip(docs, VOCABULARY)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_lines),
    ("near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]
#: SQL cannot express the trained classifier; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
