"""A corpus pipeline: documents to packed training sequences, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the
one before it kept; between stages the documents are written as Parquet and
read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import language_id, ngram_join, packing, paragraph_dedup, quality_rules
from barloom.llm.common import table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not clear (no letter, or a narrow margin); learns from the rows not held out."""
    model = language_id.learn(docs, "text", "lang", language_id.in_training(F.col("doc_id")))
    judged = language_id.identify(docs, model, prefix="_")
    return judged.where(~F.col("_lang_rejected")).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops short and repetitive documents."""
    return quality_rules.keep_unrepetitive(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8); rows without an id stay."""
    found = ngram_join.jaccard_components(docs, k=5, percent=80)
    later = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of passages out of the texts; documents that lose all their words go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = paragraph_dedup.dedup_paragraphs(docs, keep=others)
    emptied = (F.col("n_words_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(F.coalesce(~emptied, F.lit(True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_words_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document, in parts where it is long, in a training sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("substring_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]
#: Compression sizes, MinHash clusters and best-fit plans have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
