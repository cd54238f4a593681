"""Corpus pipeline: the stages from raw documents to packed sequences.

Each stage takes and returns documents (the last one returns packed pieces); between stages the documents are written
as Parquet and read again.  Rows with a null id pass the dedup stages unchanged; an empty table passes all stages; further
columns, also those named like a stage's working columns, come through with their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import jaccard, lines, substrings
from gaugeworks.llm.queries import packed, with_language
from gaugeworks.operators.lineage import cut

#: A text stays if one language takes at least this share of the likelihoods.
MIN_SHARE = 0.5


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """Documents with another text and its length."""
    out = docs.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def _apart(docs: DataFrame, working: str) -> tuple[DataFrame, dict[str, str]]:
    """Documents whose own column of the working column's name stands aside, and how to name it back."""
    if working not in docs.columns:
        return docs, {}
    aside = f"_own_{working}"
    return docs.withColumnRenamed(working, aside), {aside: working}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts no language explains better than the others together, go."""
    found = with_language(spark, docs, docs)
    return found.where((F.col("_li.lang") != "und") & (F.col("_li.score") >= MIN_SHARE)).select(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them only."""
    docs, back = _apart(docs, "keep")
    marked = lines.with_keep(docs, lines.keep_bitmaps(docs))
    return _with_text(marked, F.when(F.col("text").isNotNull(), lines.kept_text(F.col("text"), F.col("keep"))), docs.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays."""
    groups = jaccard.near_groups(docs).where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(groups, "doc_id", "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by windows that an earlier document holds go; untouched texts stay as they are."""
    docs, back = _apart(docs, "spans")
    marked = substrings.with_spans(docs, substrings.repeated_spans(docs))
    out = _with_text(marked, F.when(F.col("spans").isNull(), F.col("text")).otherwise(substrings.kept(F.col("text"), F.col("spans"))["kept"]), docs.columns)
    return out.withColumnsRenamed(back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return packed(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language),
    ("line_dedup", shared_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", shared_passages),
    ("best_fit_packing", packing),
]

#: Language identification and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
