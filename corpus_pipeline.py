"""Corpus pipeline: every stage reads the Parquet table that its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from towerlens.llm import common, decontamination, line_dedup, packing, quality_rules, shingle_neardup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees, with all their columns.

    A null or empty text has no words and fails the base rule; long texts are judged whole;
    repeated rows get equal verdicts, so all of them stay or go. Columns may have any name,
    those of the verdict included. An empty table stays empty.
    """
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.withColumnsRenamed(own)
    trees = quality_rules.train(plain, common.table(spark, sf_dir, "labels"))
    kept = quality_rules.judge(plain, trees).filter("kept").select(*plain.columns)
    return kept.toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each repeated line kept once.

    Nulls stay null; blank lines stay; of equal or similar lines the first by doc_id (null
    first) and line number stays; rows equal in doc_id and text get equal results.
    """
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with all its columns, whatever their names.

    SimHashes meet in vantage-point trees; an exact check finds what links at more bits.
    Null and empty texts have no words and are copies of each other; ties in doc_id go to the
    smallest hash of the text, then to any row; an empty table stays empty.
    """
    return shingle_neardup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut out.

    Null texts stay null and empty ones empty, long ones are searched whole; repeated rows
    get equal results; other columns are carried.
    """
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 2048.

    A null text is packed as an empty one; repeated rows are packed as often as they come.
    """
    return packing.pack(docs, packing.tokenizer())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pack", pack)]

#: SQL cannot express training, edit similarity links, components or tokenizing; brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = common.stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
