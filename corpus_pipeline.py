"""The corpus pipeline: quality rules, near-duplicates, decontamination, private data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of
docs.  Empty tables pass through; null ids are kept unless a text rule rejects their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontam, packing, pii, quality_rules
from engram.llm.minhash import near_duplicates
from engram.llm.workspace import Workspace, owned


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules and the learned decision list reject."""
    return quality_rules.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents linked at five-word shingles and a similarity of 0.8.

    Of rows that share that id one stays: the first by text.  Null ids stay.
    """
    ws = Workspace(spark, "near-dedup")
    found = ws.table(near_duplicates(spark, docs, shingle_words=5, percent=80).select("doc_id", "kept"), "found")
    kept = docs.join(found.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    twice = ws.table(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    first = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r"))
    ones = first.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"r.`{c}`").alias(c) for c in docs.columns])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(ones)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose tiles cover four fifths of a benchmark item."""
    return decontam.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and counts characters anew."""
    return pii.redact(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all documents into sequences of 2048 tokens, neighbours on the curve together."""
    return packing.pack(spark, docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("private data", redact), ("packing", pack)]
#: SQL cannot express learned rules, tilings or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each but the last written and read again as the next one's input.

    What a stage wrote for itself is removed once its result is written; the last stage's tables go with the folder.
    """
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with owned():
            docs = ws.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
