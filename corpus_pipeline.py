"""The corpus pipeline: rules, lines, near duplicates, mixture, tokens. Each stage is a function of (spark, docs, sf_dir).

Defined cases of all stages: an empty table gives an empty one; other columns of documents stay as they are, whatever their
names. Texts are judged whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import byte_bpe, host_quality, line_dedup, poisson_mix, superminhash
from gristmill.llm._stage import Scratch, fresh


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected. A null text has no words and goes; a null source is no
    host and is not rejected; equal rows have equal verdicts."""
    result = fresh(docs.columns, "quality")
    judged = host_quality.judge(docs, result="quality")
    return judged.where(F.col(f"{result}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; a document of which no word is left goes, null texts with it.
    Equal rows of one id are one document and stay both; texts of a null id come first, in the order of their hashes."""
    done = line_dedup.dedup_lines(docs, counts=False)
    return done.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id. Rows of that id stay all; rows without an
    id or without words are in no class and stay."""
    key = fresh(docs.columns, "gone")
    gone = superminhash.classes(docs).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order. A null source is a source of
    its own; rows of equal id, or without one, draw alike; null texts are copied as they are."""
    return poisson_mix.mix(docs, marks=False)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of the ids and of what they decode to. A null text has no ids; equal rows give
    equal rows."""
    return byte_bpe.encode(docs, keep=["doc_id", "source"], ids=True, digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte BPE", encode_bytes),
]

#: Byte-pair encoding has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name.replace(" ", "-"))
    return docs
