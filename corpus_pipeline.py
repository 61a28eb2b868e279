"""A training corpus from the documents table, stage by stage.

Each stage works on all documents that its predecessor kept; its result is written to the shared
folder and read again. The last stage returns the pieces of the documents that remain.

Defined cases, in all stages: a null text counts as empty, and so is equal and near to other empty
ones; texts are read whole; repeated rows are copies, of which one stays; of copies the smallest
doc_id stays (in the exact stage first the longest original), a null one last; a document with a
null id is scored and kept like any other; an empty table gives an empty result; further columns,
whatever their names, are carried up to the last stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from colbrook.llm import decontam, exact_dedup, simhash, sp_unigram, toxicity_fm
from colbrook.llm.common import WRITTEN, materialise, prepare, release
from colbrook.llm.queries import tokenizer_path

#: Tables that stages wrote for themselves. As a stage's result is written before the next stage
#: begins, that one deletes its predecessor's.
_OWN: list[str] = []


def stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, [p for p in _OWN if p in WRITTEN])
        before = set(WRITTEN)
        out = f(spark, docs, sf_dir)
        _OWN[:] = [p for p in WRITTEN if p not in before]
        return out

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; learns from the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_fm.drop_toxic(docs, toxicity_fm.train(docs, labels))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, simhash.Settings.for_similarity(0.8))


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, and whether decoding them gives the text back, of every document."""
    return sp_unigram.encode(docs, tokenizer_path("piece_bpe_32k.model"), check=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Learned scores and hash fingerprints cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, f in STAGES:
        docs = materialise(f(spark, docs, sf_dir), name)
        release(spark, [written] if written else [])
        written = WRITTEN[-1]
    release(spark, list(_OWN))
    return docs
