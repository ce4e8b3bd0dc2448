"""The corpus pipeline: language ID, quality rules, near-duplicates and packing, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import local

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tickerloom.llm import langid, near_dup, packing, quality
from tickerloom.llm.common import prepare, release, stored, table, tracked
from tickerloom.llm.tokens import SMALL_CACHE
from tickerloom.session import broadcast_if_small

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_threads = local()


def _stage(fn: Stage) -> Stage:
    """Drop the tables that the stage before wrote for itself: its result has been written by now.

    What a run wrote is kept per thread and folder, so runs in other threads or over other folders lose nothing.
    """

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _threads.__dict__.setdefault(sf_dir, [])
        release(prepare(spark), before)
        with tracked() as paths:
            out = fn(spark, docs, sf_dir)
        before[:] = paths
        return out

    return run_stage


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters (null and empty texts too) or unlike every language go; repeated rows are
    judged alike."""
    return langid.keep_documents(docs)


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with thresholds from these documents' own sketches.

    Null and empty texts have no words and go; repeated rows are judged alike; every column comes out as it came in.
    """
    rows = docs.select(F.struct("*").alias("document"), "lang", "source", "text")
    return quality.judge(rows, keep=["document"]).where(F.col("kept")).select("document.*")


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by sets of five-word shingles that are 80 % alike: that of the smallest doc_id.

    Of rows with that id one stays. Texts without words are linked with nothing and stay.
    """
    rows = stored(docs.select(F.struct("*").alias("document"), F.monotonically_increasing_id().alias("n")), "pipeline-rows")
    found = near_dup.near_duplicates(rows.select("document.doc_id", "document.text", "n"), row="n")
    first = stored(found.where("first").select(F.col("row").alias("n")), "pipeline-first")
    return rows.join(broadcast_if_small(first), "n", "left_semi").select("document.*")


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its place in a sequence of 2048 tokens; a null or empty text is its end token alone."""
    cut = stored(packing.pieces(docs, cache=SMALL_CACHE), "packing-pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL can't express the text model, the sampling of its training rows or the packing; tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
