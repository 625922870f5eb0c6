"""The training-data pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of `documents` (packing: pieces). Between stages documents are
written as Parquet in the shared folder and read again. A stage therefore first deletes the tables the stage before it has left for its result, if its documents come from other files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from tessera.llm.common import deleted, dropped, recorded, saved


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that lose all their words by that."""
    return _measured(line_dedup.cleaned(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.kept(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, and documents that hold nothing else go."""
    left = decontamination.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _measured(left.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence."""
    return packing.packed(docs)


#: By application and sf_dir: a stage's number and the folders it has left.
_left: dict[tuple[str, str], tuple[int, list[str]]] = {}


def _freeing(k: int, stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage of number k, which deletes what the stage before it has left."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        number, folders = _left.pop(key, (k, []))
        files = docs.inputFiles() if number == k - 1 and folders else []
        names = [f"/{x.rsplit('/', 1)[-1]}/" for x in folders]  # unique, whatever the scheme before them
        if files and not any(name in file for file in files for name in names):
            deleted(spark, *folders)
        with recorded() as now:
            out = stage(spark, docs, sf_dir)
        _left[key] = (k, now)
        return out

    return run_stage


_STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("packing", pack)]
STAGES = [(name, _freeing(k, stage)) for k, (name, stage) in enumerate(_STAGES)]

#: SQL can't express subword ids or connected groups of fuzzy lines; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
