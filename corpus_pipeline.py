"""Corpus pipeline: documents -> a mixed, clean training corpus, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame;
stages are run one after the other, each on the Parquet table that the one
before wrote.  All but the last return the columns of documents.  Rows may have
nulls in any column, further columns pass through, and an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm.decontaminate import decontaminate
from tokenloom.llm.language import keep_known
from tokenloom.llm.mixing import mix_sources
from tokenloom.llm.ngram_join import keep_one_of_each
from tokenloom.llm.secrets import redact
from tokenloom.llm.storage import Scratch, fresh_name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a letter, or without a language that holds half of them, go."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the document with the smallest doc_id stays."""
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a passage of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document stays, its secrets are replaced by a mark."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents that the mix takes, with size, source_size, target, copies and taken."""
    mixed, name = mix_sources(docs, keep=tuple(docs.columns))
    added = ("size", "source_size", "target", "copies", "taken")
    names, taken = [], list(docs.columns)
    for a in added:
        names.append(fresh_name(taken, a))
        taken.append(names[-1])
    return mixed.where(mixed[name]["copies"] > 0).select(
        *docs.columns, *[mixed[name][a].alias(n) for a, n in zip(added, names)])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("secrets", secrets), ("mix", mix)]

#: Language mixtures and the fitted counts have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is stored and read again by the next one."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs, path = scratch.store(out)
        if last:
            scratch.drop(last)
        last = path
    return docs
