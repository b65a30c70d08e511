"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet between the stages.

quality: documents that the classifier rejects go. dedup: one row of each near-duplicate group stays. decontamination:
documents that hold a test item go. secrets: spans of secrets are replaced by a mark, n_chars follows; the documents stay.
mixing: every document with its text, and the copies and words of it that the mix takes (copies 0: none).

Every stage takes (spark, docs, sf_dir): null and empty texts, null and repeated ids, empty tables and columns of any name
are handled as its docstring says; all but the last return the columns of `docs`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import compression, decontamination, mixing, secrets, simhash
from plumbline.llm.common import checkpoint_dir, removed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score 0.3 or more, learned from `labels`, each by its own text: rows without an id or with a repeated one too.

    Null and empty texts score what a text of average difference does (kept, as a rule); without labels every row stays.
    """
    return compression.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id, rows without an id last; of repeated rows one.

    Null and empty texts are one group, so one such row stays.
    """
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no item of `benchmark`, each by its own text. Null and empty texts stay; with an empty benchmark every row does."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each span of a secret, whole, replaced by a mark; n_chars follows. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their columns, and size, source_size, target, rate, copies (0 to 2) and taken: what the mix takes of them.

    A column of `docs` named like one of these gets the prefix `doc_`. Null texts have size 0; repeated rows are documents of their own.
    """
    return mixing.mix(docs, keep=tuple(docs.columns))


STAGES = [("quality", quality), ("dedup", dedup), ("decontamination", decontaminate), ("secrets", redact), ("mixing", blend)]

#: No SQL: compression, XXH64, guess costs and Newton's steps have none in DuckDB. tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed rows of `documents`. A stage's table goes when the next one is written; what the result is read from stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    home = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            removed(spark, before)
        before = f"{home}/{name}"
    mixed = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, home)
    return mixed
