"""A corpus pipeline in five stages over `documents`; each reads what the one before wrote.

Language ID drops what it rejects. Exact dedup keeps the least id of equal texts, the n-gram join the least id of what chains of similar texts connect.
Mixing draws documents to the target weights, some more than once. BPE gives doc_id, n_tokens and tokens, a row for each row of the mixture; all stages
before it return the columns of `documents`, and any further ones, unchanged.

Defined results: a row with a null id goes in the first stage; null, empty and blank texts have no language and go there too; rows with null labels or
sources are treated like others (a null source is a source of its own); a row repeated with its id stays once; a null size counts as 0, so a document
without one is drawn as often as its source's others; an empty table passes all stages and gives no rows; columns may be called whatever they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from siltstone.llm.common import documents, scratch_root
from siltstone.llm.queries import WEIGHTS


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, check=False)


STAGES = [("language ID", languages), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("BPE encoding", tokens)]

#: Compression and automaton stages are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    at = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
