"""Problem 7: every document as token ids of a public tokenizer."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from codewell.llm.tokens import encode_corpus
from codewell.runtime import table

#: Folder of the vocabulary files, which every executor must be able to read; a session setting may name another.
SETTING, DEFAULT = "spark.codewell.tokenizers", "/opt/tokenizers"


def vocabulary(spark: SparkSession, name: str) -> str:
    """Path of a vocabulary file."""
    return os.path.join(spark.conf.get(SETTING, DEFAULT), f"{name}.tiktoken")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k, without special tokens."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(spark, "byte_bpe_50k"))


QUERIES = {"p7_ids": p7_ids}
SQL: dict = {}
