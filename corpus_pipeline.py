"""A training-data pipeline over documents, from quality to token ids.

Every stage works on all that the one before kept. Its result is written to the shared
folder as Parquet and read again, so a lost executor repeats no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.bindings import bpe_digests, documents, quality_model
from plumbline.llm.bpe import bpe_decode, bpe_encode
from plumbline.llm.common import written
from plumbline.llm.mixing import mixed_documents, plan_mix
from plumbline.llm.quality import keep_good
from plumbline.llm.secret_scan import redact_secrets
from plumbline.llm.simhash_dedup import one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality below 0.5 go; empty and null texts score as an empty line."""
    return keep_good(docs, quality_model(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates stays."""
    return one_per_group(docs, shingle=4, max_bits=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars counts the text as it is then, null as null."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    plan, _ = plan_mix(docs)
    return mixed_documents(docs, plan)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return bpe_digests(bpe_decode(bpe_encode(docs, tokenizer), tokenizer), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("tokens", tokens),
]

# The classifier is trained, fingerprints are XXH64 and the mix is solved by Newton steps:
# SQL can't express the stages. tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
