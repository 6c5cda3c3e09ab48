"""The llm operators bound to the test tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.alignment import link_counts
from plumbline.llm.bpe import bpe_decode, bpe_encode
from plumbline.llm.common import scratch_path, written
from plumbline.llm.embedding_dedup import embedding_components
from plumbline.llm.fingerprints import edit_likeness, with_near_counts
from plumbline.llm.language import identify_language, train_language
from plumbline.llm.mixing import mix_rates, plan_mix
from plumbline.llm.oracles import ORACLE
from plumbline.llm.pii import BASE, count_kind, pii_spans, spelled, train_pii
from plumbline.llm.quality import remainder, score_quality, train_quality
from plumbline.llm.scoring import score_texts
from plumbline.llm.secret_scan import count_of, listed, secret_spans
from plumbline.llm.simhash_dedup import fingerprint_hex, simhash_components
from plumbline.llm.token_files import read_bundle, write_bundle
from plumbline.llm.whitening import whiten_vectors

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("vec_id bigint, embedding array<float>").parquet(
        f"{sf_dir}/embeddings.parquet"
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bundle")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    write_bundle(documents(spark, sf_dir), path, tokenizer)
    return token_digests(read_bundle(spark, path))


def token_digests(read: DataFrame) -> DataFrame:
    return read.select(
        F.col("id").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(vectors(spark, sf_dir)).withColumnRenamed("id", "vec_id")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(edit_likeness(documents(spark, sf_dir)), "likeness")
    # The search: every hundredth id against all rows.
    near = with_near_counts(found, F.col("id") % 100 == 0)
    return near.withColumnRenamed("id", "doc_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(documents(spark, sf_dir), remainder(F.col("doc_id"), 10) == 0)
    return scored.withColumnRenamed("id", "doc_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return bpe_digests(bpe_decode(bpe_encode(documents(spark, sf_dir), tokenizer), tokenizer))


def bpe_digests(decoded: DataFrame, *kept: str) -> DataFrame:
    return decoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *kept,
    )


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Trained on the labelled rows that are not held out."""
    labels = spark.read.schema("doc_id bigint, quality int").parquet(f"{sf_dir}/labels.parquet")
    return train_quality(docs, labels.filter(remainder(F.col("doc_id"), 3) != 1))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select(
        F.col("id").alias("doc_id"),
        (remainder(F.col("id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = train_language(docs.filter(remainder(F.col("doc_id"), 5) != 0), vocabulary)
    return identify_language(docs, model).select(
        F.col("id").alias("doc_id"),
        (remainder(F.col("id"), 5) == 0).alias("held_out"),
        "lang_pred",
        "score",
    )


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, sized = plan_mix(documents(spark, sf_dir))
    return mix_rates(sized, plan).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "rate", "copies"
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(secret_spans(documents(spark, sf_dir)))


def span_digests(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        *[count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir), shingle=4, max_bits=4)
    return found.select(
        F.col("id").alias("doc_id"),
        fingerprint_hex(F.col("fingerprint")).alias("fingerprint"),
        "component_id",
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_rows(whiten_vectors(vectors(spark, sf_dir)))


def component_rows(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    return whitened.select(
        F.col("id").alias("vec_id"), "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "cell"),
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("cell.whitened").alias("whitened"), F.col("cell.explained").alias("explained"),
        "identity_error",
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii_spans(docs, train_pii(docs))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return link_counts(documents(spark, sf_dir), *paths).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in (
        op1_token_files, op2_embedding_near_dedup, op3_document_fingerprints,
        op4_lm_scoring,
        op5_bpe_round_trip, op6_quality_classifier, op7_language_id,
        op8_entropy_mix, op9_secret_scans, op10_simhash_near_dedup,
        op11_embedding_whitening, op12_pii, op13_tokenizer_alignment,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
