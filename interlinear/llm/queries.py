"""The registered query of each training-data operator, with its contract's
columns. A query only names its table, its production parameters and the
digest columns; the work is the operator's."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (class_lm, cotraining, decontamination, exact_dedup, html_blocks, merkle, packing, repeats, simhash, spelling, sql, surrogates,
               token_store, topk)
from .common import read, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op5_fm_decontamination": sql.OP5, "op9_exact_topk": sql.OP9, "op11_spelling_variants": sql.OP11,
                            "op12_merkle_manifest": sql.OP12, "op13_extendible_dedup": sql.OP13}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/interlinear-token-store-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0)
    return token_store.read(spark, path)


@query
def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return cotraining.score(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")).drop(
        "text", "lang", "source", "n_chars")


@query
def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


#: stands for the secret that a deployment passes
SURROGATE_KEY = "interlinear-example-key"


@query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(read(spark, sf_dir, "documents", "doc_id", "text"), SURROGATE_KEY)


@query
def op5_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"),
                                          read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1).drop("ids")


@query
def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept", "spans")


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "id % 50 = 0", k=5)
    return best.withColumnRenamed("id", "vec_id")


@query
def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    return merkle.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), tampered={"text": lowered}, where=third)


@query
def op13_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents", "doc_id", "text"))
