"""Registered queries of the operators in this folder, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import (
    bpe, decontam, lexical, licences, minhash, pii, rangejoin, repeats, resample, tokenfile, topk, toxicity, urls)
from ledgerlens.llm.frames import materialize, read
from ledgerlens.session import shared_folder

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER, END_ID, LARGEST_ID = "byte_bpe_50k.json", 2, 50_256


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85).drop("class_id")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = materialize(tokenfile.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID), "zstd")  # ids are read twice
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    tokenfile.write(tokens, path, LARGEST_ID)
    return tokenfile.digests(spark, path)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages, urls.listing(pages))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(read(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.range_join(read(spark, sf_dir, "embeddings"), 0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_repeats": op2_repeats,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_files": op6_token_files,
    "op7_pii": op7_pii,
    "op8_url_filter": op8_url_filter,
    "op9_top_k": op9_top_k,
    "op10_licences": op10_licences,
    "op11_lexical_search": op11_lexical_search,
    "op12_resampling": op12_resampling,
    "op13_range_join": op13_range_join,
}
ORACLES: dict[str, str] = {
    "op1_minhash": minhash.SQL,
    "op8_url_filter": urls.SQL,
    "op9_top_k": topk.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_resampling": resample.SQL,
    "op13_range_join": rangejoin.SQL,
}
