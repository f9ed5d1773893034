"""The queries of this subpackage with their DuckDB oracles, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from selenic.llm import decontam, jaccard, langid, merkle, neardup, negatives, packing, pii, repeats, sharding, tokens, toxicity, urls
from selenic.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@query("op10_ring_shards", sharding.ORACLE)
def ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


@query("op8_url_vocabulary", urls.oracle())
def url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


@query("op9_weak_supervision")
def weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read_table(spark, sf_dir, "documents")))


@query("op4_whole_tokens")
def whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_harmonic_packing")
def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(packing.pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op1_naive_bayes_language")
def naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op6_hyperplane_neardup")
def hyperplane_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op5_token_group_jaccard")
def token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


@query("op7_induced_suffix_dedup")
def induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op3_latent_decontamination")
def latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op11_nb_scaled_toxicity")
def nb_scaled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op13_merkle_manifest", merkle.ORACLE)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(merkle.manifest(read_table(spark, sf_dir, "documents"), merkle.tampered()))


@query("op12_maximus_negatives", negatives.ORACLE)
def maximus_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read_table(spark, sf_dir, "embeddings"), label=negatives.relabelled())
