"""The registered queries of the training-data operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.ann import nearest
from lodestone.llm.common import documents
from lodestone.llm.decontaminate import leaks
from lodestone.llm.licenses import license_scan, license_sql
from lodestone.llm.mixing import mixing_counts, mixing_sql
from lodestone.llm.pieces import piece_digests
from lodestone.llm.prefix_trie import prefix_trie
from lodestone.llm.quality import quality
from lodestone.llm.repair import repair_damaged
from lodestone.llm.simhash import simhash_components
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.suffix_dedup import suffix_dedup
from lodestone.llm.token_output import read_tokens, write_tokens
from lodestone.llm.toxicity import toxicity
from lodestone.session import read_table, share_package, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query under its name; executors get the package with it."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir), shingle=3, distance=3)


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), length=400, keep="none", texts=False)


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), length=20, texts=False)


@query
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, with_ids=False)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


ORACLES["op10_license_scan"] = license_sql()


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_counts(documents(spark, sf_dir), entropy=0.95, repeats=4.0)


ORACLES["op8_mixing"] = mixing_sql(entropy=0.95, repeats=4.0)


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query
def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(read_table(spark, sf_dir, "conversations"))


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))
