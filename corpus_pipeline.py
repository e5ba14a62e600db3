"""From raw documents to training shards: five stages, each over all that its predecessor kept.

Null and empty texts, repeated rows, empty tables and further columns are treated as the operators' modules say; in short, the first
four stages keep the columns of their input, and a text that is empty is a document like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import Stored
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.mixing import mixture
from lodestone.llm.quality import quality_filter
from lodestone.llm.simhash import simhash_dedup
from lodestone.llm.token_output import read_tokens, write_tokens
from lodestone.session import read_table, share_package, shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    share_package(spark)
    return quality_filter(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within three bits, over shingles of three words."""
    share_package(spark)
    return simhash_dedup(docs, shingle=3, distance=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, nor an edited copy of one."""
    share_package(spark)
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks; as many words as before, and no source more than four times."""
    share_package(spark)
    return mixture(docs, entropy=0.95, repeats=4.0, order=False)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard files of token ids, and a row for each document in them."""
    share_package(spark)
    path = shared_dir(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, with_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token shards", token_shards),
]
#: Scores and alignments have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` of each document in the shards."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = Stored(docs, f"stage-{i}").df
    return docs
