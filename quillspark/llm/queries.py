"""The queries of this subpackage, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, embed_dedup, exact_dedup, minhash, mixing, orc_output, quality, ranked_search, resample, sharding, suffix, url_filter, winnow
from quillspark.llm.common import new_path, table


def op1_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, bpe.default_path())


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    orc_output.write(table(spark, sf_dir, "documents"), path, bpe.default_path())
    return orc_output.index(spark, path)


def op3_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(table(spark, sf_dir, "documents"))


def op4_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited(table(spark, sf_dir, "documents"))


def op8_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).drop("copies")


def op11_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark"))


def op13_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_language_models": op1_url_language_models,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_b_bit_minhash": op3_b_bit_minhash,
    "op4_weak_label_quality": op4_weak_label_quality,
    "op5_extendible_shards": op5_extendible_shards,
    "op6_projection_forest": op6_projection_forest,
    "op7_winnowing": op7_winnowing,
    "op8_suffix_blocks": op8_suffix_blocks,
    "op9_fair_mix": op9_fair_mix,
    "op10_orc_tokens": op10_orc_tokens,
    "op11_wavelet_search": op11_wavelet_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_cuckoo_dedup": op13_cuckoo_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_extendible_shards": sharding.SQL,
    "op9_fair_mix": mixing.SQL,
    "op11_wavelet_search": ranked_search.SQL,
    "op13_cuckoo_dedup": exact_dedup.SQL,
}
