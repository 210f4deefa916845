"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, block_max_search, curriculum_mix, hamming_index, host_boilerplate, language_id, license_scan, merkle_manifest, odd_sketch, permutation_index, pii, simhash, substring_dedup
from .common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(read(spark, sf_dir, "embeddings"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_mix.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing.pack(read(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(hamming_index.sign_words(read(spark, sf_dir, "embeddings")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"))


def op10_host_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_boilerplate.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_repeated")


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(read(spark, sf_dir, "documents"))


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.groups(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_license_scan,
    op2_permutation_index,
    op3_curriculum_mix,
    op4_best_fit_packing,
    op5_language_id,
    op6_pii,
    op7_substring_dedup,
    op8_hamming_index,
    op9_simhash,
    op10_host_boilerplate,
    op11_block_max_search,
    op12_merkle_manifest,
    op13_odd_sketch,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.ORACLE,
        "op3_curriculum_mix": curriculum_mix.ORACLE,
        "op8_hamming_index": hamming_index.ORACLE,
        "op11_block_max_search": block_max_search.ORACLE,
        "op12_merkle_manifest": merkle_manifest.ORACLE,
    }
