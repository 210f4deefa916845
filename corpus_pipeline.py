"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and all
but the last return the columns of ``documents``; other columns of ``docs``, whatever their
names, end there. ``run`` writes each stage's result as Parquet below the shared checkpoint
folder and reads it again, so a lost executor costs the running stage only. Of no documents,
every stage makes none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import best_fit_packing, curriculum_mix, language_id, pii, simhash
from larkspur.session import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Learned scores, tokenizer ids and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, recognised with some certainty.

    Null texts, texts without a letter and texts unlike those of any label go; documents
    without an id and repeated rows are judged as any other; without labelled rows all go.
    """
    return language_id.keep_known(docs, language_id.fit(docs)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates.

    Repeated rows stay once. A document without an id goes only for one without an id that has
    the same text. Texts without words, or null, are a group of their own.
    """
    return simhash.keep_first(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind.

    Null texts stay null and empty ones empty; ``n_chars`` follows the text.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their positions.

    Documents without words take no part, so null and empty texts end here; a null source is one
    source; repeated rows count each; ties of position go by id.
    """
    return curriculum_mix.materialise(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its ids, its sequence and its offset.

    ``ids`` are little-endian unsigned 32-bit integers, and ``ids_crc32`` is their checksum. A
    null text is empty: the end id alone. A document the mix takes n times is packed n times.
    """
    return best_fit_packing.pack(docs, keep_ids=True).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("curriculum_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str, counts: list[tuple[str, int]] | None = None) -> DataFrame:
    """The stages one after the other over ``documents``.

    A stage's result is removed once the next one is written; the last one, which holds all
    that training needs, is the caller's. ``counts`` gets the rows that go in and those that
    each stage leaves.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if counts is not None:
        counts.append(("documents", docs.count()))
    root, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if counts is not None:
            counts.append((name, docs.count()))
        if before:
            remove(spark, before)
        before = f"{root}/{name}"
    return docs
