"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* only the columns an operator names are read, so extra input columns, whatever
  their names, never clash with working columns;
* a word is a maximal run of characters outside U+0020 and U+0009..U+000D;
* an intermediate that two branches need is written once with ``checkpoint()``
  to the folder named by ``spark.checkpoint.dir`` (shared, so it survives a
  lost executor), never to an executor's own disk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Texts that leave Arrow together.
PIECE = 256


def pieces(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of Arrow batches, in order, a few at a time as Python's own.

    A function that yields a result per piece holds neither a batch's texts as objects nor its
    results at once, and the JVM gets them in small batches.
    """
    for texts in batches:
        for at in range(0, len(texts), PIECE):
            yield texts.slice(at, PIECE).to_pylist()


def power_of_two(wanted: float, least: int, most: int) -> int:
    """The power of two at or above ``wanted``, within [least, most]."""
    return int(min(most, max(least, 2 ** math.ceil(math.log2(max(wanted, 1))))))


def digest_ids(*cols: str):
    """A well-mixed, non-negative long of the named columns, nulls included."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


#: Bits of a filter, a power of two, and those that a row of Spark's bitmap functions holds.
FILTER_BITS = 1 << 23
_SLICE = 1 << 15


def filter_of(hashes: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS with the places of the one column's 64-bit hashes set.

    It has 1 MB whatever it is made of; made of too much, it lets everything pass.
    """
    place = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS))
    slices = hashes.select(F.floor(place / _SLICE).cast("int").alias("slice"), (place % _SLICE).cast("long").alias("bit")).groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    whole = bytearray(FILTER_BITS // 8)
    for r in slices:
        whole[r["slice"] * _SLICE // 8 : (r["slice"] + 1) * _SLICE // 8] = r["bits"]
    return bytes(whole)


def passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be among those of ``filter_of``."""
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (np.frombuffer(bits, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
