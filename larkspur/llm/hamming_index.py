"""Exact top-k search of binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments; each distinct code is posted once under the value of
each of its segments. A query probes its segments at radius 0, then 1, and so on: its
segment values with so many bits flipped are joined with the postings, and every code met
is verified by its whole distance. Once all m segments are through with radius r, every
code within m (r + 1) - 1 bits has been met (pigeonhole), so a query ends as soon as its
k-th verified distance is at most that: the result is exact, ties included. Queries that
have ended take no part in later rounds.

The segments are as many as make a table's values about as many as the codes (64 / log2 n,
2 to 8), so a posting list has a few codes at any size. Where the flips of a further radius
would be more than the codes, the queries left over are compared with all codes, in blocks
of queries and shards of codes.

Everything is joins on hashes and top-k aggregates: no list of a segment value is gathered,
so a value that many codes share is an uneven join, which the runtime splits. Equal codes
are one code with its k + 1 smallest ids, which is all that a result of k can use, so a code
that a third of all rows share is posted and verified once.

Codes are the signs of an embedding's components (1 if positive), 64 to a word. Defined
cases: null or empty vectors and those with a null component take no part (a NaN is not
positive); vectors of more than 64 components have several words, shorter ones leave high
bits 0, and missing words count as 0; null ids take no part; rows that share an id are
one row, the one with the least code; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 64
#: Segments of a word, at least and at most.
SEGMENTS = (2, 8)
TOP = 10
EVERY = 100
#: Codes of a shard and queries of a block where all codes are compared.
SHARD_CODES = 1 << 15
BLOCK_QUERIES = 1 << 10


@cache
def flips(width: int, radius: int) -> list[int]:
    """The values of ``width`` bits with ``radius`` bits set."""
    return [sum(1 << i for i in c) for c in combinations(range(width), radius)]


def edges(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of a word."""
    at = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def segment_of(word: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << width) - 1)).cast("long")


def sign_code(vector: Column, first: int | Column = 0) -> Column:
    """Bit i is set if component ``first`` + i is positive."""
    bits = F.transform(F.slice(vector, F.lit(1) + first, F.lit(BITS)), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _signs(table: DataFrame, code: Column) -> DataFrame:
    vector = F.col("embedding")
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull())
    rows = table.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"))
    return rows.groupBy("vec_id").agg(F.min("code").alias("code"))


def sign_codes(table: DataFrame) -> DataFrame:
    """vec_id and code, the signs of the first 64 components as a long."""
    return _signs(table, sign_code(F.col("embedding")))


def sign_words(table: DataFrame) -> DataFrame:
    """vec_id and code, the signs of all components: as many words as the vector asks for."""
    words = F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / BITS).cast("int"))
    return _signs(table, F.transform(words, lambda w: sign_code(F.col("embedding"), w * BITS)))


def distance(a: Column, b: Column, words: int) -> Column:
    total = None
    for w in range(words):
        part = F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))).cast("long")
        total = part if total is None else total + part
    return total


def best(found: DataFrame, keep: int) -> DataFrame:
    """Of each query the ``keep`` nearest codes, ties to smaller first ids, each once."""
    by = Window.partitionBy("query_id").orderBy("distance", "first")
    found = found.withColumn("nth", F.dense_rank().over(by)).where(F.col("nth") <= keep)
    return found.groupBy("query_id", "first").agg(F.min("distance").alias("distance"))


def distinct_codes(rows: DataFrame, k: int) -> DataFrame:
    """code, its k + 1 smallest ids, and the first of them."""
    by = Window.partitionBy("code").orderBy("vec_id")  # limited before the shuffle as well as after
    few = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k + 1)
    return few.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0])


def compare_all(open_queries: DataFrame, codes: DataFrame, words: int, n_codes: int, keep: int) -> DataFrame:
    """The nearest codes of some queries, all codes being compared, in blocks."""
    shards = max(8, -(-n_codes // SHARD_CODES))
    blocks = -(-open_queries.count() // BLOCK_QUERIES)
    asked = open_queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks)))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = codes.select(F.col("code").alias("other"), "first").withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, blocks) - 1).cast("long"))))
    met = asked.join(dealt, ["block", "shard"])
    return best(met.select("query_id", "first", distance(F.col("code"), F.col("other"), words).alias("distance")), keep)


def nearest(codes: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, distance of the rows whose id ``every`` divides; exact.

    ``codes`` has vec_id and code, a long or an array of longs. Order: distance, then vec_id.
    """
    if dict(codes.dtypes)["code"] == "bigint":
        codes = codes.where("code is not null").select("vec_id", F.array("code").alias("code"))
    words = codes.agg(F.max(F.size("code"))).first()[0] or 1
    padded = codes.select("vec_id", F.concat("code", F.array_repeat(F.lit(0).cast("long"), F.lit(words) - F.size("code"))).alias("code"))
    rows = cut(padded.where("vec_id is not null"))
    known = cut(distinct_codes(rows, k))
    n_codes = known.count()
    segments = min(SEGMENTS[1], max(SEGMENTS[0], round(BITS / log2(max(2, n_codes)))))
    parts = [(w, first, width) for w in range(words) for first, width in edges(segments)]
    queries = cut(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "code"))
    segments_of = F.posexplode(F.array(*[segment_of(F.get("code", F.lit(w)), a, n) for w, a, n in parts])).alias("segment", "value")
    postings = known.select("first", F.col("code").alias("other"), segments_of)
    still, found, done, radius = queries, None, [], 0
    while True:
        flipped = sum(comb(width, radius) for _, _, width in parts)
        if flipped > n_codes:
            done.append(compare_all(still, known, words, n_codes, k + 1))
            break
        probes = still.select("query_id", "code", segments_of)
        probes = probes.select("query_id", "code", "segment", F.explode(flipped_values(F.col("value"), parts, radius)).alias("value"))
        met = probes.join(postings, ["segment", "value"]).select("query_id", "first", distance(F.col("code"), F.col("other"), words).alias("distance"))
        met = best(met, k + 1)
        found = cut(met if found is None else best(met.unionByName(found.join(still.select("query_id"), "query_id", "left_semi")), k + 1))
        covered = len(parts) * (radius + 1) - 1
        ended = ranked(found, known, k).groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("farthest")).where((F.col("n") == k) & (F.col("farthest") <= covered))
        ended = cut(ended.select("query_id"))
        done.append(found.join(ended, "query_id", "left_semi"))
        still = cut(still.join(ended, "query_id", "left_anti"))
        if still.isEmpty():
            break
        radius += 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return ranked(whole, known, k).select("query_id", "rank", "vec_id", "distance")


def flipped_values(value: Column, parts: list[tuple[int, int, int]], radius: int) -> Column:
    """The values that differ in ``radius`` bits from that of the row's segment."""
    widths = {width: [i for i, part in enumerate(parts) if part[2] == width] for width in {part[2] for part in parts}}
    chosen = None
    for width, mine in widths.items():
        # One literal: as an expression each, thousands of flips would be thousands of nodes.
        table = F.transform(F.split(F.lit(",".join(map(str, flips(width, radius)))), ","), lambda x: x.cast("long"))
        values = F.transform(table, lambda x: x.bitwiseXOR(value))
        chosen = F.when(F.col("segment").isin(*mine), values) if chosen is None else chosen.when(F.col("segment").isin(*mine), values)
    return chosen


def ranked(found: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query from its k + 1 nearest codes."""
    rows = found.join(known.select("first", "ids"), "first").select("query_id", "distance", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


ORACLE = """
WITH codes AS (
  SELECT vec_id, embedding FROM embeddings),
bits AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM codes),
near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM bits q JOIN bits v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
