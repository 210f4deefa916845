"""Approximate nearest neighbours with a permutation index.

Pivots are vectors of the table, drawn by hash. A vector is represented by its nearest
pivots in order, the first ``PREFIX`` of them, and posted in the inverted files of its
``POSTED`` nearest; a query reads the files of its nearest pivots, ``PROBED`` of them and as
many more as hold ``REACHED`` of the sample's rows nearest to it: the more pivots there are, the
more files a neighbourhood is spread over. Files are dealt by pivot, postings and probes once
each, so what is shuffled grows with the rows and not with rows times queries. In a file the rows are ranked by the footrule distance of their pivot
orders to the query's (a pivot missing on one side counts as position PREFIX), and those
within the query's bar are reranked by their true distances. A row that several of the first
``PROBED`` files of a query hold is handled in the first of them, by the row's own order; later
files may find it again, and it counts once. The k best of all files are the answer.

The bar is read off a sample of ``SAMPLE`` rows drawn by hash: the footrule distance that
``RERANKED`` of all rows stay within, or ``LEAST`` rows where that is more, raised until it
holds most of the sample's rows nearest to the query, which in a dense neighbourhood are
many. So how many rows are reranked follows the data, and is no count that the table
outgrows. There is one pivot for each
``FILE_ROWS`` postings, 256 at least and 65,536 at most, so files keep their size while the
table grows; the sample and the pivots are all that the driver collects, and travel with the
functions (35 MB at most at 64 components). A file that outgrows
``FILE_ROWS`` all the same, as vectors crowd around a pivot, is split, and its queries read
all parts.

Equal vectors have equal permutations and would fill each other's candidates: they are one
vector with its k + 1 smallest ids, which is all that a result of k can use. So a
vector that a third of all rows share is one posting.

Defined cases: vectors that are null, of length zero, all zero, or hold a null or
non-finite component take no part; a query's candidates are the vectors with as many
components as it has, each number of components having an index of its own; a null id takes
no part; rows that share an id are one row, the one with the least vector; fewer candidates
than k are all returned, as far as the index finds them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, power_of_two

PIVOTS = (256, 1 << 16)
PREFIX = 64
POSTED = 4
PROBED = 96
TOP = 10
EVERY = 100
#: Share of all rows, and number, that a query reranks at least about.
RERANKED = 0.06
LEAST = 1000
#: Of the sample's rows nearest to a query, so many, this share stays within the bar too.
NEAR = 20
KEPT = 0.9
#: Of those rows, the share whose files a query reads at least.
REACHED = 0.9
#: Rows that the footrule bar is read off, and postings of a file.
SAMPLE = 2048
FILE_ROWS = 1 << 15
#: Rows whose permutations are made together, and queries that are ranked together.
CHUNK = 1024
QUERIES = 64


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists(vector, lambda x: x != 0)


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, each id once; components as they come."""
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """embedding and ids, its k + 1 smallest."""
    by = Window.partitionBy("embedding").orderBy("vec_id")  # limited before the shuffle as well as after
    few = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def drawn(points: DataFrame, count: int) -> np.ndarray:
    """``count`` distinct vectors, those of the smallest hashes (a top-k, not a sort)."""
    found = points.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(count).collect()
    return np.array([r["embedding"] for r in found], dtype=np.float64)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots in order."""
    out = np.empty((len(x), min(prefix, len(pivots))), np.uint16)
    norm = (pivots * pivots).sum(axis=1)
    for at in range(0, len(x), CHUNK):
        d = norm - 2 * (x[at : at + CHUNK] @ pivots.T)
        out[at : at + CHUNK] = np.argsort(d, axis=1, kind="stable")[:, :prefix]
    return out


def footrule(place: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of every row to a query's pivot order, less what two orders that share nothing have.

    A pivot in both adds |i - j| - (prefix - i) - (prefix - j).
    """
    prefix = len(order)
    i = np.arange(prefix, dtype=np.int16)
    j = place[:, order]
    return (np.abs(j - i) + j).sum(axis=1, dtype=np.int32) + int((i - 2 * prefix).sum())


def small_places(perm: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position of each pivot that the orders use in each row's order (its length where it is
    missing), and the orders in those numbers."""
    used, renamed = np.unique(orders, return_inverse=True)
    at = np.full(1 << 16, len(used), np.int64)
    at[used] = np.arange(len(used))
    out = np.full((len(perm), len(used) + 1), perm.shape[1], np.int16)
    np.put_along_axis(out, at[perm], np.arange(perm.shape[1], dtype=np.int16)[None], axis=1)
    return out, renamed.reshape(orders.shape)


def bars(q: np.ndarray, orders: np.ndarray, sample: np.ndarray, orders_of_sample: np.ndarray, share: float) -> np.ndarray:
    """The footrule distance that ``share`` of the sample stays within, and so do most of the
    sample's rows nearest to the query, for each query."""
    place, renamed = small_places(orders_of_sample, orders)
    nth = min(len(sample), max(1, int(np.ceil(share * len(sample))))) - 1
    out = np.empty(len(q), np.int32)
    for i, order in enumerate(renamed):
        ranks = footrule(place, order)
        near = np.argsort(((sample - q[i]) ** 2).sum(axis=1), kind="stable")[:NEAR]
        out[i] = max(np.partition(ranks, nth)[nth], np.sort(ranks[near])[int(KEPT * (len(near) - 1))])
    return out


def probe_counts(q: np.ndarray, orders: np.ndarray, sample: np.ndarray, orders_of_sample: np.ndarray, posted: int, least: int) -> np.ndarray:
    """How many files each query reads: its nearest sample rows tell how far down its order theirs are.

    ``orders`` has all pivots. The sample's neighbours are farther off than those of the whole
    table, whose files come sooner.
    """
    out, place = np.empty(len(q), np.int64), np.empty(orders.shape[1], np.int64)
    for i, order in enumerate(orders):
        place[order] = np.arange(len(order))
        near = np.argsort(((sample - q[i]) ** 2).sum(axis=1), kind="stable")[:NEAR]
        need = np.sort(place[orders_of_sample[near, :posted]].min(axis=1))
        out[i] = min(len(order), max(least, 1 + need[int(REACHED * (len(near) - 1))]))
    return out


def search_file(pivot: int, x: np.ndarray, perm: np.ndarray, ids: list, asked: list[int], q: np.ndarray, orders: np.ndarray, bar: np.ndarray, posted: int, probed: int, k: int) -> tuple[list[tuple], int]:
    """What a pivot's file has for the queries that probe it: (query_id, vec_id, score), at most
    k for each; and how many rows were reranked.

    ``x``, ``perm``, ``ids``: vectors of the file, their pivot orders, the ids that share them;
    ``asked``, ``q``, ``orders``, ``bar``: ids, vectors, orders and footrule bars of the queries.
    """
    out, reranked = [], 0
    before = perm[:, :posted]
    own = np.argmax(before == pivot, axis=1)
    for at in range(0, len(asked), QUERIES):
        place, renamed = small_places(perm, orders[at : at + QUERIES, : perm.shape[1]])
        for i, order in enumerate(renamed, at):
            probes = np.zeros(1 << 16, bool)
            probes[orders[i, :probed]] = True
            probes[pivot] = True
            first = np.argmax(probes[before], axis=1) == own  # no nearer pivot of the row is probed too
            near = np.flatnonzero(first & (footrule(place, order) <= bar[i]))
            reranked += len(near)
            d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
            if len(d) > k + 1:
                best = np.flatnonzero(d <= np.partition(d, k)[k])
                near, d = near[best], d[best]
            out += [(asked[i], v, s) for s, v in sorted((float(s), int(v)) for s, r in zip(d, near) for v in ids[r] if v != asked[i])[:k]]
    return out, reranked


def nearest(table: DataFrame, k: int = TOP, every: int = EVERY, pivots: tuple[int, int] = PIVOTS, prefix: int = PREFIX, posted: int = POSTED, probed: int = PROBED, reranked: float = RERANKED, least: int = LEAST, file_rows: int = FILE_ROWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id ``every`` divides."""
    rows = cut(vectors(table))
    points = cut(distinct_vectors(rows, k))
    sizes = [r["n"] for r in points.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()]
    found = None
    for n in sizes:
        mine = _nearest(points.where(F.size("embedding") == n), rows.where(F.size("embedding") == n), k, every, pivots, prefix, posted, probed, reranked, least, file_rows, sample)
        found = mine if found is None else found.unionByName(mine)
    if found is None:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.select("query_id", "vec_id", "score", F.row_number().over(by_query).alias("rank")).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


PROBES = "query_id long, pivot int, x binary, perm binary, bar int"


def _nearest(points: DataFrame, rows: DataFrame, k, every, pivots, prefix, posted, probed, reranked, least, file_rows, sample) -> DataFrame:
    count = points.count()
    n_pivots = power_of_two(count * posted / file_rows, *pivots)
    seen = drawn(points, n_pivots + sample)
    axes, rest = seen[:n_pivots], seen[n_pivots:]
    # A pivot is its own nearest one, and so no example of a row; only tiny tables have no others.
    rest = rest if len(rest) >= 2 * NEAR else seen
    orders_of_sample = permutations(rest, axes, prefix)
    share = min(1.0, max(reranked, least / max(1, count)))
    kind = np.dtype("<f4" if "float" in dict(points.dtypes)["embedding"] else "<f8")
    prefix, posted, probed = (min(n, len(axes)) for n in (prefix, posted, probed))

    def matrix(column) -> np.ndarray:
        return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1).astype(kind)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            perm = permutations(x.astype(np.float64), axes, prefix)
            row = np.repeat(np.arange(len(x)), posted)
            bytes_of = [v.tobytes() for v in x]
            orders = [p.tobytes() for p in perm.astype("<u2")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(perm[:, :posted].ravel().astype(np.int32)), pa.array([bytes_of[i] for i in row], pa.binary()), pa.array([orders[i] for i in row], pa.binary()), batch.column(1).take(pa.array(row))],
                names=["pivot", "x", "perm", "ids"],
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            for at in range(0, len(x), QUERIES):  # all pivots in order: few queries at a time
                ids, some = batch.column(0).slice(at, QUERIES), x[at : at + QUERIES]
                perm = permutations(some.astype(np.float64), axes, len(axes))
                bar = bars(some, perm[:, :prefix], rest, orders_of_sample, share)
                files = probe_counts(some, perm, rest, orders_of_sample, posted, probed)
                row = np.repeat(np.arange(len(some)), files)
                bytes_of, orders = [v.tobytes() for v in some], [p.tobytes() for p in perm[:, : max(prefix, probed)].astype("<u2")]
                pivot = np.concatenate([p[:n] for p, n in zip(perm, files)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(pivot), pa.array([bytes_of[i] for i in row], pa.binary()), pa.array([orders[i] for i in row], pa.binary()), pa.array(bar[row])],
                    names=["query_id", "pivot", "x", "perm", "bar"],
                )

    def numbers(column, of) -> np.ndarray:
        return np.frombuffer(b"".join(column), of).reshape(len(column), -1)

    def local(queries: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(mine):
            x, q = numbers(mine["x"], kind).astype(np.float64), numbers(queries["x"], kind).astype(np.float64)
            file = int(mine["pivot"].iloc[0]), x, numbers(mine["perm"], "<u2"), list(mine["ids"])
            found, _ = search_file(*file, queries["query_id"].tolist(), q, numbers(queries["perm"], "<u2"), queries["bar"].to_numpy(), posted, probed, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    postings = points.select("embedding", "ids").mapInArrow(post, "pivot int, x binary, perm binary, ids array<long>")
    probes = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding").mapInArrow(probe, PROBES)
    large = cut(postings.groupBy("pivot").count().where(F.col("count") > file_rows).select("pivot", F.ceil(F.col("count") / file_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    postings = postings.join(large, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("x"), parts).cast("int"))
    probes = probes.join(large, "pivot", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return probes.groupBy("pivot", "part").cogroup(postings.groupBy("pivot", "part")).applyInPandas(local, "query_id long, vec_id long, score double")
