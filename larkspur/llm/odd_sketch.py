"""MinHash near-duplicates: odd sketches tell which banded candidates to confirm on whole sets.

A document's set is its distinct three-word shingles (A-Z lower-cased). ``SAMPLES`` MinHash
samples make its signature; of these, ``BANDS`` bands of ``ROWS`` samples are the buckets in
which candidates meet, and all of them fold into an odd sketch: every sample flips one bit of
``BITS``. Where two signatures agree flips cancel, so the exclusive or of two sketches has few
bits for similar sets, and far more precisely so than a count of equal bands. A candidate goes
if its sketches differ in more bits than a pair at the threshold ever would (``most_bits``),
or if its sets' sizes alone rule it out. Sampling leaves families whose members are all just
under the threshold undecided, so a second odd sketch, of the set itself, looks closer: as a
shingle that two sets share flips a bit twice, no more bits differ than shingles do, and a pair
with more of them than a link may have is out without any doubt. (Of sets above ``WHOLE_SET``
shingles it holds every 2nd, 4th ... by hash, with ``SIGMAS`` standard deviations allowed.)
What is left is confirmed on the whole sets.

A pair at the threshold misses all bands in 4 cases of 10**7, and the sampled sketch drops it
in less than one of 10**6; links of documents that are more alike are missed more rarely still.

Only distinct texts are compared. Buckets report no pairs of all their members:

1. each member meets the least member of each of its buckets, a star;
2. in buckets whose members the confirmed stars left in several components, each member meets
   the one of another component whose sketch is nearest;
3. what is still apart in such a bucket, and not ruled out by its sketches, meets.

After each step the confirmed links become components. No pair that could still join two
components is left out, and in a family of copies nearly all pairs are decided by step 1.
Buckets above ``BUCKET_LIMIT`` members become pairs of chunks for steps 2 and 3.

Texts move to the pairs that need them, each text once a task at most, so a text that a third
of all documents share counts as one; a member of many pairs is an uneven join, which the
runtime splits.

Defined cases: one or two words are one shingle; texts without words, or null, have an empty
set, are their own component and are kept; equal texts are linked; repeated rows share a
component; a null id never names a component unless it has no other, and is then kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, table_of
from .common import cut, filter_of, passes, power_of_two
from .simhash import SALTS, components, split_hot

SHINGLE = 3
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
SAMPLES = 256
BANDS, ROWS = 20, 4
BITS = 512
#: The sketch of the set itself, and shingles up to which it holds them all.
WHOLE_BITS = 1024
WHOLE_SET = 4096
#: Standard deviations beyond the mean of a pair at the threshold.
SIGMAS = 5
BUCKET_LIMIT = 8192
#: Bucket rows of a task, about; pairs of sketches compared in one step; shingles hashed in one.
GROUP_ROWS = 50_000
STEP = 1 << 20
BLOCK = 1024
#: What a comparison of two nodes needs of each.
MARKS = ("n", "level", "sketch", "whole")


@cache
def family() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and offsets of the samples, and the salts of their flips."""
    rng = np.random.default_rng(7)
    draw = lambda: rng.integers(0, 1 << 32, SAMPLES, np.uint32)
    return draw() | np.uint32(1), draw(), draw()


def most_bits(percent: int = PERCENT) -> int:
    """Differing bits of two sketches that a pair at the threshold does not exceed.

    Differing samples are binomial, each flips two bits, and a bit is odd with the chance that
    random flips give it; both variances add up.
    """
    apart = 1 - percent / 100
    mean = SAMPLES * apart
    decay = exp(-4 * mean / BITS)
    of_samples = 2 * decay * sqrt(SAMPLES * apart * (1 - apart))
    of_flips = sqrt(BITS * (1 - decay * decay) / 4)
    return int(BITS * (1 - decay) / 2 + SIGMAS * sqrt(of_samples**2 + of_flips**2))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    x = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set; it is hashed in blocks, so a long text needs no more memory."""
    a, b, _ = family()
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), BLOCK):
        values = short[i : i + BLOCK, None] * a
        values += b
        np.minimum(least, values.min(axis=0), out=least)
    return least


def sketches(least: np.ndarray) -> np.ndarray:
    """Odd sketches (BITS / 64 words a row) of rows of samples."""
    salt = family()[2]
    flips = ((least ^ salt) * np.uint32(0x9E3779B1) >> np.uint32(32 - (BITS - 1).bit_length())).astype(np.int64)
    n = len(least)
    odd = np.bincount((np.arange(n)[:, None] * BITS + flips).ravel(), minlength=n * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1, bitorder="little").view("<u8")


def level_of(n: int) -> int:
    """Of sets of ``n`` shingles every 2**level-th is in the sketch of the set."""
    return max(0, (max(n, 1) - 1).bit_length() - (WHOLE_SET - 1).bit_length())


def whole_sketch(found: np.ndarray) -> np.ndarray:
    """The odd sketch of a set itself."""
    level = level_of(len(found))
    kept = found[(found & np.uint64((1 << level) - 1)) == 0] >> np.uint64(20)
    odd = np.bincount((kept & np.uint64(WHOLE_BITS - 1)).astype(np.int64), minlength=WHOLE_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row, the band's number included."""
    rows = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ rows[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def key_of(text: Column) -> Column:
    """A text's identity, 128 bits; null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key, n (set size), level, sketch, whole and bands, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, least = np.zeros(batch.num_rows, np.int64), np.full((batch.num_rows, SAMPLES), 0xFFFFFFFF, np.uint32)
            whole = np.zeros((batch.num_rows, WHOLE_BITS // 64), "<u8")
            for i, text in enumerate(batch.column(2)):
                found = shingles(text.as_py())
                sizes[i] = len(found)
                least[i] = samples(found)
                whole[i] = whole_sketch(found)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (sketches(least), whole, bands(least))]
            levels = pa.array([level_of(int(n)) for n in sizes], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), levels, *lists], names=["doc_id", "key", "n", "level", "sketch", "whole", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), key_of(F.col("text")).alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, key binary, n long, level int, sketch array<long>, whole array<long>, bands array<long>")


def differing(a: Column, b: Column, bits: int) -> Column:
    total = F.lit(0)
    for i in range(bits // 64):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def apart_at_most(both, percent: int):
    """Shingles that two linked sets of ``both`` shingles together do not share, at most."""
    return both * (100 - percent) / (100 + percent)


def possible(pairs: DataFrame, nodes: DataFrame, most: int, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    left, right = (nodes.select(F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in MARKS]) for c in "ab")
    met = pairs.join(right, "b").join(left, "a")
    allowed = apart_at_most(F.col("n_a") + F.col("n_b"), percent) / F.pow(F.lit(2.0), "level_a")
    allowed = allowed + F.when(F.col("level_a") > 0, SIGMAS * F.sqrt(allowed)).otherwise(0)
    fine = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    fine &= differing(F.col("sketch_a"), F.col("sketch_b"), BITS) <= most
    fine &= (F.col("level_a") != F.col("level_b")) | (differing(F.col("whole_a"), F.col("whole_b"), WHOLE_BITS) <= allowed)
    return met.where(fine).select("a", "b")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of the texts of ``keys``, each once.

    A filter of fixed size keeps most others where they are, and copies end before they are dealt.
    """
    wanted = filter_of(keys.select(F.xxhash64("key").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            near = passes(wanted, batch.column(2).to_numpy().view(np.uint64))
            keep = []
            for i in np.flatnonzero(near).tolist():
                key = batch.column(0)[i].as_py()
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int32()))

    rows = docs.where("text is not null").select(key_of(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    few = rows.select("key", "text", F.xxhash64("key").alias("h")).mapInArrow(run, "key binary, text string")
    return few.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    keys = cut(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    texts = table_of(texts_of(docs, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for i, (a, text_a, text_b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3))):
                if a != last:  # pairs of one text mostly come together
                    last, mine = a, shingles(text_a.as_py())
                other = shingles(text_b.as_py())
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield batch.select([0, 2]).take(pa.array(keep, pa.int32()))

    met = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    met = met.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return met.select("a", "text_a", "b", "text_b").mapInArrow(run, "a binary, b binary")


def apart(comps: np.ndarray, sizes: np.ndarray, levels: np.ndarray, sketch: np.ndarray, whole: np.ndarray, most: int, nearest: bool, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of one bucket's possible pairs in different components: all, or each member's nearest.

    Members of the bucket's largest component are not compared with each other.
    """
    n = len(comps)
    largest = comps == np.bincount(comps).argmax()
    others = np.flatnonzero(~largest)
    rows = max(1, STEP // max(n, 1))
    for at in range(0, len(others), rows):
        here = others[at : at + rows]
        fine = comps[here][:, None] != comps[None, :]
        if not nearest:  # each pair once
            fine &= largest[None, :] | (here[:, None] < np.arange(n)[None, :])
        fine &= 100 * np.minimum(sizes[here][:, None], sizes[None, :]) >= percent * np.maximum(sizes[here][:, None], sizes[None, :])
        i, j = np.nonzero(fine)
        i = here[i]
        keep = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
        i, j = i[keep], j[keep]
        bits = np.bitwise_count(whole[i] ^ whole[j]).sum(axis=1, dtype=np.int64)
        allowed = apart_at_most(sizes[i] + sizes[j], percent) / 2.0 ** levels[i]
        allowed += np.where(levels[i] > 0, SIGMAS * np.sqrt(allowed), 0)
        keep = (levels[i] != levels[j]) | (bits <= allowed)
        i, j, bits = i[keep], j[keep], bits[keep]
        if nearest:
            order = np.lexsort((bits, i))
            i, j = i[order], j[order]
            first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
            i, j = i[first], j[first]
        yield i, j


def open_pairs(nodes: DataFrame, banded: DataFrame, named: DataFrame, most: int, nearest: bool, limit: int, percent: int = PERCENT) -> DataFrame:
    """Possible pairs (a, b) across components, from buckets that hold more than one."""
    rows = banded.join(named, "key").withColumnRenamed("comp", "c")
    mixed = rows.groupBy("band").agg(F.count("*").alias("count"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    mixed = cut(mixed.select(F.lit(0).cast("long").alias("t"), F.col("band").alias("key"), "count"))
    members = banded.join(mixed.select(F.col("key").alias("band")), "band", "left_semi").join(named, "key").join(nodes.select("key", *MARKS), "key")
    dealt = split_hot(members.select(F.col("key").alias("fp"), F.lit(0).cast("long").alias("t"), F.col("band").alias("key"), "comp", *MARKS), mixed, limit)
    groups = power_of_two((mixed.agg(F.sum("count")).first()[0] or 0) / GROUP_ROWS, 32, 1 << 40)

    def run(pdf):
        import pandas as pd

        a, b = [], []
        for _, g in pdf.groupby(["t", "key"], sort=False):
            keys = g["fp"].to_numpy()
            names = np.unique(g["comp"].to_numpy(), return_inverse=True)[1]
            sketch, whole = (np.stack(g[c].to_numpy()).astype(np.int64).view(np.uint64) for c in ("sketch", "whole"))
            for i, j in apart(names, g["n"].to_numpy(), g["level"].to_numpy(), sketch, whole, most, nearest, percent):
                a += [min(x, y) for x, y in zip(keys[i], keys[j])]
                b += [max(x, y) for x, y in zip(keys[i], keys[j])]
        return pd.DataFrame({"a": a, "b": b})

    return dealt.withColumn("g", F.pmod(F.xxhash64("t", "key"), F.lit(groups))).groupBy("g").applyInPandas(run, "a binary, b binary").distinct()


def with_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key and comp, the least key that it reaches, of every node."""
    found = components(links)
    return nodes.select("key").join(found.withColumnsRenamed({"node": "key", "root": "comp"}), "key", "left").select("key", F.coalesce("comp", "key").alias("comp"))


def joined_components(named: DataFrame, links: DataFrame) -> DataFrame | None:
    """``named`` after more links, of which only those between components count; None if there is none."""
    ends = (named.select(F.col("key").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
    between = links
    for end, c in zip(ends, "ab"):
        between = between.join(end, c)
    between = cut(between.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if between.isEmpty():
        return None
    found = components(between).withColumnsRenamed({"node": "comp", "root": "top"})
    return named.join(found, "comp", "left").select("key", F.coalesce("top", "comp").alias("comp"))


def groups(docs: DataFrame, percent: int = PERCENT, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept."""
    most = most_bits(percent)
    rows = cut(signed_rows(docs))
    nodes = cut(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in (*MARKS, "bands")]))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("key").alias("a"), F.count("*").alias("count")).where("count > 1").drop("count")
    stars = banded.join(least, "band").where("key <> a").select("a", F.col("key").alias("b")).distinct()
    tried = cut(possible(stars, nodes, most, percent))
    named = cut(with_components(nodes, cut(confirmed(tried, docs, percent))))
    for nearest in (True, False):
        release(docs.sparkSession)
        pairs = cut(open_pairs(nodes, banded, named, most, nearest, limit, percent).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        more = joined_components(named, confirmed(pairs, docs, percent))
        named = cut(more) if more is not None else named
    # A component may hold a third of all texts: they meet its name under several keys.
    rooted = nodes.select("key", "first").join(named, "key")
    salted = rooted.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    names = rooted.groupBy("comp").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = salted.join(names, ["comp", "salt"]).select("key", "component_id")
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles")).join(known, "key", "left")
    named_row = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", named_row.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
