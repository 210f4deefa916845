"""SimHash near-duplicates: bit-sliced comparison inside pigeonhole buckets.

Fingerprint: texts lower-cased in A-Z, four-word shingles (repeats included), each
hashed with XXH64 (seed 42); a bit is set if over half of the hashes set it.

Links: two of 64 bits' worth of fingerprints that differ in at most ``radius``
places agree on at least k - radius of k bit blocks, so every linked pair meets in
a bucket of one of the C(k, radius) block combinations. All fingerprints meet under the
least k, 5; those of buckets above ``BUCKET_LIMIT`` fingerprints, measured, meet there no
more but under the next k, whose blocks are longer together, and so on: two of one such
bucket are both dealt anew, so no pair is lost, and only they are copied more often. Buckets
that the largest k leaves above the limit are split into pairs of chunks, so no task holds
more than twice the limit of one bucket. Inside a bucket
64 fingerprints are one word per bit plane; a fingerprint meets a word by adding
the 64 xor planes into carry-save counters, and a word is abandoned as soon as all
its lanes exceed the radius. A bucket reports a spanning forest, not its pairs.

Groups: alternating large-star and small-star rounds over the forest edges, in
Spark, until nothing changes; then each document takes its fingerprint's group.
Only distinct fingerprints are compared, so exact copies cost one comparison in all.

Defined cases: a text without words, or null, has fingerprint zero, linked like
any other; one to three words are one shingle; repeated rows share a fingerprint;
a null id never names a component unless a component has no other id; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release
from .common import cut, power_of_two

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: A bucket with more fingerprints than this asks for more, shorter blocks.
BUCKET_LIMIT = 16_384
BLOCKS = (5, 6, 7, 8)
#: Bucket rows a task gets, about; and (fingerprint, word) comparisons in one step.
GROUP_ROWS = 100_000
STEP = 1 << 16
#: Keys under which a component's fingerprints meet its name.
SALTS = 32


def fingerprint(text: str | None, words_in: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) <= words_in:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-words_in]]]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words_in - 1 :])], dtype="<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes set."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_in) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits that a linked pair agrees on, in at least one of these."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def bucket_links(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions (a, b), a < b, among fingerprints of equal ``bucket`` (sorted).

    Each bucket's fingerprints fill words of 64 lanes, one word per bit plane.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[first, n])
    words = (sizes + 63) // 64
    word_first = np.r_[0, np.cumsum(words)]
    owner = np.repeat(np.arange(len(first)), sizes)
    within = np.arange(n) - first[owner]
    word_of, lane = word_first[owner] + within // 64, (within % 64).astype(np.uint64)
    base = np.zeros(word_first[-1], np.int64)  # the position that a word's lane 0 holds
    base[word_of[lane == 0]] = np.flatnonzero(lane == 0)
    filled = np.zeros(word_first[-1], np.uint64)
    np.bitwise_or.at(filled, word_of, np.uint64(1) << lane)
    planes = np.zeros((BITS, word_first[-1]), np.uint64)
    for p in range(BITS):
        on = (fps >> np.uint64(p)) & np.uint64(1)
        np.bitwise_or.at(planes[p], word_of, on << lane)
    # A fingerprint meets its own word and the later ones of its bucket.
    todo = word_first[owner + 1] - word_of
    done, until = 0, np.cumsum(todo)
    while done < n:
        stop = max(done + 1, int(np.searchsorted(until, (until[done - 1] if done else 0) + STEP, "right")))
        rows = np.repeat(np.arange(done, stop), todo[done:stop])
        run = np.arange(len(rows)) - np.repeat(until[done:stop] - todo[done:stop] - (until[done - 1] if done else 0), todo[done:stop])
        yield from compare(fps, rows, word_of[rows] + run, planes, filled, base, radius)
        done = stop


def compare(fps, rows, words, planes, filled, base, radius):
    """Carry-save counters of the differing bits of rows against all lanes of words."""
    own = base[words]
    alive = filled[words] & np.where(rows >= own + 63, np.uint64(0), ~np.uint64(0))
    here = (rows >= own) & (rows < own + 63)  # in its own word, only later lanes count
    alive = np.where(here, alive & (~np.uint64(0) << np.minimum(rows - own + 1, 63).astype(np.uint64)), alive)
    keep = alive != 0
    rows, words, alive = rows[keep], words[keep], alive[keep]
    one, two, four = (np.zeros(len(rows), np.uint64) for _ in range(3))
    for p in range(BITS):
        if not len(rows):
            return
        x = planes[p, words] ^ (np.uint64(0) - ((fps[rows] >> np.uint64(p)) & np.uint64(1)))
        c1 = one & x
        one ^= x
        c2 = two & c1
        two ^= c1
        over = four & c2
        four ^= c2
        alive &= ~over
        if p % 8 == 7:
            alive &= ~beyond(one, two, four, radius)
            keep = alive != 0
            if keep.mean() < 0.7:
                rows, words, alive, one, two, four = (v[keep] for v in (rows, words, alive, one, two, four))
    at = np.flatnonzero(alive)
    if len(at):
        bits = np.unpackbits(alive[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lanes = np.nonzero(bits)
        yield rows[at][i], base[words[at]][i] + lanes


def beyond(one, two, four, radius):
    """Lanes whose counter, of at most 7, is over ``radius``."""
    out = np.zeros_like(one)
    for value in range(radius + 1, 8):
        out |= (one if value & 1 else ~one) & (two if value & 2 else ~two) & (four if value & 4 else ~four)
    return out


def links_within(fps: np.ndarray, table: np.ndarray, mask: np.ndarray, radius: int = RADIUS):
    """Forest edges (from, to) of all buckets of one task."""
    key = fps & mask
    order = np.lexsort((fps, key, table))
    fps, key, table = fps[order], key[order], table[order]
    bucket = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (table[1:] != table[:-1])])
    a, b, held = [], [], 0
    for i, j in bucket_links(fps, bucket, radius):
        a.append(i)
        b.append(j)
        held += len(i)
        if held > 2_000_000:  # dense links shrink to a forest before more come
            root = forest(len(fps), np.concatenate(a), np.concatenate(b))
            i = np.flatnonzero(root != np.arange(len(fps)))
            a, b, held = [i], [root[i]], len(i)
    if not held:
        return fps[:0], fps[:0]
    root = forest(len(fps), np.concatenate(a), np.concatenate(b))
    i = np.flatnonzero(root != np.arange(len(fps)))
    return fps[i], fps[root[i]]


def keyed_by(distinct: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Each fingerprint under each block combination: fp, t, mask and key, the bits it must share."""
    table = [F.struct(F.lit(t).cast("long").alias("t"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(masks(blocks, radius))]
    keyed = distinct.select("fp", F.explode(F.array(*table)).alias("k"))
    return keyed.select("fp", "k.t", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))


def split_hot(keyed: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """Buckets over ``limit`` become buckets of pairs of chunks, each within twice the limit.

    A fingerprint of chunk i goes to the pair of i with every chunk, so any two meet.
    """
    hot = sizes.where(F.col("count") > limit).select(F.col("t").alias("ht"), F.col("key").alias("hk"), F.ceil(F.col("count") / limit).alias("chunks"))
    out = keyed.join(hot, (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hk")), "left").drop("ht", "hk")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j))
    parts = F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)
    out = out.withColumn("part", F.explode(parts))
    return out.withColumn("t", F.when(F.col("part") < 0, F.col("t")).otherwise(F.xxhash64("t", "part"))).drop("part", "chunks")


def link_edges(distinct: DataFrame, count: int, radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) of a forest whose components are those of all links."""
    parts, rest, rows = [], distinct, 0
    for blocks in BLOCKS:
        keyed = keyed_by(rest, blocks, radius).withColumn("t", F.col("t") + F.lit(blocks << 32))  # a table of its own
        sizes = keyed.groupBy("t", "key").count()
        large = sizes.where(F.col("count") > limit)
        rows += count * len(masks(blocks, radius))
        if large.isEmpty():
            parts.append(keyed)
            break
        large = cut(large)
        if blocks == BLOCKS[-1]:
            parts.append(split_hot(keyed, large, limit))
            break
        parts.append(keyed.join(large.select("t", "key"), ["t", "key"], "left_anti").select(*keyed.columns))
        rest = cut(keyed.join(large.select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct())
        count = rest.count()
    keyed = reduce(DataFrame.unionByName, parts)
    groups = power_of_two(rows / GROUP_ROWS, 32, 1 << 40)

    def run(pdf):
        import pandas as pd

        a, b = links_within(pdf["fp"].to_numpy().view(np.uint64), pdf["t"].to_numpy(), pdf["mask"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.withColumn("g", F.pmod(F.xxhash64("t", "key"), F.lit(groups))).groupBy("g").applyInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the least node it reaches.

    Large-star gives every larger neighbour of a node the node's least neighbour,
    small-star gives it to the smaller ones; both keep the components and a hub's
    neighbours are only ever aggregated to a minimum, never gathered.
    """
    edges = cut(edges.where("a <> b"))
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        release(edges.sparkSession)


def groups(docs: DataFrame, radius: int = RADIUS, words_in: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id."""
    marked = cut(fingerprints(docs, words_in))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(link_edges(distinct, distinct.count(), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # A component may hold a third of all fingerprints: they meet its name under several keys.
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = names.join(found.select("root").distinct(), "root").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    named = salted.join(linked, ["root", "salt"], "left").select("fp", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, words_in: int = SHINGLE) -> DataFrame:
    """One document of each group: the one of the smallest id; repeated rows once.

    Documents without an id go only if another row without one has the same text.
    """
    extra = groups(docs, radius, words_in).where("doc_id <> component_id").select(F.col("doc_id").cast("string").alias("__key")).distinct()
    # Documents without an id go by their texts, so they spread. The window keeps the join's dealing.
    text = F.xxhash64("text")
    keyed = docs.withColumns({"__text": text, "__key": F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text.cast("string")))})
    left = keyed.join(extra, "__key", "left_anti")
    same = Window.partitionBy("__key", "__text").orderBy(F.lit(0))
    return left.withColumn("__nth", F.row_number().over(same)).where("__nth = 1").select(*docs.columns)
