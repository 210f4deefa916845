"""Best-fit packing planned over the length histogram.

Documents become token pieces of at most ``capacity`` ids. The driver sees only
the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus)
and runs best-fit decreasing over counts: bins with equal contents are one group,
so a step handles all documents of a length at once. The plan is a list of runs
"ranks lo..hi of length l go to these sequences at this offset". Pieces then get a
rank within their length and take their planned slot by a join on length and rank.

A plan has at most three groups per length, and a group at most as many runs as
distinct lengths fit a sequence (44 for 1024), so for a capacity of 1024 the
broadcast runs stay under 140,000 small rows at any corpus size.

Ranks do not come from one window per length: pieces are numbered where they are made and
written once with their numbers, fall into buckets by a hash of these, bucket counts give
each bucket its first rank, and windows run inside buckets. Each length has buckets by its own
number of pieces: full pieces, which most ids are in, have many small ones, so that no task
gets several large ones. Neither ids nor texts decide the bucket, so rows without an id and
copies spread like any others.

Defined cases: a null text is empty and becomes the end id alone; very long texts
are cut, the first piece being the shorter one; rows repeated in the input are
packed as often as they occur; null ids are kept; an empty table packs to nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest_ids, power_of_two

CAPACITY = 1024
END_ID = 2
#: Pieces of one length in one rank bucket, about; with the ids of a full piece, 8 MB.
BUCKET_ROWS = 2_000
#: Ids held back before an Arrow batch goes out.
BATCH_IDS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Characters whose classes (letter, number, space) no Unicode revision has changed:
#: for such texts the rank-file tokenizer gives the same ids, four times as fast.
SETTLED = re.compile(r"[\x00-ſ‐-‧‰-⁞€™]*")
#: The quick library's splitting pattern backtracks on white space, up to a stack's depth.
BLANK = 10_000
LONG_BLANK = re.compile(rf"\s{{{BLANK}}}")


class Encoder:
    """Ids of a text under a byte-level BPE vocabulary file of ``tokenizers``.

    With ``ranks`` (the same vocabulary as a rank file) and its split ``pattern``,
    texts of settled characters without endless white space take the quicker library;
    the ids are equal, which the tests hold. Any other text, and any that holds an added
    token of the vocabulary (such as ``<|endoftext|>``), goes to ``tokenizers``, which
    is kept only from the first such text on.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path = path
        added = [re.escape(t.content) for t in self.load().get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.I)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("settled", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def load(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def slow(self):
        return self.load()

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and SETTLED.fullmatch(text) and not self.added.search(text) and not (len(text) >= BLANK and LONG_BLANK.search(text)):
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(*paths) -> Encoder:
    """One per worker process and vocabulary."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def public_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; only the first may be short."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def tokenise(docs: DataFrame, vocabulary=None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids (little-endian uint32)."""
    paths = tuple(vocabulary or public_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, piece, start, length, ids[start : start + length].tobytes()))
                held += len(ids)
                if held >= BATCH_IDS:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Runs (length, lo, hi, first sequence, items in each, offset) of best-fit decreasing.

    ``histogram``: pieces by length. Bins are held as groups of equal contents:
    ``open_bins[r]`` lists [bins, contents] with r ids of room left.
    """
    open_bins: list[list] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], length
        while left:
            while room <= capacity and not open_bins[room]:
                room += 1
            if room > capacity:  # nothing open fits: new bins
                each = capacity // length
                bins, rest = divmod(left, each)
                if bins:
                    open_bins[capacity - each * length].append([bins, [(length, each)]])
                if rest:
                    open_bins[capacity - rest * length].append([1, [(length, rest)]])
                break
            bins, contents = open_bins[room].pop()
            each = room // length
            full = min(bins, left // each)
            if full:
                open_bins[room - each * length].append([full, contents + [(length, each)]])
                left -= full * each
            if full < bins:
                rest, other = left, bins - full
                if rest:
                    open_bins[room - rest * length].append([1, contents + [(length, rest)]])
                    other -= 1
                    left = 0
                if other:
                    open_bins[room].append([other, contents])
    runs, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for groups in open_bins:
        for bins, contents in groups:
            offset = 0
            for length, each in contents:
                runs.append((length, ranks[length], ranks[length] + bins * each, sequence, each, offset))
                ranks[length] += bins * each
                offset += each * length
            sequence += bins
    return runs


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more) with sequence_id and offset.

    ``pieces`` is computed once, in the shared folder.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    pieces = cut(pieces.withColumn("__row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan(histogram, capacity)
    dealt = [(length, power_of_two(n / BUCKET_ROWS, 16, 1 << 20)) for length, n in histogram.items()]
    dealt = spark.createDataFrame(dealt, "length long, __buckets long")
    salted = pieces.join(F.broadcast(dealt), "length").withColumn("__bucket", digest_ids("__row") % F.col("__buckets")).drop("__buckets")
    firsts = salted.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    firsts = firsts.withColumn("__first", F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")).drop("__n")
    inside = Window.partitionBy("length", "__bucket").orderBy("__row")
    ranked = salted.join(firsts, ["length", "__bucket"]).withColumn("__rank", F.col("__first") + F.row_number().over(inside) - 1)
    slots = spark.createDataFrame(runs, "__length long, __lo long, __hi long, __sequence long, __each long, __offset long")
    nth = F.col("__rank") - F.col("__lo")
    return (
        ranked.join(F.broadcast(slots), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
        .withColumn("sequence_id", F.col("__sequence") + F.floor(nth / F.col("__each")))
        .withColumn("offset", F.col("__offset") + nth % F.col("__each") * F.col("length"))
        .select(*columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, vocabulary=None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents in their sequences.

    With ``keep_ids`` the ids themselves travel along (column ``ids``); otherwise
    only their CRC-32 (``ids_crc32``), taken where the ids are made.
    """
    pieces = tokenise(docs, vocabulary, capacity, end_id)
    if not keep_ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign(pieces, capacity)
