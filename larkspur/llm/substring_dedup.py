"""Substring deduplication by rolling hashes of every fixed-length word window.

Each word has a 64-bit hash; a window's hash is the polynomial of its words' hashes
modulo 2**64 (Rabin-Karp, rolled by prefix sums), mixed at the end. A window is
removed if an equal one starts earlier: in a smaller doc_id, or in the same
document further left. What removed windows cover merges into maximal intervals.

Windows never travel as rows. A task hashes a batch of documents and keeps the
first occurrence of each hash in it (the others are decided on the spot), so a
passage that a third of all documents share leaves a task once. What is left goes
out as sorted, byte-sliced, compressed blocks, one per hash bucket. A bucket's task
merges its blocks, counts occurrences over all batches, and sends the removed
starts, again as blocks, to the documents' buckets. There they meet the texts.
The numbers of buckets follow the size of the texts, without a bound, so a task's share
does not grow. A batch dealt to very many buckets would make blocks of a few windows each,
which cost more than the windows in them. Beyond ``ONE_LEVEL`` buckets it is dealt to ``COARSE``
ranges of them, and what some tasks send to a range is put together, first occurrences again
being kept alone, before it is dealt to the range's buckets. So a window moves twice, but in
blocks of hundreds whatever the size.

Two windows are equal if 88 bits of two independent rolling hashes are: among n distinct
windows about n**2 / 2**89 pairs collide, one in six chances of a single pair in 10**13
windows.

Defined cases: null texts have no words; texts shorter than a window lose nothing; null
ids come after all others (below 2**62), by a hash of their texts; rows of one id and one
text are one document, so a repeated row loses and keeps what its twin does; rows of one
id with different texts are different documents, ordered by a 32-bit hash of their texts; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, power_of_two

WINDOW = 20
#: Words hashed together in a task; text bytes per hash bucket and per document bucket.
BATCH_WORDS = 1_200_000
HASH_BUCKET_BYTES = 16_000_000
DOC_BUCKET_BYTES = 8_000_000
#: Hash buckets up to which batches are dealt to them at once, and ranges of buckets beyond.
ONE_LEVEL = 1 << 14
COARSE = 1 << 11
#: Bytes of text for each word, at least, when windows are estimated.
WORD_BYTES = 6
#: Texts that are compressed and sent together.
SENT_ROWS = 2048
BASE = 0x9E3779B97F4A7C15 | 1
MODULUS = 1 << 64
WORDS = re.compile(WORD)
#: Documents without an id are ordered from here on.
NO_ID = 1 << 62


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def key_of(doc_id: int | None, text: str | bytes) -> int:
    """Where a document comes in the order; those without an id last, by their texts' hashes."""
    return NO_ID + (xxhash.xxh3_64_intdigest(text) >> 2) if doc_id is None else doc_id


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0..n-1."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, MODULUS), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_hash(text: str | bytes | None) -> int:
    """32 bits that tell apart the texts of one id."""
    return xxhash.xxh3_64_intdigest(text or b"", 1) >> 32


def word_hashes(words: list[str]) -> np.ndarray:
    """128 bits of each word, as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), "<u8").reshape(-1, 2)


def rolled(h: np.ndarray, window: int) -> np.ndarray:
    """The mixed polynomial hash of each ``window`` consecutive word hashes."""
    up, down = powers(1 << max(12, len(h).bit_length()))
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=prefix[1:])
    x = (prefix[window:] - prefix[:-window]) * down[: len(h) - window + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(words: list[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """64 and another 24 bits for each start of ``window`` consecutive words."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    h = word_hashes(words)
    return rolled(np.ascontiguousarray(h[:, 0]), window), (rolled(np.ascontiguousarray(h[:, 1]), window) >> np.uint64(40)).astype(np.uint32)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as byte planes, those of the high, mostly empty bytes compressing to nothing."""
    values = np.ascontiguousarray(values.astype("<u8"))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(block: bytes) -> np.ndarray:
    n = int.from_bytes(block[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:], max_output_size=8 * n + 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of consecutive values modulo 2**64; ``np.cumsum`` undoes it."""
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0))


BLOCK = "bucket long, hashes binary, tags binary, docs binary, texts binary, places binary, gone_docs binary, gone_texts binary, gone_starts binary"


def blocks_of(ids: list[int], texts: list[int], hashes: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple]:
    """The blocks of one batch, whose documents (id, hash of the text) are in order."""
    h, tag = np.concatenate([x for x, _ in hashes]), np.concatenate([x for _, x in hashes])
    lengths = [len(x) for x, _ in hashes]
    known_doc, known_text = np.array(ids, np.int64).view(np.uint64), np.array(texts, np.uint32)
    doc = np.repeat(np.arange(len(ids)), lengths)
    start = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
    order = np.argsort(h, kind="stable")  # equal hashes stay in order of document and start
    return dealt(h[order], tag[order], doc[order], start[order], known_doc, known_text, buckets)


def dealt(h: np.ndarray, tag: np.ndarray, doc: np.ndarray, start: np.ndarray, known_doc: np.ndarray, known_text: np.ndarray, buckets: int) -> Iterator[tuple]:
    """The blocks of windows ordered by hash; ``doc`` is the document's place among the known ones."""
    # Equal hashes of unequal windows only lose their neighbourhood here: the bucket's task looks again.
    first = np.r_[True, (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])]
    here = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    later = (known_doc[doc] != known_doc[doc[here]]) | (known_text[doc] != known_text[doc[here]]) | (start != start[here])  # a repeated row's window is no later than itself
    shift = np.uint64(64 - buckets.bit_length() + 1)
    bucket = (h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
    bounds = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        f, lost = np.arange(a, b)[first[a:b]], np.arange(a, b)[later[a:b]]
        used, place = np.unique(doc[f], return_inverse=True)
        yield (
            int(bucket[a]), squeeze(steps(h[f])), squeeze(tag[f]), squeeze(steps(known_doc[used])), squeeze(known_text[used]), squeeze((place.astype(np.uint64) << np.uint64(32)) | start[f]),
            *starts_by_document(known_doc[doc[lost]], known_text[doc[lost]], start[lost]),
        )


def read_blocks(pdf) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(hash, tag, document, text, start) of the windows of blocks, and (document, text, start) of the starts that are gone."""
    kept, gone = [], []
    for row in pdf.itertuples(index=False):
        gone.append(documents_of(row.gone_docs, row.gone_texts, row.gone_starts))
        packed = expand(row.places)
        place = (packed >> np.uint64(32)).astype(np.int64)
        h, tag = np.cumsum(expand(row.hashes)).astype(np.uint64), expand(row.tags).astype(np.uint32)
        doc, text = np.cumsum(expand(row.docs)).astype(np.uint64)[place], expand(row.texts).astype(np.uint32)[place]
        kept.append((h, tag, doc, text, (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
    return [np.concatenate(x) for x in zip(*kept)], [np.concatenate(x) for x in zip(*gone)]


def deal_again(pdf, buckets: int):
    """The blocks of a range of buckets put together, first occurrences kept, and dealt to its buckets."""
    import pandas as pd

    (h, tag, doc, text, start), gone = read_blocks(pdf)
    order = np.lexsort((text, doc.view(np.int64)))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (text[order][1:] != text[order][:-1])]
    which = np.empty(len(doc), np.int64)
    which[order] = np.cumsum(new) - 1
    known_doc, known_text = doc[order][new], text[order][new]
    order = np.lexsort((start, which, tag, h))
    out = [list(block) for block in dealt(h[order], tag[order], which[order], start[order], known_doc, known_text, buckets)]
    # Starts that are gone already have no hash any more; they go with any of the blocks, not always the first.
    carrier = out[int(pdf["salt"].iloc[0]) % len(out)]
    more = documents_of(*carrier[6:])
    carrier[6:] = starts_by_document(*(np.concatenate(x) for x in zip(more, gone)))
    return pd.DataFrame(out, columns=[x.split()[0] for x in BLOCK.split(", ")])


def starts_by_document(doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    order = np.lexsort((start, text, doc))
    return squeeze(steps(doc[order])), squeeze(text[order]), squeeze(start[order])


def documents_of(docs: bytes, texts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(expand(docs)).astype(np.uint64), expand(texts).astype(np.uint32), expand(starts).astype(np.uint32)


def _hash_batches(window: int, buckets: int, batch_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            held.sort(key=lambda x: x[:2])
            rows = blocks_of([i for i, *_ in held], [t for _, t, _ in held], [x for *_, x in held], buckets)
            kinds = [pa.int64()] + [pa.binary()] * 8
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                x = window_hashes(words_of(text), window)
                if len(x[0]):
                    held.append((key_of(doc_id, text), text_hash(text) if shared else 0, x))
                    size += len(x[0])
                    if size >= batch_words:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def _merge(pdf, dests: int):
    """Of all blocks of a hash bucket: the starts to remove, as blocks by document bucket."""
    import pandas as pd

    gone, hashes, tags, docs, texts, starts = [], [], [], [], [], []
    for row in pdf.itertuples(index=False):
        gone.append(documents_of(row.gone_docs, row.gone_texts, row.gone_starts))
        packed = expand(row.places)
        place = (packed >> np.uint64(32)).astype(np.int64)
        hashes.append(np.cumsum(expand(row.hashes)).astype(np.uint64))
        tags.append(expand(row.tags).astype(np.uint32))
        docs.append(np.cumsum(expand(row.docs)).astype(np.uint64)[place])
        texts.append(expand(row.texts).astype(np.uint32)[place])
        starts.append((packed & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    same = np.r_[False, h[order][1:] == h[order][:-1]]
    order = order[same | np.r_[same[1:], False][: len(same)]]
    h = h[order]
    hashes.clear()
    tag, d, t, s = (np.concatenate(x)[order] for x in (tags, docs, texts, starts))
    tags.clear(), docs.clear(), texts.clear(), starts.clear()
    inside = np.lexsort((s, t, d.view(np.int64), tag, h))
    h, tag, d, t, s = h[inside], tag[inside], d[inside], t[inside], s[inside]
    new = np.r_[True, (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])][: len(h)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = (d != d[first]) | (t != t[first]) | (s != s[first])
    d, t, s = (np.concatenate([x[later], *(g[i] for g in gone)]) for i, x in enumerate((d, t, s)))
    dest = dest_of(d, t, dests)
    order = np.argsort(dest, kind="stable")
    d, t, s, dest = d[order], t[order], s[order], dest[order]
    bounds = np.r_[np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]][: len(dest)]), len(dest)]
    out = [(int(dest[a]), *starts_by_document(d[a:b], t[a:b], s[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
    return pd.DataFrame(out, columns=["dest", "gone_docs", "gone_texts", "gone_starts"])


def dest_of(doc: np.ndarray, text: np.ndarray, dests: int) -> np.ndarray:
    x = (doc.astype(np.uint64) ^ (text.astype(np.uint64) << np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(24)) % np.uint64(dests)).astype(np.int64)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Maximal intervals (begin, end) of words that the windows at ``starts`` cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    starts = np.unique(starts.astype(np.int64))
    breaks = np.flatnonzero(np.diff(starts) > window)
    return np.c_[starts[np.r_[0, breaks + 1]], starts[np.r_[breaks, len(starts) - 1]] + window]


def documents_in(sent) -> Iterator[tuple[int, bool, int, str]]:
    """(key, whether the id is null, hash of the text, text) of the documents of a bucket."""
    for row in sent.itertuples(index=False):
        whole, at = zstandard.ZstdDecompressor().decompress(row.packed, max_output_size=int(sum(row.sizes))) if sum(row.sizes) else b"", 0
        for doc_id, is_null, which, size in zip(row.id, row.no_id, row.which, row.sizes):
            yield int(doc_id), bool(is_null), int(which), whole[at : at + size].decode("utf-8", "surrogatepass")
            at += size


def _apply(window: int):
    """Texts of a document bucket against the starts to remove in them."""
    import pandas as pd

    def run(left, right):
        if not len(left):
            return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "intervals": []})
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        for r in right.itertuples(index=False):
            doc, text, start = documents_of(r.gone_docs, r.gone_texts, r.gone_starts)
            new = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])][: len(doc)]
            for a, b in zip(np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(doc)]):
                starts.setdefault((int(doc[a].view(np.int64)), int(text[a])), []).append(start[a:b])
        out = []
        for doc_id, is_null, which, text in documents_in(left):
            words = words_of(text)
            mine = np.concatenate(starts.get((doc_id, which), [np.empty(0, np.uint32)]))
            spans = covered(mine, len(words), window)
            kept, at = [], 0
            for s, e in spans:
                kept += words[at:s]
                at = e
            kept += words[at:]
            out.append((None if is_null else doc_id, len(words), len(words) - len(kept), " ".join(kept), [(int(s), int(e)) for s, e in spans]))
        table = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "intervals"])
        table["doc_id"] = table["doc_id"].astype("Int64")
        table["intervals"] = [[{"begin": s, "end": e} for s, e in x] for x in table["intervals"]]
        return table

    return run


def dedup(docs: DataFrame, window: int = WINDOW, batch_words: int = BATCH_WORDS, one_level: int = ONE_LEVEL, coarse: int = COARSE) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words joined by a space), intervals."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Only where an id has several texts do their hashes travel.
    hashed = texts.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = cut(hashed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("doc_id"))
    texts = texts.withColumn("shared", F.lit(False)) if several.isEmpty() else texts.join(several.withColumn("shared", F.lit(True)), "doc_id", "left")
    buckets = power_of_two(size / HASH_BUCKET_BYTES, 16, 1 << 48)
    dests = power_of_two(size / DOC_BUCKET_BYTES, 16, 1 << 39)
    if buckets <= one_level:
        blocks = texts.mapInArrow(_hash_batches(window, buckets, batch_words), BLOCK)
    else:
        # What a task sends goes one way whatever its batches are, so that it may be run again.
        salts = 1 + int(size / WORD_BYTES / batch_words / coarse)
        ranges = texts.mapInArrow(_hash_batches(window, coarse, batch_words), BLOCK).withColumn("salt", F.spark_partition_id() % salts)
        blocks = ranges.groupBy("bucket", "salt").applyInPandas(lambda pdf: deal_again(pdf, buckets), BLOCK)
    gone = blocks.groupBy("bucket").applyInPandas(lambda pdf: _merge(pdf, dests), "dest long, gone_docs binary, gone_texts binary, gone_starts binary")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        for batch in (whole.slice(at, SENT_ROWS) for whole in batches for at in range(0, whole.num_rows, SENT_ROWS)):
            known = batch.column(0).to_pylist()
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            ids = [key_of(i, t) for i, t in zip(known, raw)]
            which = [text_hash(t) if shared else 0 for t, shared in zip(raw, batch.column(2).to_pylist())]
            dest = dest_of(np.array(ids, np.int64).view(np.uint64), np.array(which, np.uint32), dests)
            order = np.argsort(dest, kind="stable")
            bounds = np.r_[np.flatnonzero(np.diff(dest[order], prepend=-1)), len(dest)] if len(dest) else [0]
            # The texts of a batch that go the same way are compressed together.
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                mine = order[a:b].tolist()
                out.append((int(dest[mine[0]]), [ids[i] for i in mine], [which[i] for i in mine], [known[i] is None for i in mine], [len(raw[i]) for i in mine], pack(b"".join(raw[i] for i in mine))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=["dest", "id", "which", "no_id", "sizes", "packed"])

    sent = texts.mapInArrow(send, "dest long, id array<long>, which array<long>, no_id array<boolean>, sizes array<long>, packed binary")
    return sent.groupBy("dest").cogroup(gone.groupBy("dest")).applyInPandas(_apply(window), "doc_id long, n_words long, n_removed long, kept string, intervals array<struct<begin:long,end:long>>")


def brute_force(rows: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The result by definition, for tests: doc_id to (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
