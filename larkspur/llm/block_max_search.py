"""Ranked lexical search: variable-block-max WAND over shards of documents.

One pass over the texts keeps of each document its length and the frequencies of the terms
that queries ask for (a Bloom filter of fixed size, made of the queries' terms, tells most
others). Counts of documents and terms, and the document frequency of each asked term, come
from that slim table; with them a posting's contribution to a score is known exactly.

Documents are dealt evenly to shards, ``SHARD_DOCS`` each, so the work of a task stays the
same at any size. A shard's task makes posting lists, and cuts each list into blocks by
dynamic programming: block ends are chosen so that the sum of (block maximum - contribution)
over its postings, plus a price for each block, is least. A query lays the blocks of its
terms over each other: where they overlap, the sum of their maxima bounds every document's
score, which is WAND's pivot test, made for all stretches between two block ends at once.
Stretches are looked at in the order of their bounds; a query ends when the next bound is
under the k-th best score so far, and everything under it has been skipped exactly.

A first part of the shards yields each query's k-th score, from which the other shards
start, so they return a few rows. Shards and blocks of queries meet in a cogroup: queries are
never broadcast, and the k best of each shard are merged by a window that is limited before
its shuffle.

Defined cases: a null or empty text has no terms and takes part in nothing; every row is a
document, rows of one id too; documents without an id come after others of the same score;
rows of one item id are one query, with the terms of all; items without an id or without a
term that occurs get no rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filter_of, passes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
SEED = 42
SHARD_DOCS = 1 << 13
BLOCK_ITEMS = 1 << 11
#: Postings between two places where a block may end, and the most such steps in a block.
UNIT = 8
REACH = 32
#: What a block costs, in postings of the list's greatest contribution.
PRICE = 8
#: Documents looked at in a query's first step; later steps take twice as many each.
FIRST_STEP = 128
#: The part of the shards that is searched first.
FIRST_SHARDS = 16

# All but term characters become spaces, A-Z become a-z; bytes of longer characters stay.
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def lowered(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def terms_of(items: DataFrame) -> DataFrame:
    """item_id and the hashes of its terms, each once."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.select("item_id", F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    return found.select("item_id", F.xxhash64("term").alias("term")).distinct()


def counted(docs: DataFrame, wanted: bytes) -> DataFrame:
    """doc_id, n, and the asked terms (hashes) with their frequencies, of documents with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            rows, n, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
                if not words:
                    continue
                count = Counter(words)
                h = np.fromiter((digest(w, SEED) for w in count), np.uint64, len(count))
                tf = np.fromiter(count.values(), np.int32, len(count))
                keep = passes(wanted, h)
                rows.append(i)
                n.append(len(words))
                terms.append(h[keep].view(np.int64))
                tfs.append(tf[keep])
                ends.append(ends[-1] + len(terms[-1]))
            offsets = pa.array(ends, pa.int32())
            columns = [
                batch.column(0).take(pa.array(rows, pa.int32())),
                pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms) if terms else np.empty(0, np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tfs) if tfs else np.empty(0, np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<int>")


def block_ends(values: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Where blocks end in posting lists that lie one after another.

    ``lists`` has the start of each list and the end of the last. All lists go through the
    dynamic program side by side: step j settles the best cut of the first j units of each
    list that is so long.
    """
    lengths = np.diff(lists)
    units = -(-lengths // UNIT)
    first = np.r_[0, np.cumsum(units)]  # of each list's units
    owner = np.repeat(np.arange(len(lengths)), units)
    unit_at = lists[owner] + (np.arange(first[-1]) - first[owner]) * UNIT
    if not len(unit_at):
        return np.empty(0, np.int64)
    size = np.minimum(unit_at + UNIT, lists[owner + 1]) - unit_at
    peak = np.maximum.reduceat(values, unit_at)
    price = PRICE * np.maximum.reduceat(peak, first[:-1])
    best = np.zeros(first[-1] + len(lengths), np.int64)  # each list has a place for no units
    came = np.zeros(len(best), np.int64)
    base = first[:-1] + np.arange(len(lengths))
    order = np.argsort(-units, kind="stable")
    back = np.arange(1, REACH + 1)
    alive = len(order)
    for j in range(1, int(units.max()) + 1):
        while units[order[alive - 1]] < j:
            alive -= 1
        mine = order[:alive]
        reach = min(j, REACH)
        at = first[mine][:, None] + (j - back[:reach])[None, :]
        # Least sum of length times maximum: what contributions sum to is the same for any cut.
        cost = np.cumsum(size[at], axis=1) * np.maximum.accumulate(peak[at], axis=1) + best[base[mine][:, None] + (j - back[:reach])[None, :]]
        chosen = cost.argmin(axis=1)
        best[base[mine] + j] = cost[np.arange(alive), chosen] + price[mine]
        came[base[mine] + j] = j - back[chosen]
    ends, here, who = [], units.copy(), np.arange(len(lengths))
    while len(who):
        ends.append(np.minimum(lists[who] + here[who] * UNIT, lists[who + 1]))
        here[who] = came[base[who] + here[who]]
        who = who[here[who] > 0]
    return np.sort(np.concatenate(ends))


class Shard:
    """Posting lists of one shard, with their blocks; documents are numbered in the order of their ids."""

    def __init__(self, n, ends, terms, tfs, vocabulary, weights, documents: int, length: int):
        m = 10 + (90 * n * documents) // length
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        term = np.searchsorted(vocabulary, terms)
        known = vocabulary[np.minimum(term, len(vocabulary) - 1)] == terms
        doc, term, tf = doc[known], term[known], tfs[known].astype(np.int64)
        value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        fine = value > 0
        order = np.lexsort((doc[fine], term[fine]))
        self.doc, term, self.value = doc[fine][order], term[fine][order], value[fine][order]
        self.docs = len(n)
        self.key = term * self.docs + self.doc
        lists = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        end = block_ends(self.value, np.r_[lists, len(term)])
        start = np.r_[0, end[:-1]] if len(end) else end
        self.peak = np.maximum.reduceat(self.value, start) if len(end) else self.value
        self.low, self.high = self.doc[start], self.doc[end - 1] + 1
        # Blocks of term t are at of[t] up to of[t + 1].
        self.of = np.searchsorted(term[start], np.arange(len(vocabulary) + 1))

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best of ``least`` or more, and how many documents were looked at."""
        blocks = np.concatenate([np.arange(self.of[t], self.of[t + 1]) for t in terms])
        found, scores, seen = np.empty(0, np.int64), np.empty(0, np.int64), 0
        if not len(blocks):
            return found, scores, seen
        edges = np.unique(np.r_[self.low[blocks], self.high[blocks]])
        change = np.bincount(np.searchsorted(edges, self.low[blocks]), self.peak[blocks], len(edges)) - np.bincount(np.searchsorted(edges, self.high[blocks]), self.peak[blocks], len(edges))
        bound = np.cumsum(change)[:-1].astype(np.int64)  # sums of whole numbers under 2**53
        order = np.argsort(-bound, kind="stable")
        width = np.diff(edges)[order]
        bound, low, high = bound[order], edges[:-1][order], edges[1:][order]
        least, at, step = max(1, least), 0, FIRST_STEP
        while at < len(order) and bound[at] >= least:
            stop = at + 1 + int(np.searchsorted(np.cumsum(width[at + 1 :]), step))
            stop = min(stop, at + int(np.searchsorted(-bound[at:], -least, "right")))  # bounds descend
            d, s = self.scored(terms, low[at:stop], high[at:stop])
            seen += int(width[at:stop].sum())
            found, scores = np.r_[found, d], np.r_[scores, s]
            top = np.lexsort((found, -scores))[:k]
            found, scores = found[top], scores[top]
            if len(found) == k:
                least = max(least, int(scores[-1]))
            at, step = stop, 2 * step
        fine = scores >= least
        return found[fine], scores[fine], seen

    def scored(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores above 0 of the documents of some stretches."""
        start = np.searchsorted(self.key, (terms[:, None] * self.docs + low[None, :]).ravel())
        count = np.searchsorted(self.key, (terms[:, None] * self.docs + high[None, :]).ravel()) - start
        at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        score = np.bincount(self.doc[at], self.value[at], self.docs)
        hit = np.flatnonzero(score)
        return hit, score[hit].astype(np.int64)


def search_shard(docs: pa.Table, items: pa.Table, documents: int, length: int, k: int) -> pa.Table:
    ids = docs.column("doc_id").to_numpy()  # doubles, if some are null
    order = np.argsort(ids, kind="stable") if docs.column("doc_id").null_count == 0 else np.array(sorted(range(len(ids)), key=lambda i: (np.isnan(ids[i]), docs.column("doc_id")[i].as_py() or 0)))
    docs = docs.take(pa.array(order)).combine_chunks()
    sizes = np.array(docs.column("terms").combine_chunks().value_lengths()) if docs.num_rows else np.empty(0, np.int64)
    flat = lambda table, name: np.concatenate([np.empty(0, np.int64), *[c.flatten().to_numpy() for c in table.column(name).chunks]])
    asked_terms, asked_weights = flat(items, "terms").astype(np.int64), flat(items, "weights").astype(np.int64)
    vocabulary, one = np.unique(asked_terms, return_index=True)
    out = {"item_id": [], "doc_id": [], "score": []}
    if docs.num_rows and len(vocabulary):
        shard = Shard(docs.column("n").to_numpy(), np.r_[0, np.cumsum(sizes)], flat(docs, "terms").astype(np.int64), flat(docs, "tfs"), vocabulary, asked_weights[one], documents, length)
        for item, terms, least in zip(items.column("item_id").to_pylist(), items.column("terms").to_pylist(), items.column("least").to_pylist()):
            found, scores, _ = shard.best(np.searchsorted(vocabulary, np.array(terms, np.int64)), k, least)
            out["item_id"] += [item] * len(found)
            out["doc_id"] += docs.column("doc_id").take(pa.array(found)).to_pylist()
            out["score"] += scores.tolist()
    return pa.table(out, schema=pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard_docs: int = SHARD_DOCS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents, ties to smaller ids."""
    terms = cut(terms_of(items))
    slim = cut(counted(docs, filter_of(terms.select("term"))))
    documents, length = slim.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = slim.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    queries = terms.join(frequency, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("t"))
    queries = cut(queries.select("item_id", F.col("t")["term"].alias("terms"), F.col("t")["weight"].alias("weights")))
    blocks = max(1, -(-queries.count() // block_items))
    shards = max(1, -(-documents // shard_docs))
    # Rows of a checkpoint keep their order, so a row's number deals it anew in the same way.
    dealt = slim.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    if blocks > 1:
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    else:
        dealt = dealt.withColumn("block", F.lit(0).cast("long"))
    asked_in = queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_shard(left, right, documents, length, k)

    def part(low: int, high: int, asking: DataFrame) -> DataFrame:
        each = asking.withColumn("shard", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
        chosen = dealt.where(F.col("shard").between(low, high - 1))
        return chosen.groupBy("shard", "block").cogroup(each.groupBy("shard", "block")).applyInArrow(run, "item_id long, doc_id long, score long")

    first = max(1, shards // FIRST_SHARDS)
    found = cut(part(0, first, asked_in.withColumn("least", F.lit(0).cast("long"))))
    if first < shards:
        reached = best(found, k).where(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
        found = found.unionByName(part(first, shards, asked_in.join(reached, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))))
    return best(found, k).select("item_id", "rank", "doc_id", "score")


def best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


_WORDS = "unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "'))"
ORACLE = f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="text")} AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY 1),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
asked AS (SELECT DISTINCT item_id, {_WORDS.format(text="text")} AS term FROM benchmark),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS part FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (term), totals),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
