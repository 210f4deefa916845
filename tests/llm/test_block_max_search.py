import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from larkspur.llm import block_max_search as search

from .helpers import ROWS, documents

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(search.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Plain loops over (doc_id, text) and (item_id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, n in counted:
            m = 10 + 90 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=str)


def items_table(spark, items):
    return spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")


def docs_table(spark, docs):
    return documents(spark, [(i, t, None, None) for i, t in docs])


ITEMS = [(1, "The quick brown FOX"), (2, "über hund, sprîngt"), (3, ""), (4, None), (None, "the"), (5, "licensed under the apache license"), (5, "version 2.0"), (6, "nowhere_to_be-found xyzzy"), (7, "word1 word2 word996")]


def test_awkward_rows(spark):
    docs = [(i, t) for i, t, *_ in ROWS] + [(50, "fox " * 300), (51, "É über"), (None, "the fox"), (52, "\x00fox\x7fthe")]
    got = search.search(docs_table(spark, docs), items_table(spark, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, ITEMS)


@pytest.mark.parametrize("shard_docs,block_items", [(10_000, 1000), (16, 3)])
def test_many_documents_equal_plain_loops(spark, shard_docs, block_items):
    """Common and rare words, ties, repeated rows; one shard, and many with blocks of queries."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(120)]
    chance = 1 / np.arange(1, 121)
    docs = [(int(i), " ".join(rng.choice(vocabulary, size=int(rng.integers(1, 60)), p=chance / chance.sum()))) for i in range(600)]
    docs += [docs[7]] * 40 + [(i, docs[3][1]) for i in range(700, 760)]
    items = [(int(i), " ".join(rng.choice(vocabulary, size=int(rng.integers(1, 9))))) for i in range(20)]
    got = search.search(docs_table(spark, docs), items_table(spark, items), shard_docs=shard_docs, block_items=block_items)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_blocks_are_the_cheapest_cut():
    """Against all cuts of short lists, and within reach for long ones."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 70, size=4)
        values = rng.integers(1, 1000, size=lengths.sum())
        lists = np.r_[0, np.cumsum(lengths)]
        ends = search.block_ends(values, lists)
        for a, b in zip(lists, lists[1:]):
            mine = [a, *[e for e in ends if a < e <= b]]
            price = search.PRICE * values[a:b].max()

            def cost(cut):
                return sum((y - x) * values[x:y].max() + price for x, y in zip(cut, cut[1:]))

            inner = list(range(a + search.UNIT, b, search.UNIT))
            cuts = ([a, *[p for j, p in enumerate(inner) if mask >> j & 1], b] for mask in range(1 << len(inner)))
            assert mine[-1] == b and cost(mine) == min(map(cost, cuts))
    assert len(search.block_ends(np.ones(10_000, np.int64), np.array([0, 10_000]))) == math.ceil(10_000 / search.UNIT / search.REACH)


def test_searches_skip():
    """Where a few stretches hold the best, most documents are never scored."""
    rng = np.random.default_rng(1)
    n = rng.integers(50, 200, size=8000)
    terms = np.arange(4, dtype=np.int64)
    has = np.ones((8000, 4), bool)
    tf = np.where((np.arange(8000) // 100 == 33)[:, None], 9, rng.integers(1, 3, size=(8000, 4)))
    shard = search.Shard(n, np.r_[0, np.cumsum(has.sum(1))], np.tile(terms, 8000), tf.ravel(), terms, np.array([900, 800, 700, 600]), 8000, int(n.sum()))
    found, scores, seen = shard.best(np.arange(4), 10, 0)
    every, exact = shard.scored(np.arange(4), np.array([0]), np.array([8000]))
    top = np.lexsort((every, -exact))[:10]
    assert found.tolist() == every[top].tolist() and scores.tolist() == exact[top].tolist()
    assert seen < 2000
    assert not len(shard.best(np.arange(4), 10, int(scores[0]) + 1)[0])


def test_no_rows(spark):
    assert search.search(docs_table(spark, []), items_table(spark, ITEMS)).count() == 0
    assert search.search(documents(spark), items_table(spark, [])).count() == 0


def test_sql_and_loops_agree(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(search.ORACLE).fetchall(), key=str)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sorted(map(tuple, search.search(docs, items).collect()), key=str) == want
    assert brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]) == want
