"""The two searches of vectors against brute force."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from larkspur.llm import hamming_index, permutation_index as pi


def by_query(rows, score):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r[score], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def plain_hamming(bits, k=10, every=100):
    out = {}
    for q in (i for i in bits if i % every == 0):
        out[q] = sorted((sum(a != b for a, b in zip(bits[q], other)), i) for i, other in bits.items() if i != q)[:k]
    return out


def test_hamming_words_beyond_the_first(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 100))
    rows = {i: [float(x) for x in centre[i % 6] + 0.4 * rng.normal(size=100)] for i in range(900)}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = by_query(hamming_index.nearest(hamming_index.sign_words(table)).collect(), "distance")
    assert got == plain_hamming({i: [x > 0 for x in v] for i, v in rows.items()})


def test_hamming_ends_by_radius_and_by_comparison(spark):
    rng = np.random.default_rng(3)
    codes = [int(x) for x in rng.integers(0, 2**63, 3000)]
    for i in range(0, 1500, 100):  # these queries end early, the others compare all
        for j in range(1, 16):
            codes[i + j] = codes[i] ^ (1 << int(rng.integers(0, 63)))
    codes[2500:2900] = [codes[7]] * 400
    table = spark.createDataFrame(list(enumerate(codes)), "vec_id long, code long")
    got = by_query(hamming_index.nearest(table).collect(), "distance")
    assert got == plain_hamming({i: [c >> b & 1 for b in range(64)] for i, c in enumerate(codes)})


def test_hamming_awkward_rows(spark):
    rows = [(0, [1.0, -1.0]), (0, [-1.0, -1.0]), (1, [1.0] * 70), (2, None), (3, []), (None, [1.0]), (4, [None]), (100, [-1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, query_id string, first int")
    got = by_query(hamming_index.nearest(hamming_index.sign_words(table)).collect(), "distance")
    assert got == {0: [(1, 100), (70, 1)], 100: [(1, 0), (69, 1)]}
    assert hamming_index.nearest(hamming_index.sign_words(table.limit(0))).count() == 0
    one = table.where("vec_id = 100")
    assert hamming_index.nearest(hamming_index.sign_words(one)).count() == 0


def plain_nearest(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        out[q] = [(float(d[i]), int(ids[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def recall(got, want):
    return np.mean([len({v for _, v in want[q]} & {v for _, v in got[q]}) / len(want[q]) for q in want])


def test_recall_where_the_index_prunes(spark):
    """Unclustered vectors of 24 components, and a third of all rows around one place far off."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(24_000, 24)).astype(np.float32)
    x[::3] = (5 + x[0] + 0.05 * rng.normal(size=x[::3].shape)).astype(np.float32)
    ids = np.arange(len(x))
    queries = [i for i in ids.tolist() if i % 100 == 0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = by_query(pi.nearest(table).collect(), "score")
    wide = x.astype(float)
    want = plain_nearest(ids, wide, queries)
    assert sorted(got) == queries and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    assert all(abs(s - np.sqrt(((wide[q] - wide[v]) ** 2).sum())) < 1e-9 for q in queries[:20] for s, v in got[q])
    # What is reranked, by the index's own parts: under a tenth outside the crowd.
    seen = wide[rng.permutation(len(x))[: pi.SAMPLE]]
    axes = seen[:256]
    perm = pi.permutations(wide, axes, pi.PREFIX)
    outside = [q for q in queries if q % 3][:60]
    bar = pi.bars(wide[outside], perm[outside], seen, pi.permutations(seen, axes, pi.PREFIX), pi.RERANKED)
    place, orders = pi.small_places(perm, perm[outside])
    assert np.mean([(pi.footrule(place, o) <= b).mean() for o, b in zip(orders, bar)]) < 0.1


def test_footrule_is_that_of_the_orders():
    rng = np.random.default_rng(4)
    orders = np.array([rng.permutation(40)[:8] for _ in range(30)], np.uint16)
    place, renamed = pi.small_places(orders, orders[:5])
    for q in range(5):
        plain = [sum(abs((list(a).index(p) if p in a else 8) - (list(orders[q]).index(p) if p in orders[q] else 8)) for p in range(40)) for a in orders]
        assert (pi.footrule(place, renamed[q]) - pi.footrule(place, renamed[q])[q]).tolist() == plain


def test_files_are_split_without_loss(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 8)) * np.r_[np.ones(600), 0.01 * np.ones(600)][:, None] + 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    kw = dict(pivots=(16, 16), prefix=16, posted=2, probed=16, reranked=1.0)
    want = plain_nearest(np.arange(1200), x, range(0, 1200, 100))
    for file_rows in (20, 1 << 15):
        got = by_query(pi.nearest(table, file_rows=file_rows, **kw).collect(), "score")
        assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_permutation_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 5.0]), (1, [0.0, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 4.0]), (200, [9.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, query_id int, pivot string")
    got = by_query(pi.nearest(table).collect(), "score")
    assert got == {0: [(np.sqrt(2.0), 1)], 100: [(1.0, 101)]}
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(350)], "vec_id long, embedding array<double>")
    got = by_query(pi.nearest(copies).collect(), "score")
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[100] == got[200] == got[300] == [(0.0, i) for i in range(10)]


@pytest.mark.parametrize("n_pivots", [1024, 4096])
def test_recall_with_many_pivots(spark, n_pivots):
    """Vectors without clusters: queries read as many files as their neighbourhoods are spread over."""
    rng = np.random.default_rng(n_pivots)
    x = rng.normal(size=(20_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    found = pi.nearest(table, every=400, pivots=(n_pivots, n_pivots)).toPandas()
    wide, hits = x.astype(float), 0
    asked = range(0, len(x), 400)
    for i in asked:
        d = ((wide - wide[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        mine = found[found["query_id"] == i]
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["vec_id"].is_unique
        hits += len(set(np.argpartition(d, 10)[:10]) & set(mine["vec_id"]))
    assert hits / (10 * len(asked)) >= 0.9
    # How many rows the files hold that queries read: a part of the table, though nothing here is clustered.
    order = rng.permutation(len(x))
    axes, seen = wide[order[:n_pivots]], wide[order[n_pivots : n_pivots + pi.SAMPLE]]
    posted = pi.permutations(wide, axes, pi.POSTED)
    perm = pi.permutations(wide[::400], axes, n_pivots)
    counts = pi.probe_counts(wide[::400], perm, seen, pi.permutations(seen, axes, pi.PREFIX), pi.POSTED, pi.PROBED)
    touched = [np.isin(posted, p[:n]).any(axis=1).mean() for p, n in zip(perm, counts)]
    print(n_pivots, "files read", counts.mean(), "rows touched", np.mean(touched), "recall", hits / (10 * len(asked)))
    assert np.mean(touched) < 0.5
