import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import odd_sketch
from larkspur.llm.common import WORD

from .helpers import ROWS, documents

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(WORD, (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(docs, percent=85):
    """All pairs of distinct texts, in plain loops."""
    sets = {t: shingles(t) for _, t in docs}
    texts, above = [t for t in sets if sets[t]], {t: t for t in sets}

    def root(t):
        while above[t] != t:
            t = above[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                above[root(a)] = root(b)
    ids = defaultdict(list)
    for i, t in docs:
        if i is not None:
            ids[root(t)].append(i)
    for i, t in docs:
        name = min(ids[root(t)], default=None) if sets[t] else i
        yield i, len(sets[t]), name, i == name


def check(spark, docs, **more):
    got = odd_sketch.groups(documents(spark, [(i, t, None, None) for i, t in docs]), **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = Counter(map(tuple, got.collect()))
    assert got == Counter(brute(docs))
    return got


def test_awkward_rows(spark):
    docs = [(i, t) for i, t, *_ in ROWS]
    docs += [(20, "one"), (21, "ONE"), (22, "one two"), (23, "One  two"), (24, "two one"), (25, "É x"), (26, "é x"), (None, "one"), (None, None), (None, "alone without an id here")]
    check(spark, docs)


@pytest.mark.parametrize("limit", [odd_sketch.BUCKET_LIMIT, 8])
def test_families_of_near_copies(spark, limit):
    """Edits around the threshold, chains, copies; with buckets small enough to be split."""
    rng = np.random.default_rng(11)
    docs, words = [], [f"w{i}" for i in range(400)]
    for family in range(6):
        base = list(rng.choice(words, size=int(rng.integers(30, 120))))
        for _ in range(40):
            text = list(base)
            for _ in range(int(rng.integers(0, 6))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            docs.append((len(docs), " ".join(text)))
        chain = list(base)
        for _ in range(12):  # each a step from the last
            chain[int(rng.integers(len(chain)))] = str(rng.choice(words))
            docs.append((len(docs), " ".join(chain)))
    docs += [(1000 + i, docs[3][1]) for i in range(50)] + [docs[5]] * 30 + [(None, docs[7][1])]
    got = check(spark, docs, limit=limit)
    assert len({name for _, _, name, _ in got}) > 6


def test_exact_bounds_of_the_sketches():
    """No pair at or above the threshold is dropped; most pairs well under it are."""
    rng = np.random.default_rng(3)
    dropped = kept = 0
    for size in (7, 40, 300, 3000, 6000):
        for share in (0.4, 0.6, 0.75, 0.852, 0.9, 0.99):
            for _ in range(12):
                both = round(2 * size * share / (1 + share))
                pool = rng.integers(0, 1 << 63, 2 * size - both, np.uint64)
                a, b = np.unique(pool[:size]), np.unique(pool[size - both :])
                inter = len(np.intersect1d(a, b))
                linked = 100 * inter >= 85 * (len(a) + len(b) - inter)
                marks = [np.stack(x) for x in ([odd_sketch.whole_sketch(a), odd_sketch.whole_sketch(b)], odd_sketch.sketches(np.stack([odd_sketch.samples(a), odd_sketch.samples(b)])))]
                levels = np.array([odd_sketch.level_of(len(a)), odd_sketch.level_of(len(b))])
                found = [p for i, j in odd_sketch.apart(np.array([0, 1]), np.array([len(a), len(b)]), levels, marks[1], marks[0], odd_sketch.most_bits(), False) for p in zip(i, j)]
                assert found or not linked
                if share <= 0.6 and size >= 40:
                    dropped += not found
                    kept += bool(found)
    assert dropped > 20 * kept


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 230, np.uint64)
        least = np.stack([odd_sketch.samples(np.unique(pool[:215])), odd_sketch.samples(np.unique(pool[15:]))])  # 200 of 230 are shared
        keys = odd_sketch.bands(least)
        met += bool((keys[0] == keys[1]).any())
    assert met == 300


def test_no_rows(spark):
    assert odd_sketch.groups(documents(spark, [])).count() == 0


def test_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, docs)
