"""Language identification against plain loops: n-grams in dictionaries, machines one step at a time."""

import math
import zlib
from collections import Counter
from itertools import combinations
from statistics import median

import numpy as np
import pytest

from larkspur.llm import language_id

SF = "/root/testdata/sf0.001"
M = 0xFFFFFFFF


def grams(text):
    """Shares of the hashed n-grams, square-rooted; None without a letter."""
    letters = [c if c.isalpha() else " " for c in (text or "").lower()]
    if not any(c != " " for c in letters):
        return None
    kept = []
    for c in [" ", *letters, " "]:
        if c != " " or not kept or kept[-1] != " ":
            kept.append(c)
    p = [ord(c) for c in kept]
    count = Counter()
    one = [c * 0x9E3779B1 & M for c in p]
    two = [one[i] ^ (p[i + 1] * 0xC2B2AE35 & M) for i in range(len(p) - 1)]
    three = [(two[i] * 31 & M) ^ (p[i + 2] * 0x165667B1 & M) for i in range(len(p) - 2)]
    for values, factor in ((one, 0x85EBCA6B), (two, 0x27D4EB2F), (three, 0x9E3779B1)):
        count.update((h * factor & M) >> 19 for h in values)
    total = sum(count.values())
    return {k: float(np.float32(math.sqrt(n / total))) for k, n in sorted(count.items())}


def dot(a, w):
    return sum(v * w.get(k, 0.0) for k, v in a.items()) + w.get("bias", 0.0)


def machine(rows, labels, first):
    """Dual coordinate descent of a squared hinge loss, ``first`` against the rest."""
    y = [1.0 if label == first else -1.0 for label in labels]
    sizes = Counter(y)
    diagonal = [sizes[v] / (language_id.COST * len(y)) for v in y]
    alpha, w, order = [0.0] * len(y), {}, np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for i in order.permutation(len(y)):
            gradient = y[i] * dot(rows[i], w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / (sum(v * v for v in rows[i].values()) + 1 + diagonal[i]), 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                for k, v in rows[i].items():
                    w[k] = w.get(k, 0.0) + step * v
                w["bias"] = w.get("bias", 0.0) + step
                alpha[i] = new
    return w


def vote(rows, labels):
    """The winner of all pairs of classes, and its mean squashed margin."""
    classes = sorted(set(labels))
    if len(classes) == 1:
        return lambda x: (classes[0], 1.0)
    pairs = {}
    for a, b in combinations(classes, 2):
        mine = [i for i, label in enumerate(labels) if label in (a, b)]
        pairs[a, b] = machine([rows[i] for i in mine], [labels[i] for i in mine], a)

    def run(x):
        votes = Counter()
        for (a, b), w in pairs.items():
            won = 1 / (1 + math.exp(-language_id.STEEPNESS * max(-20, min(20, dot(x, w)))))
            votes[a] += won
            votes[b] += 1 - won
        best = max(classes, key=lambda c: votes[c])
        return best, votes[best] / (len(classes) - 1)

    return run


def familiar(rows):
    """Whether a text's n-grams are as usual among a label's rows as the slack asks."""
    d = language_id.DIMENSIONS
    total = Counter()
    for r in rows:
        for k, v in r.items():
            total[k] += v * v
    lengths = [-sum(v * v * math.log(max(total[k] + 1 / d - v * v, 1 / d) / len(rows)) for k, v in r.items()) for r in rows]
    usual = median(lengths)

    def known(x):
        length = -sum(v * v * math.log((total[k] + 1 / d) / (len(rows) + 1)) for k, v in x.items())
        return length - usual <= language_id.SLACK + language_id.SHORT * math.sqrt(sum(v**4 for v in x.values()))

    return known


def brute(docs):
    learned = []
    for i, text, lang in docs:
        x = grams(text)
        if lang is not None and x is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2:
            at = np.array(list(x), "<u4").tobytes(), np.array(list(x.values()), "<f4").tobytes()
            learned.append(((lang, *at), x))
    learned.sort(key=lambda row: row[0])
    rows, langs = [x for _, x in learned], [key[0] for key, _ in learned]
    families = [language_id.family_of(lang) for lang in langs]
    first = vote(rows, families)
    second = {f: vote([r for r, g in zip(rows, families) if g == f], [lang for lang, g in zip(langs, families) if g == f]) for f in set(families)}
    usual = {lang: familiar([r for r, other in zip(rows, langs) if other == lang]) for lang in set(langs)}
    for i, text, _ in docs:
        x = grams(text)
        if x is None:
            yield i, "und", 0.0
            continue
        family, sure = first(x)
        lang, score = second[family](x)
        yield i, lang, sure * score if usual[lang](x) else 0.0


def test_identification_equals_plain_loops(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    extra = [(9001, "qzx wvkj pqzt xxkq zzvw", None), (9002, "12 34 !!", "en"), (9003, None, "en"), (9004, "съешь ещё этих мягких французских булок", None), (9005, "the", None)]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    want = list(brute(docs + extra))
    assert len(got) == len(want)
    for i, lang, score in want:
        assert (got[i]["lang_pred"], got[i]["score"]) == (lang, pytest.approx(score, abs=2e-3)), i
    assert got[9004]["score"] == 0 and got[9002]["lang_pred"] == "und"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
