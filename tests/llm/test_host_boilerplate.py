"""Page extraction where the host's repeated runs decide, held against brute force."""

import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import host_boilerplate as hb


def text_of(page):
    blocks = hb.blocks_of(page)
    return hb.unique_text(blocks, np.zeros(len(blocks)))[0]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, rows, **kw):
    return {r["page_id"]: r["text"] for r in hb.extract(table(spark, rows), **kw).collect()}


def prose(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in rng.integers(0, 10**9, n))


SMALL = dict(batch_tokens=300, group_bytes=2000, range_bytes=1000, range_entries=50)


def plain_extract(rows, run=hb.RUN, least=hb.PAGES, most=hb.MOST):
    """The extraction by definition: runs as tuples of words, counted over a whole host."""
    read = [(hb.blocks_of(page), (url or "").split("/")[2] if (url or "").count("/") > 1 else "") for _, url, page in rows]
    seen, whole = defaultdict(set), defaultdict(int)
    where = []
    for i, (blocks, host) in enumerate(read):
        whole[host] += 1
        words = [w for b in blocks if b.kind != hb.OUT for w in b.text.split(" ")]
        tokens, block = hb.words_of(blocks)
        mine = {int(p): tuple(words[p : p + run]) for p in hb.indexed(hb.run_hashes(tokens), block)}
        where.append((mine, block))
        for r in mine.values():
            seen[host, r].add(i)
    out = {}
    for (blocks, host), (mine, block), row in zip(read, where, rows):
        both = []
        for bar in (least, max(least, whole[host] * most + 1)):
            covered = np.zeros(len(block), bool)
            for p, r in mine.items():
                if len(seen[host, r]) >= bar:
                    covered[p : p + run] = True
            both.append(np.array([covered[block == k].mean() if (block == k).any() else 0.0 for k in range(len(blocks))]))
        out[row[0]] = hb.unique_text(blocks, *both)[0]
    return out


def mixed_host(n, seed=1):
    """Pages of declared and undeclared content, with lines that three, some or all of them hold."""
    rng = np.random.default_rng(seed)
    phrases = [prose(100 + i, int(rng.integers(5, 25))) for i in range(30)]
    every = "thank you for reading this story and please tell all of your friends about us"
    rows = []
    for i in range(n):
        parts = [phrases[k] for k in rng.choice(30, 2)] + [prose(10_000 + i), prose(20_000 + i, 60)]
        if i in (3, n // 2, n - 1):
            parts.append("only three pages of this host carry this short notice of ours")
        rng.shuffle(parts)
        body = "".join(f"<p>{x}</p>" for x in parts)
        if i % 3 == 0:
            body = f"<nav>menu</nav><article><h1>t{i}</h1>{body}<p>{every}</p></article>"
        else:
            body += f"<div>{every}</div>"
        rows.append((i, f"http://h{'abbb'[i % 4]}.example/p/{i}", f"<body>{body}</body>"))
    return rows


@pytest.mark.parametrize("kw", [{}, SMALL])
def test_extraction_equals_brute_force_over_whole_hosts(spark, kw):
    rows = mixed_host(150) + [(900, None, None), (901, "odd", "<p>x</p>"), (None, "http://ha.example/", "")]
    assert texts(spark, rows, **kw) == plain_extract(rows)


def test_the_verdict_decides_the_text(spark):
    rows = mixed_host(60)
    got = texts(spark, rows)
    changed = [i for i, _, page in rows if got[i] != text_of(page)]
    assert len(changed) == len(rows)  # each page holds the line that all of them hold
    assert not any("thank you for reading" in t for t in got.values())
    assert all(prose(10_000 + i) in got[i] and prose(20_000 + i, 60) in got[i] for i in got)


def test_pages_of_small_and_large_hosts_agree(spark):
    notice = "the very same notice of some eleven words is on three pages"
    outcome = []
    for n in (250, 900):
        rows = [(i, "http://h.example/", f"<p>{prose(i)}</p>" + (f"<p>{notice}</p>" if i in (1, 100, 249) else "")) for i in range(n)]
        got = texts(spark, rows, **SMALL)
        outcome.append([got[i] for i in range(250)])
        assert not any(notice in t for t in got.values())
    assert outcome[0] == outcome[1]


def test_quoted_passages_and_copies_stay(spark):
    quoted, copied = prose(5, 30), "".join(f"<p>{prose(50 + i)}</p>" for i in range(4))
    rows = [(i, "http://h.example/", f"<article><p>{prose(200 + i)}</p>" + (f"<p>{quoted}</p>" if i < 14 else "") + "</article>") for i in range(30)]
    rows += [(100 + i, "http://c.example/", f"<article>{copied}</article>") for i in range(9)]
    got = texts(spark, rows)
    assert all(quoted in got[i] for i in range(14))
    assert all(got[100 + i].count("\n") == 3 for i in range(9))


def test_class_words_only_propose_inside_an_article(spark):
    page = """<article><h1>T</h1><p class="share-price">Up.</p><p class="footnotes foot-note">Note.</p><div class="alert">Look out.</div>
    <div class="related-work"><p>Others.</p></div><div class="cookie-notice">We use cookies</div><div class="share-buttons">Tweet</div>
    <div class="ad">Buy</div><ul class="related-posts"><li>More</li></ul><section class="comment-list"><p>First!</p></section></article>"""
    assert text_of(page) == "T\nUp.\nNote.\nLook out.\nOthers."
    alert = "this is the alert that the site puts on its pages every day"
    rows = [(i, "http://h.example/", f'<article><p>{prose(i)}</p><div class="alert">{alert if i in (2, 5, 8) else prose(70 + i)}</div></article>') for i in range(10)]
    got = texts(spark, rows)
    assert all((alert in got[i]) is False and got[i].count("\n") == (i not in (2, 5, 8)) for i in range(10))


def test_larger_unique_text_beside_a_declared_teaser_stays(spark):
    rows = [(i, "http://h.example/", f'<div class="post">short teaser</div><p>{prose(i)}</p><p>{"the host says these words under all that it prints"}</p>') for i in range(4)]
    got = texts(spark, rows)
    assert all(got[i] == f"short teaser\n{prose(i)}" for i in range(4))


def test_references_end_at_tags():
    assert text_of("<p>a &am<b>p;</b> b &amp; c</p>") == "a &amp; b & c"


def test_reading_is_linear():
    for make in (lambda n: "<b>" * n + "<p></p>" * n, lambda n: "<p>" + "<i>" * n + "<li>x" * n, lambda n: "<a '" * n, lambda n: "&amp<" * n):
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            hb.blocks_of(make(n))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "http://h.example/", "<p>x</p>"), (1, "http://h.example/", "<p>" + "word " * 300_000 + "</p>")]
    rows += [(2, "http://h.example/", f"<p>{prose(1)}</p>")] * 5 + [(3, "http://h.example/", "<p>😀 café</p>"), (2**60 + 1, "x", "<p>big</p>")]
    pages = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, grp string, part int")
    out = hb.extract(pages)
    got = sorted((str(r["page_id"]), len(r["text"])) for r in out.collect())
    assert len(got) == len(rows) and (str(2**60 + 1), 3) in got and ("None", 0) in got
    assert [n for i, n in got if i == "2"] == [len(prose(1))] * 5
    assert hb.extract(pages.limit(0)).count() == 0


def test_rows_alike_spread_over_groups(spark):
    page = f"<body><p>{prose(7)}</p></body>"
    alike = table(spark, [(1, "http://h.example/a", page)] * 200).select("page_id", "url", F.lit("h.example").alias("host"), "html")
    groups = alike.mapInArrow(hb.read_pages(5 * (len(page) + hb.PAGE_SIZE)), hb.READ).select("grp", F.size("page_id").alias("n")).collect()
    assert sum(g["n"] for g in groups) == 200 and max(g["n"] for g in groups) <= 5 and len({g["grp"] for g in groups}) == len(groups) >= 40


def test_markup_is_read_once(spark, tmp_path):
    table(spark, mixed_host(20)).write.parquet(str(tmp_path / "pages"))
    found = hb.extract(spark.read.parquet(str(tmp_path / "pages")), **SMALL)
    assert str(tmp_path) not in found._jdf.queryExecution().toString() and found.count() == 20
