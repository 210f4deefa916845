import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb

from larkspur.llm import merkle_manifest

from .helpers import ROWS, documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(nodes):
    """The levels of a tree over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        first = at - at % 3
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 3])
        at //= 3


def brute(rows):
    """Plain loops over (doc_id, source, lang, n_chars, text)."""
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row):
        return h(*map(part, row))

    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: fold([leaf(r) for r in by[s]]) for s in order}
    top = fold([trees[s][-1][0] for s in order])
    root = top[-1][0]
    for i, s in enumerate(order):
        for at, row in enumerate(by[s]):
            path = [*siblings(trees[s], at), *siblings(top, i)]
            text = row[4].replace("\n", "") if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[4]
            now = leaf((*row[:4], text))
            for left, right in path:
                now = h(left, now, right)
            yield row[0], leaf(row), trees[s][-1][0], root, h(*[a + b for a, b in path]), now, now == root


def check(spark, rows, bucket_rows=merkle_manifest.BUCKET_ROWS):
    table = spark.createDataFrame([(i, s, lang, n, t, "clash", 1) for i, s, lang, n, t in rows], "doc_id long, source string, lang string, n_chars long, text string, rank string, hi int")
    got = merkle_manifest.manifest(table, bucket_rows).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    return got


def test_trees_of_many_sizes(spark):
    rows = []
    for size, source in [(1, "a"), (2, "b"), (3, None), (4, ""), (9, "é"), (10, "z" * 20), (28, "z" * 19 + "y"), (2200, "long")]:
        rows += [(7 * len(rows) - 3000, source, "en", i, f"text {i}\nof {source}") for i in range(size)]
    got = check(spark, rows)
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_nulls_ties_and_repeated_rows(spark):
    awkward = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in ROWS]
    awkward += [(None, "a", None, 3, f"no id {i}\n") for i in range(40)] + [(8, "a", "en", 1, "x\ny")] * 30 + [(8, "a", "en", 1, f"x{i}") for i in range(30)]
    awkward += [(-(1 << 63), "b", None, None, None), ((1 << 63) - 1, "b", None, None, ""), (0, "b", "", 0, "")]
    check(spark, awkward)


def test_small_buckets_ask_for_longer_prefixes(spark):
    """Ids in clusters, an id with many rows: prefixes reach into the leaf's own bits."""
    rows = [(5, "s", None, i, f"t{i}") for i in range(60)] + [((1 << 40) + i, "s", None, i, "t") for i in range(60)] + [(i * 1000, None, None, i, "t") for i in range(60)]
    check(spark, rows, bucket_rows=4)


def test_alike_rows_are_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "RUN", 4)
    check(spark, [(1, "s", "en", 1, "a\nb")] * 31 + [(2, "s", "en", 1, "c")])


def test_no_rows(spark):
    out = merkle_manifest.manifest(documents(spark, []))
    assert out.count() == 0
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_sql_agrees(spark):
    """The SQL, on its own, over documents of one row an id."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = Counter(con.execute(merkle_manifest.ORACLE).fetchall())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert Counter(map(tuple, merkle_manifest.manifest(docs).collect())) == want
    assert Counter(brute([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])) == want
