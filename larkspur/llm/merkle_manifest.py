"""Merkle manifest of a data set: a hash for each document, a tree per source, one root.

A leaf is the SHA-256 of a document's fields. Per source, leaves stand in the order of
their ids; every three consecutive nodes have a parent until one node is left, the source's
subroot; subroots, in the order of the sources, have a root over them in the same way. Each
document gets its proof, the siblings from its leaf up to the root, and the root is folded
again from the leaf as it is now (here: of a tampered copy) and those siblings.

Ranks come from digits, not from a global sort. A row's key is its id (64 bits, then 64 of
its leaf, for rows of one id) and a histogram counts the rows of each source and key prefix,
the prefix being so long that no bucket has more than ``BUCKET_ROWS`` rows. The histogram is
summed to those of prefixes ``DIGIT`` bits shorter, level by level; going back down, a
bucket begins where its parent begins, plus the counts of its elder siblings, of which
there are at most 2**DIGIT. A row's rank is its bucket's beginning plus its place in it. Rows
that are alike in id and leaf are counted as one until their ranks are known.

A rank in digits of base 3 is a path in the tree. Nodes meet under the rank without its last
``LEVELS`` digits: a group of at most 3**LEVELS nodes is a whole subtree, built in one
expression, so a tree of 100 billion leaves takes four shuffles up, each 729 times smaller
than the one before. On the way down a group learns the rest of the path once for all its
leaves, which stay where they are. Everything is DataFrame functions; no group is larger than 729 nodes.

Defined cases: null fields hash as ``-``; a null id comes first in its source (as the least
id); rows of one id are ordered by their leaves, rows alike in both take consecutive places;
a null source is a source, the first one; texts of any length hash whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of the tree that one group builds.
LEVELS = 6
#: Bits of a digit of the histogram, and rows of one of its buckets (unless they agree in 128 bits).
DIGIT = 12
BUCKET_ROWS = 1 << 14
#: Alike rows that one row stands for while they are placed.
RUN = 1 << 12


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return sha(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def tampered_text() -> Column:
    """The text without its line ends where 2 divides the id's CRC-32; the text elsewhere."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, g (the source's name in the tree), leaf, and the leaf of the tampered copy, null where nothing changes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast(kind).alias(c) for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))])
    changed = tampered_text()
    same = F.coalesce(F.length(changed) == F.length("text"), F.lit(True))
    return rows.select("doc_id", tree_name().alias("g"), leaf().alias("leaf"), F.when(~same, leaf(text=changed)).alias("changed"))


def tree_name() -> Column:
    """A text that is never null and orders as the sources do, null first."""
    return F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit(""))


def bits_of_hex(text: Column) -> Column:
    """The first 64 bits of a hexadecimal text as a long whose bits order as unsigned."""
    return F.conv(F.rpad(F.substring(text, 1, 16), 16, "0"), 16, -10).cast("long")


def id_key(doc_id: Column) -> Column:
    """A long whose bits, unsigned, order as the ids; null as the least."""
    return F.coalesce(doc_id, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))


def prefix(shift: int) -> list[Column]:
    """The key (hi, lo) without its last ``shift`` of 128 bits."""
    if shift >= 64:
        return [F.shiftrightunsigned("hi", shift - 64) if shift < 128 else F.lit(0).cast("long"), F.lit(0).cast("long")]
    return [F.col("hi"), F.shiftrightunsigned("lo", shift) if shift else F.col("lo")]


def keyed(rows: DataFrame, shift: int) -> DataFrame:
    hi, lo = prefix(shift)
    return rows.withColumns({"p_hi": hi, "p_lo": lo})


def beginnings(rows: DataFrame, by: list[str], bucket_rows: int) -> tuple[DataFrame, int]:
    """Where each bucket of ``by`` and a key prefix begins, and the bits that the prefix leaves out.

    ``rows`` has ``by`` (never null), hi, lo and n, the rows that it stands for. Beside its
    beginning a bucket gets ``count``, the rows of its ``by``.
    """
    high = F.col("hi").bitwiseXOR(F.lit(-(1 << 63)))  # signed order of what orders as unsigned
    seen = rows.agg(F.min(high).alias("least"), F.max(high).alias("most"), F.count("*").alias("rows")).first()
    differ = (seen["least"] ^ seen["most"]) & ((1 << 64) - 1) if seen["rows"] else 0
    top = 64 + differ.bit_length()  # the bits above are the same in all keys
    shift = max(0, top - max(1, (seen["rows"] // (bucket_rows // 4 + 1)).bit_length()))
    while True:
        counted = cut(keyed(rows, shift).groupBy(*by, "p_hi", "p_lo").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")))
        if not shift or (counted.agg(F.max("kinds")).first()[0] or 0) <= bucket_rows:
            break
        shift = max(0, shift - DIGIT)
    # From here on a level's prefixes have lost their last bits already, and lose DIGIT more each.
    levels, gone = [counted.select(*by, F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo"), "n")], [shift]
    while gone[-1] < top:
        step = min(DIGIT, top - gone[-1])
        levels.append(shorter(levels[-1], gone[-1], step).groupBy(*by, F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.sum("n").alias("n")))
        gone.append(gone[-1] + step)
    begin = levels[-1].select(*by, "hi", "lo", F.lit(0).cast("long").alias("begin"), F.col("n").alias("count"))  # one bucket a group
    for level, lost, longer in zip(levels[-2::-1], gone[-2::-1], gone[:0:-1]):
        elder = Window.partitionBy(*by, "up_hi", "up_lo").orderBy(unsigned("hi"), unsigned("lo")).rowsBetween(Window.unboundedPreceding, -1)
        placed = shorter(level, lost, longer - lost).withColumn("elder", F.coalesce(F.sum("n").over(elder), F.lit(0)))
        joined = placed.join(begin.withColumnsRenamed({"hi": "up_hi", "lo": "up_lo"}), [*by, "up_hi", "up_lo"])
        begin = joined.select(*by, "hi", "lo", (F.col("begin") + F.col("elder")).alias("begin"), "count")
    return begin, shift


def shorter(level: DataFrame, gone: int, step: int) -> DataFrame:
    """The prefix of each prefix, which lost ``gone`` bits before and loses ``step`` more."""
    to_lo = min(step, max(0, 64 - gone))
    to_hi = step - to_lo
    lo = F.lit(0).cast("long") if gone + step >= 64 else F.shiftrightunsigned("lo", to_lo)
    hi = F.shiftrightunsigned("hi", to_hi) if to_hi < 64 else F.lit(0).cast("long")
    return level.withColumns({"up_hi": hi, "up_lo": lo})


def unsigned(name: str) -> Column:
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


def ranked(rows: DataFrame, by: list[str], order: list[Column], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``rank``, the rows (counted by n) of the same ``by`` that come before, and ``count``, all of them.

    hi and lo order the rows as far as they go, ``order`` the rest. Join and window deal rows alike.
    """
    begin, shift = beginnings(rows.select(*by, "hi", "lo", "n"), by, bucket_rows)
    begin = begin.withColumnsRenamed({"hi": "p_hi", "lo": "p_lo"})
    before = Window.partitionBy(*by, "p_hi", "p_lo").orderBy(unsigned("hi"), unsigned("lo"), *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed(rows, shift).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = placed.join(begin, [*by, "p_hi", "p_lo"])
    return joined.withColumn("rank", F.col("begin") + F.col("before")).select(*rows.columns, "rank", "count")


def height(count: Column) -> Column:
    """Levels above the leaves of a tree of ``count`` leaves."""
    total = F.lit(0)
    for i in range(40):
        total = total + (count > F.lit(FANOUT**i)).cast("int")
    return total


def parents(nodes: Column) -> Column:
    """The digests above an array of digests, three under one."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def subtrees(nodes: DataFrame, by: list[str], tier: int) -> DataFrame:
    """One row per group of consecutive nodes: its levels as arrays, l0 the nodes themselves.

    ``nodes`` has ``by``, rank, digest, height (the levels of the whole tree) and whatever else
    belongs to a node, which ``members`` keeps. Levels beyond the tree's own repeat the one below.
    """
    size = FANOUT**LEVELS
    rest = [c for c in nodes.columns if c not in (*by, "height", "rank")]
    group = nodes.withColumn("chunk", F.floor(F.col("rank") / size).cast("long")).groupBy(*by, "chunk", "height")
    out = group.agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("members")).withColumn("l0", F.col("members")["digest"])
    for i in range(1, LEVELS + 1):
        # A column that is used often is made once: each level reads the one below from the row.
        out = out.withColumn(f"l{i}", F.when(F.col("height") >= tier * LEVELS + i, parents(F.col(f"l{i - 1}"))).otherwise(F.col(f"l{i - 1}")))
    return out


def path_within(tier: int) -> Column:
    """The siblings of node ``at`` of a group, (left, right) for each level that the tree has here."""
    steps = []
    for i in range(LEVELS):
        place = F.floor(F.col("at") / FANOUT**i).cast("int")
        digit, first = F.pmod(place, F.lit(FANOUT)), place - F.pmod(place, F.lit(FANOUT))
        left = F.array_join(F.slice(F.col(f"l{i}"), first + 1, digit), "")
        right = F.array_join(F.slice(F.col(f"l{i}"), place + 2, F.lit(FANOUT - 1) - digit), "")
        steps.append(F.when(F.col("height") > tier * LEVELS + i, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def trees(nodes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Paths and roots of one tree per ``by`` over ``nodes`` (``by``, rank, digest, count, more).

    The first has a row per group of leaves, with its levels and ``rest``, the path above it;
    the second a row per tree.
    """
    level = nodes.withColumn("height", height(F.col("count"))).drop("count")
    most = level.agg(F.max("height")).first()[0] or 0
    tiers = [cut(subtrees(level, by, 0))]
    while len(tiers) * LEVELS < most:
        above = tiers[-1].where(F.col("height") > len(tiers) * LEVELS).select(*by, F.col("chunk").alias("rank"), F.col(f"l{LEVELS}")[0].alias("digest"), "height")
        tiers.append(cut(subtrees(above, by, len(tiers))))
    tops = [t.where((F.col("height") <= (i + 1) * LEVELS) & (F.col("height") >= (i * LEVELS + 1 if i else 0))) for i, t in enumerate(tiers)]
    roots = reduce(DataFrame.unionByName, [t.select(*by, F.col(f"l{LEVELS}")[0].alias("root")) for t in tops])
    none = F.array().cast("array<struct<left:string,right:string>>")
    here = tiers[-1].withColumn("rest", none)
    for i in range(len(tiers) - 1, 0, -1):
        up = with_paths(here, by, i).select(*by, F.col("node").alias("chunk"), "path")
        here = tiers[i - 1].join(up, [*by, "chunk"], "left").withColumn("rest", F.coalesce("path", none)).drop("path")
    return here, roots


def with_paths(groups: DataFrame, by: list[str], tier: int = 0) -> DataFrame:
    """``by``, node (its rank), its member and its path to the root, of every node of ``groups``."""
    each = groups.select("*", F.posexplode("members").alias("at", "member"))
    return each.select(*by, F.col("member")["rank"].alias("node"), "member", F.concat(path_within(tier), F.col("rest")).alias("path"))


def folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda h, s: sha(s["left"], h, s["right"]))


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = leaves(docs).groupBy("g", "doc_id", "leaf", "changed").agg(F.count("*").alias("n"))
    rows = cut(rows.select("*", id_key(F.col("doc_id")).alias("hi"), bits_of_hex(F.col("leaf")).alias("lo")))
    whole = ranked(rows, ["g"], [F.col("leaf")], bucket_rows)
    if (rows.agg(F.max("n")).first()[0] or 0) > RUN:  # many alike rows are dealt out in runs
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
        whole = whole.withColumn("skip", runs).repartition("g", "rank", "skip").withColumns({"rank": F.col("rank") + F.col("skip"), "n": F.least(F.col("n") - F.col("skip"), F.lit(RUN))})
    spread = cut(whole.withColumn("rank", F.explode(F.sequence("rank", F.col("rank") + F.col("n") - 1))).select("g", "rank", F.col("leaf").alias("digest"), "count", "doc_id", "changed"))
    groups, subroots = trees(spread, ["g"])
    first = F.hex(F.substring(F.encode("g", "utf-8"), 2, 16))
    named = cut(subroots.select("g", "root", F.lit(1).cast("long").alias("n"), bits_of_hex(first).alias("hi"), bits_of_hex(F.substring(first, 17, 16)).alias("lo")))
    in_order = ranked(named, [], [F.col("g")], bucket_rows)
    above, root = trees(in_order.select("rank", F.col("root").alias("digest"), "count", "g"), [])
    up = with_paths(above, []).select(F.col("member")["g"].alias("g"), F.col("member")["digest"].alias("subroot"), F.col("path").alias("up"))
    # A group of leaves learns its source's path once; leaves do not move any more.
    paths = with_paths(groups.join(up, "g").withColumn("rest", F.concat("rest", "up")), ["subroot"])
    of_leaf = paths.crossJoin(F.broadcast(root))  # one row
    member = F.col("member")
    out = of_leaf.select(
        member["doc_id"].alias("doc_id"), member["digest"].alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce(member["changed"], member["digest"]), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c=c) for c in FIELDS) + "))"
ORACLE = f"""
WITH RECURSIVE hit AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))) AS crc FROM documents),
leaves AS (
  SELECT doc_id, source, {_LEAF} AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents),
changed AS (
  SELECT doc_id, {_LEAF} AS leaf FROM (SELECT * REPLACE (CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text) FROM hit)),
nodes(source, level, idx, digest, n) AS (
  SELECT source, 0, rank, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, any_value(level) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx FROM nodes WHERE n = 1),
tops(level, idx, digest, n) AS (
  SELECT 0, idx, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3),
steps AS (
  SELECT l.doc_id, x.level AS level, x.idx AS idx, x.idx = l.rank // CAST(pow(3, x.level) AS BIGINT) AS own, x.digest
  FROM leaves l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.idx // 3 = l.rank // CAST(pow(3, x.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, 100 + x.level, x.idx, x.idx = s.idx // CAST(pow(3, x.level) AS BIGINT), x.digest
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops x ON x.n > 1 AND x.idx // 3 = s.idx // CAST(pow(3, x.level + 1) AS BIGINT)),
sides AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS nth, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT own AND idx < me), '') AS l, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT own AND idx > me), '') AS r
  FROM (SELECT *, max(CASE WHEN own THEN idx END) OVER (PARTITION BY doc_id, level) AS me FROM steps) GROUP BY doc_id, level),
paths AS (
  SELECT c.doc_id, c.leaf, sha256(coalesce(string_agg(concat(l, r), '' ORDER BY nth), '')) AS proof_sha256, coalesce(list([l, r] ORDER BY nth) FILTER (nth IS NOT NULL), []) AS path
  FROM changed c LEFT JOIN sides USING (doc_id) GROUP BY c.doc_id, c.leaf),
folded AS (SELECT doc_id, proof_sha256, list_reduce(list_prepend([leaf, ''], path), lambda h, s: [sha256(concat(s[1], h[1], s[2])), ''])[1] AS folded_root FROM paths)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, f.proof_sha256, f.folded_root, f.folded_root = t.digest AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n = 1 JOIN folded f ON f.doc_id = l.doc_id
"""
