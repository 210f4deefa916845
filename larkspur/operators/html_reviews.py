"""Review rows out of captured HTML, plain, wrapped in JSON or in AJAX chunks.

A small tree over the standard library's tokenizer is enough: reviews are found by a
handful of attributes. It runs where the data is, over Arrow batches or as a table
function; a page that can't be read yields no row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse_fields import ITEM_IN_PAGE, clean, helpful_votes, item_id, star_rating
from .parse_json import review_row

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# The attributes that mark a review and its parts.
REVIEW_HOOK = "review"
REVIEW_ID_PREFIX = "customer_review-"
PARTS = {
    "title": ["review-title"],
    "body": ["review-body"],
    "rating": ["review-star-rating", "cmps-review-star-rating"],
    "date": ["review-date"],
    "badge": ["avp-badge"],
    "helpful": ["helpful-vote-statement"],
}
AUTHOR_CLASS = "a-profile-name"
MARKS = ("data-hook", "customer_review")
RAW = "review_id string, title string, body string, rating string, date string, author string, badge string, helpful string, html_item string"
FIELDS = [f.split()[0] for f in RAW.split(", ")]
LINKED_ITEM = re.compile(ITEM_IN_PAGE)


class Node:
    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; no recursion, so depth has no limit."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str | None:
        out, todo = [], list(reversed(self.children))
        while todo:
            child = todo.pop()
            if isinstance(child, Node):
                if child.tag not in ("script", "style", "template"):
                    todo += reversed(child.children)
            elif child.strip():
                out.append(child.strip())
        return " ".join(" ".join(out).split()) or None

    def find(self, test) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def marked_strings(value) -> Iterator[str]:
    """Strings anywhere in parsed JSON that hold review markup, in order."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            if any(m in value for m in MARKS):
                yield value
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            todo += reversed(list(value.values()))


def unwrap(text: str) -> str:
    """The HTML in a response: AJAX chunks, a JSON document, or the text itself."""
    stripped = text.strip()

    def parsed(chunk):
        try:
            return json.loads(chunk)
        except ValueError:
            return None

    if "]&&&[" in stripped:
        found = [s for chunk in stripped.split("&&&") for s in marked_strings(parsed(chunk))]
        if found:
            return "\n".join(found)
    if stripped[:1] in ("{", "["):
        found = list(marked_strings(parsed(stripped)))
        if found:
            return "\n".join(found)
    return text


#: Levels of JSON that are walked in the JVM; what is nested deeper goes to Python whole.
DEPTH = 8


def unwrapped(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``pages`` with ``html`` for ``payload``: the marked strings of JSON and AJAX responses, other texts as they are.

    JSON is read as VARIANT and walked level by level: each level is one generator, rows that
    hold no markup end there, and no row of Python runs. Strings come in the order of their
    places, the fields of an object by name. ``deep`` is set where JSON goes on below ``depth``
    levels, or is none that VARIANT takes; such a payload is left as it is, for Python.
    """
    spark = pages.sparkSession
    rest = [c for c in pages.columns if c != "payload"]
    text = F.trim(F.col("payload"))
    ajax = F.coalesce(F.contains(text, F.lit("]&&&[")), F.lit(False))
    wrapped = (ajax | F.coalesce(F.left(text, F.lit(1)).isin("{", "["), F.lit(False))) & marked(F.col("payload"))
    rows = pages.withColumn("__wrapped", wrapped)
    direct = rows.where(~F.col("__wrapped")).select(*rest, F.col("payload").alias("html"), F.lit(False).alias("deep"))
    # Chunk 0 is none: its row keeps the payload, whatever becomes of the others.
    chunks = F.concat(F.array(F.lit(None).cast("string")), F.when(ajax, F.split(text, "&&&")).otherwise(F.array(text)))
    walk = rows.where("__wrapped").withColumn("__id", F.monotonically_increasing_id()).select("__id", "payload", *rest, F.posexplode(chunks).alias("__chunk", "__text"))
    walk = walk.withColumn("v", F.try_parse_json("__text")).withColumn("__unread", marked(F.col("__text")) & F.col("v").isNull())
    walk = walk.drop("__text").withColumn("__path", F.array().cast("array<int>"))
    for _ in range(depth):
        walk.createOrReplaceTempView("larkspur_walk")
        opened = spark.sql("SELECT w.*, t.pos AS __pos, t.value AS __value FROM larkspur_walk w, LATERAL variant_explode_outer(CASE WHEN schema_of_variant(w.v) LIKE 'OBJECT<%' OR schema_of_variant(w.v) LIKE 'ARRAY<%' THEN w.v END) AS t")
        spark.catalog.dropTempView("larkspur_walk")
        inside = F.col("__pos").isNotNull()
        opened = opened.withColumns({"v": F.when(inside, F.col("__value")).otherwise(F.col("v")), "__path": F.when(inside, F.concat("__path", F.array("__pos"))).otherwise(F.col("__path"))}).drop("__pos", "__value")
        held = F.try_variant_get("v", "$", "string")
        walk = opened.where(marked(held) | (F.col("__chunk") == 0) | F.col("__unread"))
    held, kind = F.try_variant_get("v", "$", "string"), F.schema_of_variant("v")
    found = F.coalesce((kind == "STRING") & marked(held), F.lit(False))
    strings = F.array_sort(F.collect_list(F.when(found, F.struct("__chunk", "__path", held.alias("s")))))
    whole = walk.groupBy("__id").agg(
        F.array_join(F.transform(strings, lambda x: x["s"]), "\n").alias("__html"),
        F.coalesce(F.bool_or(F.col("__unread") | marked(held) & ~(kind == "STRING")), F.lit(False)).alias("deep"),
        F.any_value("payload").alias("payload"),
        *[F.any_value(c).alias(c) for c in rest],
    )
    html = F.when(F.col("deep") | (F.col("__html") == ""), F.col("payload")).otherwise(F.col("__html"))
    return direct.unionByName(whole.select(*rest, html.alias("html"), "deep"))


def marked(text: Column) -> Column:
    """Whether a text holds review markup."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in MARKS]), F.lit(False))


def raw_reviews(text: str | None) -> list[tuple]:
    """One tuple of raw texts per review container of a response."""
    return parsed_reviews(unwrap(text or ""))


def parsed_reviews(html: str) -> list[tuple]:
    """One tuple of raw texts per review container."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = list(tree.root.walk())
    containers = [n for n in nodes if n.attributes.get("data-hook") == REVIEW_HOOK]
    containers = containers or [n for n in nodes if n.tag == "div" and (n.attributes.get("id") or "").startswith(REVIEW_ID_PREFIX)]
    linked = LINKED_ITEM.search(html)
    out = []
    for box in containers:
        part = {}
        for name, hooks in PARTS.items():
            node = box.find(lambda n, hooks=hooks: n.attributes.get("data-hook") in hooks)
            part[name] = node.text() if node else None
        author = box.find(lambda n: AUTHOR_CLASS in (n.attributes.get("class") or "").split())
        review_id = (box.attributes.get("id") or "").removeprefix(REVIEW_ID_PREFIX) or None
        out.append((review_id, part["title"], part["body"], part["rating"], part["date"], author.text() if author else None, part["badge"], part["helpful"], linked[1] if linked else None))
    return out


class _ParseReviews:
    def eval(self, text: str):
        yield from raw_reviews(text)


def html_reviews_udtf():
    return F.udtf(_ParseReviews, returnType=RAW)


html_reviews = html_reviews_udtf()


def reviews(pages: DataFrame) -> DataFrame:
    """Review rows of captured pages: ``payload``, and source_url and page where known."""
    known = [F.col(c) if c in pages.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("source_url", "string"), ("page", "long"), ("collected_at", "string"))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.source_url, r.page, r.collected_at, *found) for r in frame.itertuples(index=False) for found in (raw_reviews(r.html) if r.deep else parsed_reviews(r.html or ""))]
            out = pd.DataFrame(rows, columns=["source_url", "page", "collected_at", *FIELDS], dtype=object)
            out["page"] = pd.to_numeric(out["page"]).astype("Int64")
            yield out

    found = unwrapped(pages.select("payload", *known)).mapInPandas(run, f"source_url string, page long, collected_at string, {RAW}")
    return found.select(*review_row(
        source=F.lit("amazon"),
        item_id=F.coalesce(item_id(F.col("source_url")), F.col("html_item")),
        review_id=F.col("review_id"),
        review_title=clean(F.col("title")),
        review_text=clean(F.col("body")),
        rating=star_rating(F.col("rating")),
        review_date=clean(F.col("date")),
        author_name=clean(F.col("author")),
        verified_purchase=F.col("badge").isNotNull(),
        helpful_votes=helpful_votes(F.col("helpful"), default_zero=True),
        source_url=F.col("source_url"),
        raw_page_number=F.col("page"),
        **({"collected_at": F.col("collected_at")} if "collected_at" in pages.columns else {}),
    ))
