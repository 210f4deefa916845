"""Main text of web pages: page structure, and a sparse suffix array of every host.

Markup is read in one linear pass into blocks of text. Element names and class words
say what a block is: furniture (menus, headers, footers, sidebars, notices, adverts,
forms, comments), declared content (inside ``article`` or ``main``), neither, or in
doubt: inside declared content, where a class word that may mean furniture only
proposes. What the page does not settle, the host's repeated runs decide.

The token streams of a host's pages are concatenated and their suffixes sorted to the
depth that matters (prefix doubling over token classes). The array is sparse: indexed
are suffixes at block starts and at the least run hash of every ``RUN`` consecutive
ones, so a shared passage is indexed at the same places on every page, neighbours are
at most ``RUN`` tokens apart, and a repeated block is covered for at least half.
A run of ``RUN`` tokens that occurs so on ``PAGES`` distinct pages of a host is
boilerplate. Then, block by block,

* undeclared blocks go if repeated runs cover half of them, unique ones stay;
* blocks in doubt go only if so covered;
* blocks of declared content go if runs that *most* pages of the host share cover half
  of them, unless such blocks are half of the page's content: then it is a copy of other
  pages. A line or a passage that many articles quote is not on most pages, and stays;
* undeclared unique blocks beside declared content stay only where they are the larger
  part of the page (a teaser is declared and the article is not);
* a page that would be empty keeps its undeclared blocks.

A host may hold any share of the pages, so its array is never in one task. Tasks sort
the suffixes of batches of pages and send one entry for each class of equal runs and
batch, under a hash of host and run (56 bits); one task a hash range merges the classes
and adds up their pages. Runs that enough pages share then go to the groups of pages that
hold them, where the texts are. A page's markup is read once: groups are what a task reads one
after the other, up to a size, so rows that are alike spread as any others do; their blocks are
written, compressed, to the shared folder, and runs and texts both come from there. No host is
gathered, and neither the hash ranges nor the groups grow with the table: there are more of
them instead. Only the runs of hosts of more
than ``RANGE_ENTRIES`` pages, which as a notice may be on all of them, are added up first and
told to the groups after, in parts. The verdict on a page is the same whatever the batches,
ranges, parts and groups are.

Defined cases: null or empty html gives empty text; unclosed, misnested and unknown
tags are read as browsers do, as far as blocks go; a missing or odd url makes the
host the empty one; null ids are kept; repeated rows are kept and count as pages; a page
of any length is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table_of
from .common import cut, power_of_two

#: Tokens of a repeated run, pages that must share it, and of the host's pages the share
#: that must where a page declares the run to be content.
RUN = 8
PAGES = 3
MOST = 0.5
#: Tokens sorted together in a task, for so many characters each; html bytes behind a hash
#: range, and characters of a group of pages, for which a page counts PAGE_SIZE more.
BATCH_TOKENS = 1 << 20
TOKEN_LENGTH = 6
RANGE_BYTES = 1 << 26
GROUP_BYTES = 1 << 23
PAGE_SIZE = 256
#: Blocks are written once and shuffled once, so they are packed closer than by default.
LEVEL = 7
#: Pages of a host from which its runs may be more than a task can tell the groups of pages, and
#: entries of a hash range that one task tells.
RANGE_ENTRIES = 1 << 22
TASKS = 1 << 16
#: Bits of a run's hash that travel.
HASH_BITS = 56
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

_OTHER = r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*+>|"""
_TO_GT = r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>"""
#: A tag ends at the first > outside quotes; where quotes never close, at the first >.
TOKEN = re.compile(_OTHER + r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|""" + _TO_GT, re.S)
BROKEN = re.compile(_OTHER + r"()()()" + _TO_GT, re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# What element names and attribute words mean.
RAW = frozenset("script style noscript template textarea title iframe object svg math xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form button select dialog menu head option fieldset label figcaption-ad".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset(["br", "img", "wbr"])
DECLARED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notices|alert|"
    r"sidebar|sidebars|widget|widgets|menu|menus|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|header|masthead|topbar|footer|foot|copyright|colophon|"
    r"comment|comments|commentlist|disqus|respond|reply|replies|discussion|related|recommended|recommendations|share|sharing|social|newsletter|subscribe|subscription|signup|login|"
    r"search|popup|modal|overlay|toolbar|skip|hidden|complementary|contentinfo|tags|tagcloud)(?=$|[\s_-]|\d)",
    re.I,
)
#: Words of a class that says what a part goes with or without, not what it is.
STATE = re.compile(r"^(?:has|with|without|no|is|show|hide|js)[-_]", re.I)
#: Class or id words of an element that holds the article where no tag says so.
CONTENT = re.compile(r"^(?:(?:article|post|entry|story|page|main)[-_]?(?:body|content|text)|article|post|story|main|content)$", re.I)
# Elements whose class words say nothing inside declared content, and parts of
# class words that only say what shape furniture has.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th tr dd dt caption figcaption address span a b i u em strong small code sub sup mark cite q time label abbr".split())
SHAPE = frozenset("list links link box boxes button buttons bar block area section container wrapper wrap inner posts post articles form icons items item slot unit zone".split())
#: Words that inside declared content may as well be about the article itself.
OPEN = frozenset("alert notice notices header masthead topbar footer foot copyright colophon banner search skip hidden tags tagcloud discussion reply replies widget widgets toolbar complementary contentinfo".split())
OUT, PLAIN, MAIN, DOUBT = 0, 1, 2, 3


@dataclass(slots=True)
class Block:
    text: str
    kind: int


def attributes_of(text: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'")) for name, value in ATTRIBUTE.findall(text)]


def declared_words(attributes: list[tuple[str, str]]) -> list[str]:
    return [w for name, value in attributes if name in ("class", "id", "role") for w in value.split() if not STATE.match(w)]


def furniture(tag: str, attributes: list[tuple[str, str]], in_main: bool, by_words: bool = True) -> int | None:
    """OUT if an element is declared to be something else than the article, DOUBT if it may be."""
    if tag in FURNITURE:
        return None if tag == "header" and in_main else OUT  # an article's own header holds its title
    if tag in ("html", "body", "article", "main"):
        return None
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return OUT
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUT
    if not by_words or in_main and tag in TEXT:
        return None
    words = [w for w in declared_words(attributes) if DECLARED.search(w)]
    if not in_main or any(map(all_furniture, words)):
        return OUT if words else None
    return DOUBT if words else None


def all_furniture(word: str) -> bool:
    """Whether each part of a class word speaks of furniture, one of them plainly."""
    parts = [p for p in re.split(r"[_-]|\d+", word.lower()) if p]
    plain = [p for p in parts if p not in OPEN and p not in SHAPE and DECLARED.fullmatch(p)]
    return bool(plain) and all(p in SHAPE or DECLARED.fullmatch(p) for p in parts)


def holds_article(tag: str, attributes: list[tuple[str, str]]) -> bool:
    return tag in ("article", "main") or any(name == "role" and value.lower() == "main" for name, value in attributes) or any(CONTENT.match(w) for w in declared_words(attributes))


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, white space collapsed, empty ones left out.

    A page that class words alone would empty (a wrapper named after its menu) is read
    again by its tags only.
    """
    blocks = _blocks(page, True) if page else []
    if blocks and all(b.kind == OUT for b in blocks):
        again = _blocks(page, False)
        return again if any(b.kind != OUT for b in again) else blocks
    return blocks


def _blocks(page: str, by_words: bool) -> list[Block]:
    last_close: dict[str, int] = {}
    closes: dict[str, int] = {}
    out: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, int | None, bool]] = []  # tag, OUT or DOUBT, content
    edges: list[int] = []  # places in the stack of elements that end a search for open ones
    depth_of: Counter[str] = Counter()  # open elements by tag
    aside = doubt = main = 0

    def hold(text: str):
        held.append(html.unescape(text) if "&" in text else text)  # no reference goes beyond a tag

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Block(text, OUT if aside else DOUBT if doubt else MAIN if main else PLAIN))

    def pop():
        nonlocal aside, doubt, main
        t, f, m = stack.pop()
        if edges and edges[-1] == len(stack):
            edges.pop()
        depth_of[t] -= 1
        aside -= f == OUT
        doubt -= f == DOUBT
        main -= m

    at, size, last, token = 0, len(page), page.rfind(">"), TOKEN
    while at < size:
        # Beyond the last > nothing is a tag; once quotes have failed to close, they are not
        # tried again. So no text is searched through twice.
        m = token.search(page, at) if at <= last else None
        if not m:
            hold(page[at:].partition("<!--")[0])
            break
        token = BROKEN if m[5] else token
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if closing:
            if tag in BLOCKS:
                flush()
            left = depth_of[tag] - 1
            while left >= 0 and depth_of[tag] > left:
                pop()
            continue
        if tag in RAW:
            end = _close(page, tag, at, closes)
            at = end if end > 0 else at if tag in ("object", "noscript") else size
            continue
        if tag in SPACED:
            held.append(" ")
        if tag in BLOCKS:
            flush()
            if tag in ("p", "li", "dd", "dt", "td", "th", "tr", "option", "h1", "h2", "h3", "h4", "h5", "h6"):
                _imply(stack, edges, tag, pop)
        if tag in VOID or attributes.endswith("/"):
            continue
        if attributes:
            named = attributes_of(attributes)
            side = furniture(tag, named, main > 0, by_words)
            if side is not None and tag not in FURNITURE:
                if tag not in last_close:
                    last_close[tag] = page.lower().rfind(f"</{tag}")
                side = side if last_close[tag] >= at else None  # never closed, it would swallow the page
            whole = side is None and holds_article(tag, named)
        else:
            side = OUT if tag in FURNITURE and not (tag == "header" and main) else None
            whole = tag == "article" or tag == "main"
        if tag in BLOCKS or side == OUT:
            edges.append(len(stack))
        stack.append((tag, side, whole))
        depth_of[tag] += 1
        aside += side == OUT
        doubt += side == DOUBT
        main += whole
    flush()
    return out


def _close(page: str, tag: str, at: int, closes: dict[str, int]) -> int:
    """Past the end tag that follows, or 0; a search that failed is not made again."""
    if closes.get(tag) == -1:
        return 0
    m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    closes[tag] = 0 if m else -1
    return m.end() if m else 0


def _imply(stack, edges, tag, pop) -> None:
    """A new paragraph, item or cell ends an open one of its kind, and inline tags in it."""
    if edges and stack[edges[-1]][0] in (tag, "p"):
        for _ in range(len(stack) - edges[-1]):
            pop()


def streams(pages: list[list[Block]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each page, hashes of its tokens and the block of each; furniture is no part of a stream.

    Equal tokens are hashed once.
    """
    digest = xxhash.xxh3_64_intdigest
    texts = [b.text for blocks in pages for b in blocks if b.kind != OUT]
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    words = pc.dictionary_encode(split.flatten())
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.array([digest(w) for w in words.dictionary.to_pylist()], np.uint64)
    tokens = known[words.indices.to_numpy(zero_copy_only=False)] if len(known) else known
    out, at, nth = [], 0, 0
    for blocks in pages:
        stays = [k for k, b in enumerate(blocks) if b.kind != OUT]
        mine = size[nth : nth + len(stays)]
        n = int(mine.sum())
        out.append((tokens[at : at + n], np.repeat(np.array(stays, np.int64), mine)))
        at, nth = at + n, nth + len(stays)
    return out


def words_of(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    return streams([blocks])[0]


def run_hashes(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of the run at each token that starts one."""
    hashes = np.zeros(max(0, len(tokens) - run + 1), np.uint64)
    for j in range(run if len(hashes) else 0):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + len(hashes)]
    hashes ^= hashes >> np.uint64(32)
    return hashes * np.uint64(0xD6E8FEB86659FD93)


def indexed(hashes: np.ndarray, block: np.ndarray, run: int = RUN) -> np.ndarray:
    """The places whose suffixes are in the array: block starts, least hashes of ``run`` in a row."""
    n = len(hashes)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][:n]) if n else np.zeros(0, np.int64)
    if n < run:
        return starts
    least = np.lib.stride_tricks.sliding_window_view(hashes, run).argmin(axis=1) + np.arange(n - run + 1)
    return np.union1d(starts, least)


def keyed(hashes: np.ndarray, host: str) -> np.ndarray:
    """Runs of a host, under hashes that other hosts do not use."""
    mixed = (hashes ^ np.uint64(host_key(host))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - HASH_BITS)


def host_key(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host, 1)


def pages_key(host: str) -> int:
    """Under which the pages of a host are counted."""
    return xxhash.xxh3_64_intdigest(host, 2) >> (64 - HASH_BITS)


def suffix_classes(classes: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the suffixes by their first ``depth`` tokens: a suffix array to that depth.

    Prefix doubling; the last step overlaps its halves to meet the depth exactly, and ranks
    only the suffixes ``at`` some places, if given.
    """
    rank, n, length = classes, len(classes), 1
    while length < depth:
        step = min(length, depth - length)
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        pair = rank * (n + 1) + after + 1
        length += step
        _, rank = np.unique(pair if length < depth or at is None else pair[at], return_inverse=True)
        rank = rank.astype(np.int64)
    return rank


def batch_classes(pages: list[tuple[int, str, np.ndarray, np.ndarray]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal runs in a batch of (group, host, tokens, block of each token).

    (hash, group, pages): one entry for each class and group that holds it, with the number of
    distinct pages there; and one for each host and group, with its pages.
    """
    counted = Counter((host, group) for group, host, *_ in pages)
    places, hashes, at = [], [], 0
    for _, host, tokens, block in pages:
        h = run_hashes(tokens, run)
        where = indexed(h, block, run)
        places.append(where + at)
        hashes.append(keyed(h[where], host))
        at += len(tokens) + 1
    h, page = np.concatenate(hashes), np.repeat(np.arange(len(pages)), [len(x) for x in places])
    _, classes = np.unique(np.concatenate([np.append(tokens ^ np.uint64(host_key(host)), np.uint64(0)) for _, host, tokens, _ in pages]), return_inverse=True)
    ends = np.cumsum([len(tokens) + 1 for *_, tokens, _ in pages]) - 1
    classes = classes.astype(np.int64)
    classes[ends] = classes.max(initial=0) + 1 + np.arange(len(ends))  # no run goes beyond a page
    rank = suffix_classes(classes, run, np.concatenate(places))
    # The suffix array; a page counts once for a run.
    at_once = np.unique(rank * len(pages) + page, return_index=True)[1]
    rank, g, h = rank[at_once], np.array([group for group, *_ in pages], np.int64)[page[at_once]], h[at_once]
    order = np.lexsort((g, rank))
    rank, g, h = rank[order], g[order], h[order]
    first = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (g[1:] != g[:-1])][: len(rank)])
    hosts = list(counted)
    return (
        np.r_[h[first], np.array([pages_key(host) for host, _ in hosts], np.uint64)],
        np.r_[g[first], np.array([group for _, group in hosts], np.int64)],
        np.r_[np.diff(np.r_[first, len(rank)]), np.array([counted[x] for x in hosts], np.int64)],
    )


def batch_entries(pages: list[tuple[int, str, np.ndarray, np.ndarray]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hash, group): one entry for each indexed run, and each host, of a group of pages."""
    h, g = [], []
    for group, host, tokens, block in pages:
        r = run_hashes(tokens, run)
        mine = np.append(keyed(r[indexed(r, block, run)], host), np.uint64(pages_key(host)))
        h.append(mine)
        g.append(np.full(len(mine), group, np.int64))
    h, g = np.concatenate(h), np.concatenate(g)
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    return h[new], g[new]


def planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that those of small numbers compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def squeeze(hashes: np.ndarray, *more: np.ndarray) -> list[bytes]:
    """Hashes in ascending order as their steps, and what goes with them, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(planes(np.diff(hashes.astype("<u8"), prepend=np.uint64(0))))] + [pack(planes(x.astype("<u8"))) for x in more]


def expand(data: bytes) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(data), "<u8")


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches of equal values."""
    bounds = np.r_[np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)]), len(values)]
    return zip(bounds[:-1], bounds[1:])


def unpack(ends: bytes, packed: bytes) -> list[list[Block]]:
    """The blocks of a group's pages, furniture left out."""
    whole, at, out = zstandard.ZstdDecompressor().decompress(packed) if packed else b"", 0, []
    for end in np.frombuffer(ends, "<i8"):
        text, at = whole[at:end].decode("utf-8", "surrogatepass"), int(end)
        out.append([Block(b[1:], int(b[0])) for b in text.split("\n")] if text else [])
    return out


def ranged(make, ranges: int, batch_tokens: int, names: list[str], wanted):
    """An Arrow function from groups of pages to what ``make`` says of a batch of pages, a row a hash range.

    Pages of the hosts that are ``wanted`` count.
    """
    shift = np.uint64(HASH_BITS - ranges.bit_length() + 1)
    types = [pa.int64()] + [pa.binary()] * (len(names) - 1)

    def emit(held: list) -> pa.RecordBatch:
        h, *more = make([(group, host, *stream) for (group, host, _), stream in zip(held, streams([blocks for *_, blocks in held]))])
        order = np.argsort(h, kind="stable")
        h, more = h[order], [x[order] for x in more]
        part = (h >> shift).astype(np.int64)
        out = [(int(part[a]), *squeeze(h[a:b], *(x[a:b] for x in more))) for a, b in runs_of(part)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for group, hosts, ends, packed in zip(*batch.columns):
                for host, blocks in zip(hosts.as_py(), unpack(ends.as_py(), packed.as_py())):
                    if not wanted(host):
                        continue
                    held.append((group.as_py(), host, blocks))
                    size += sum(len(b.text) for b in blocks) // TOKEN_LENGTH + 1
                    if size >= batch_tokens:
                        yield emit(held)
                        held, size = [], 0
        if held:
            yield emit(held)

    return read


def told(h: np.ndarray, g: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """(grp, hashes, pages) of runs (hash, group, pages of the host), each once a group."""
    order = np.lexsort((h, g))
    h, g, n = h[order], g[order], n[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])][: len(g)]
    h, g, n = h[new], g[new], n[new]
    return pd.DataFrame([(int(g[a]), *squeeze(h[a:b], n[a:b])) for a, b in runs_of(g)], columns=["grp", "hashes", "pages"])


TOLD = "grp long, hashes binary, pages binary"
PACKED = ["grp", "host", "ends", "packed"]


def shared_runs(read: DataFrame, large: frozenset[str], ranges: int, run: int, least: int, batch_tokens: int) -> DataFrame:
    """(grp, hashes, pages): of each group of pages, the runs that ``least`` pages of their host share.

    ``read`` is what ``read_pages`` gives; the ``large`` hosts are left out. ``pages`` says how many pages share a run; the pages of a
    host are counted under the host's own key.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.cumsum(expand(x), dtype=np.uint64) for x in pdf["hashes"]])
        g, n = (np.concatenate([expand(x) for x in pdf[c]]).astype(np.int64) for c in ("grps", "pages"))
        _, which = np.unique(h, return_inverse=True)
        n = np.bincount(which, n).astype(np.int64)[which]
        return told(h[n >= least], g[n >= least], n[n >= least])

    names = ["part", "hashes", "grps", "pages"]
    counted = read.select(*PACKED).mapInArrow(ranged(lambda held: batch_classes(held, run), ranges, batch_tokens, names, lambda host: host not in large), "part long, hashes binary, grps binary, pages binary")
    return counted.groupBy("part").applyInPandas(merge, TOLD)


def shared_runs_of_large_hosts(read: DataFrame, large: frozenset[str], ranges: int, run: int, least: int, batch_tokens: int, range_entries: int) -> DataFrame:
    """What ``shared_runs`` gives, for hosts whose runs may be on more pages than a task can tell.

    Pages are added up without saying which groups they are in, so that a run is one entry a
    batch however frequent it is. Then the groups are told, and a range with more than
    ``range_entries`` pages to tell is split by group.
    """

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.cumsum(expand(x), dtype=np.uint64) for x in pdf["hashes"]])
        n = np.concatenate([expand(x) for x in pdf["pages"]]).astype(np.int64)
        h, which = np.unique(h, return_inverse=True)
        n = np.bincount(which, n).astype(np.int64)
        h, n = h[n >= least], n[n >= least]
        return pd.DataFrame([(pdf["part"].iloc[0], *squeeze(h, n), 1 + int(n.sum()) // range_entries)], columns=["part", "hashes", "pages", "splits"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "split", "hashes", "grps"]
        for batch in batches:
            out = []
            for part, hashes, grps, splits in zip(*(c.to_pylist() for c in batch.columns)):
                if splits is None:
                    out.append((part, 0, hashes, grps))
                    continue
                h, g = np.cumsum(expand(hashes), dtype=np.uint64), expand(grps).astype(np.int64)
                to = g % splits
                out += [(part, int(i), *squeeze(h[to == i], g[to == i])) for i in np.unique(to)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    def tell(entries: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known_h = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(expand(x), dtype=np.uint64) for x in known["hashes"])])
        if not len(entries) or not len(known_h):
            return pd.DataFrame({c: [] for c in ("grp", "hashes", "pages")})
        known_n = np.concatenate([expand(x) for x in known["pages"]]).astype(np.int64)
        hs, gs = [], []
        for row in entries.itertuples(index=False):
            h, g = np.cumsum(expand(row.hashes), dtype=np.uint64), expand(row.grps).astype(np.int64)
            is_known = known_h[np.minimum(np.searchsorted(known_h, h), len(known_h) - 1)] == h
            hs.append(h[is_known])
            gs.append(g[is_known])
        h, g = np.concatenate(hs), np.concatenate(gs)
        return told(h, g, known_n[np.searchsorted(known_h, h)])

    def without_groups(held):
        h, _, n = batch_classes([(0, *page) for _, *page in held], run)
        return h, n

    counted = read.select(*PACKED).mapInArrow(ranged(without_groups, ranges, batch_tokens, ["part", "hashes", "pages"], large.__contains__), "part long, hashes binary, pages binary")
    totals = cut(counted.groupBy("part").applyInPandas(total, "part long, hashes binary, pages binary, splits long"))
    entries = read.select(*PACKED).mapInArrow(ranged(lambda held: batch_entries(held, run), ranges, batch_tokens, ["part", "hashes", "grps"], large.__contains__), "part long, hashes binary, grps binary")
    hot = totals.where("splits > 1").select("part", "splits")
    entries = entries.join(hot, "part", "left").select("part", "hashes", "grps", "splits").mapInArrow(split, "part long, split long, hashes binary, grps binary")
    known = totals.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
    return entries.groupBy("part", "split").cogroup(known.groupBy("part", "split")).applyInPandas(tell, TOLD)


def shares(stream: tuple[np.ndarray, np.ndarray], n_blocks: int, host: str, known: np.ndarray, pages: np.ndarray, run: int = RUN, least: int = PAGES, most: float = MOST) -> tuple[np.ndarray, np.ndarray]:
    """For each block of a page (its stream, its number of blocks), the share of its tokens in runs that ``least`` pages of the
    host share, and in runs that more than ``most`` of all its pages do.

    ``known`` (ascending) and ``pages``: the runs that enough pages share, and how many do.
    """
    tokens, block = stream
    hashes = run_hashes(tokens, run)
    where = indexed(hashes, block, run)
    out = np.zeros((2, n_blocks))
    if not len(known) or not len(where):
        return out[0], out[1]

    def count(keys):
        near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[near] == keys, pages[near], 0)

    shared = count(keyed(hashes[where], host))
    whole = count(np.array([pages_key(host)], np.uint64))[0]
    size = np.bincount(block, minlength=n_blocks)
    for i, bar in enumerate((least, max(least, whole * most + 1))):
        hit = where[shared >= bar]
        edge = np.zeros(len(tokens) + 1, np.int64)
        edge[hit] += 1
        edge[hit + run] -= 1
        out[i] = np.bincount(block, np.cumsum(edge)[: len(tokens)] > 0, minlength=n_blocks) / np.maximum(1, size)
    return out[0], out[1]


def unique_text(blocks: list[Block], share: np.ndarray, common: np.ndarray | None = None) -> tuple[str, int]:
    """Main text of a page, and how many of its blocks repetition marks.

    ``share`` and ``common``: of each block, the share of its tokens in runs that several, and
    that most pages of the host hold.
    """
    common = share if common is None else common
    size = [b.text.count(" ") + 1 for b in blocks]
    content = sum(n for b, n in zip(blocks, size) if b.kind in (MAIN, DOUBT))
    usual = sum(n for b, n, c in zip(blocks, size, common) if b.kind in (MAIN, DOUBT) and c >= 0.5)
    copied = 2 * usual >= content
    stays = [b.kind == PLAIN and s < 0.5 or b.kind == DOUBT and s < 0.5 or b.kind == MAIN and (copied or c < 0.5) for b, s, c in zip(blocks, share, common)]
    declared = sum(n for b, n, k in zip(blocks, size, stays) if k and b.kind != PLAIN)
    beside = sum(n for b, n, k in zip(blocks, size, stays) if k and b.kind == PLAIN)
    if declared >= beside:
        stays = [k and b.kind != PLAIN for b, k in zip(blocks, stays)]
    text = [b.text for b, k in zip(blocks, stays) if k] or [b.text for b in blocks if b.kind != OUT]
    return "\n".join(text), int((np.asarray(share) >= 0.5).sum())


def read_pages(group_bytes: int):
    """An Arrow function from (page_id, url, host, html) to groups of pages, their blocks compressed together.

    A group is named after its task and place; as ids are given when the groups are written,
    all that comes after finds the same.
    """

    def emit(group: int, size: int, held: list) -> pa.RecordBatch:
        page_id, url, host, n, raw = zip(*held)
        ends = np.cumsum([len(t) for t in raw]).astype("<i8").tobytes()
        row = (group, size, host, page_id, url, n, ends, zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(raw)))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _READ.values())], names=list(_READ))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size, chars = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for page_id, url, host, page in zip(*batch.columns):
                page = page.as_py()
                blocks = blocks_of(page)
                # Block texts hold no line ends.
                text = "\n".join(f"{b.kind}{b.text}" for b in blocks if b.kind != OUT)
                held.append((page_id.as_py(), url.as_py(), host.as_py(), len(blocks), text.encode("utf-8", "surrogatepass")))
                chars += len(page or "")
                size += len(page or "") + PAGE_SIZE
                if size >= group_bytes:
                    yield emit(group, chars, held)
                    group, held, size, chars = group + 1, [], 0, 0
        if held:
            yield emit(group, chars, held)

    return read


_READ = {"grp": pa.int64(), "size": pa.int64(), "host": pa.list_(pa.string()), "page_id": pa.list_(pa.int64()), "url": pa.list_(pa.string()), "n_blocks": pa.list_(pa.int64()), "ends": pa.binary(), "packed": pa.binary()}
READ = "grp long, size long, host array<string>, page_id array<long>, url array<string>, n_blocks array<long>, ends binary, packed binary"


def extract(pages: DataFrame, run: int = RUN, least: int = PAGES, batch_tokens: int = BATCH_TOKENS, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Per row: page_id, url, text, n_blocks and n_repeated (blocks that repetition marks)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", "url", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"), "html")
    read = table_of(rows.mapInArrow(read_pages(group_bytes), READ))
    size, groups = read.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = power_of_two(size / range_bytes, 8, 1 << 40)
    # At most one host for each ``range_entries`` pages.
    named = read.select(F.explode("host").alias("host")).groupBy("host").count()
    large = frozenset(r["host"] for r in named.where(F.col("count") > range_entries).select("host").collect())

    def local(sent: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        known = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(expand(x), dtype=np.uint64) for x in runs["hashes"])])
        counts = np.concatenate([np.zeros(0, np.uint64), *(expand(x) for x in runs["pages"])]).astype(np.int64)
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        out = []
        for row in sent.itertuples(index=False):
            blocks_read = unpack(row.ends, row.packed)
            for host, page_id, url, n, blocks, stream in zip(row.host, row.page_id, row.url, row.n_blocks, blocks_read, streams(blocks_read)):
                share, common = shares(stream, len(blocks), host, known, counts, run, least)
                text, marked = unique_text(blocks, share, common)
                out.append((None if page_id is None else int(page_id), url, text, int(n), marked))
        table = pd.DataFrame(out, columns=["page_id", "url", "text", "n_blocks", "n_repeated"])
        table["page_id"] = table["page_id"].astype("Int64")
        return table

    runs = shared_runs(read, large, ranges, run, least, batch_tokens)
    if large:
        runs = runs.unionByName(shared_runs_of_large_hosts(read, large, ranges, run, least, batch_tokens, range_entries))
    # As many tasks as there are groups, within what a driver can schedule. Ids travel as text,
    # which a list with nulls keeps exact.
    tasks = min(max(groups, 1), TASKS)
    sent = read.select("grp", "host", F.col("page_id").cast("array<string>").alias("page_id"), "url", "n_blocks", "ends", "packed")
    sent, runs = sent.repartition(tasks, "grp"), runs.repartition(tasks, "grp")
    return sent.groupBy("grp").cogroup(runs.groupBy("grp")).applyInPandas(local, "page_id long, url string, text string, n_blocks long, n_repeated long")
