"""Operator 9, HTML extraction: consensus host paths.

Each page's containers (article, main, section, div, td, body) are scored by the text of the blocks in them, less what stands
in links. A container's path is its tags with classes and ids, digits generalised. In Spark the pages of a host vote: every
page gives the scores of all its containers to their paths, summed by (host, path), and the host's best path wins. Every page
is then read again and the text of the containers at its host's winning path is taken: the whole article (or main element) in
which such a container stands, else its blocks and those directly in the containers around it (headline, lead, close); a page
that has none gives its own best container. Menus, headers, footers, forms, scripts and styles, as their tags name them, never count as text.

Classes and ids that sound like sidebars, notices, adverts or comments only make an element suspect, for wrappers of whole
articles have such names too (`with-sidebar`). A suspect goes if what stands outside all suspects is at least a fifth of its
text, or if it is mostly links and anything stands outside; else it is cleared, the largest first, mere parts of names before
whole names, and counts as outside for the rest. What is named as readers' comments goes however long it is, if anything
stands outside; it is cleared last.

Null or empty html gives empty text, 0 characters. A page of any length is read whole, in time that grows with its length. A
null url is a host of its own. Of host paths with equal scores the shorter wins, then the later by name; of a page's own
containers the first by name. Tags left open end with their parent or the page; a tag cut off by the page's end is dropped. Rows may repeat; each votes. A column named like an output is replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, each
from palimpsest.llm.url_filters import host_of

#: Elements by their part in a page.
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = frozenset("article main section div td th tr table tbody thead body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address center details summary hr html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form button select option textarea input label dialog menu iframe object svg canvas noscript template title".split())
RAW = ("script", "style", "textarea", "noscript", "template", "xmp")
#: Words in a class or id that make an element suspect; a header only as a whole name, for articles have headers too.
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:(?<!\S)(?:header|masthead)(?!\S)|ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|notices|newsletter|subscribe|sidebar|side|nav\w*|menu|breadcrumb\w*|footer|comment|comments|disqus|reply|replies|respond|related|share|social|popup|modal|login|signup|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])", re.I)
#: Whole names that hold what readers write: such an element goes however long it is, if anything stands outside.
READERS = frozenset("comment comments disqus replies respond".split())
#: What a start tag closes when it is open in the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")} | {b: ("p",) for b in BLOCKS if b not in ("li", "dt", "dd", "tr", "td", "th")}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/A-Za-z][^>]*\Z", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")
#: White space inside a block.
BLANKS = re.compile(r"\s+")
#: A container counts for its blocks up to so many containers deeper; a path has so many steps at most.
DEEP = 32
#: A suspect goes if the text outside suspects is at least this share of its own.
OUTSIDE = 0.2


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(paths of the containers around it, text, characters of it in links) of each block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    within: list[tuple[int, ...]] = []  # of each block, the suspects around it
    suspects: list[int] = []  # 0 if part of a name is a word for it, 1 if the whole name is, 2 if readers write there
    stack: list[tuple[str, str, bool, int]] = []  # name, container path or "", whether it is dropped, number of the suspect or -1
    steps: dict[tuple[str, str], str] = {}
    text: list[str] = []
    links = dropped = 0

    def flush() -> None:
        nonlocal links
        if text:
            inner = stack[-4 * DEEP :]
            if joined := BLANKS.sub(" ", unescape("".join(text))).strip(" "):
                out.append((tuple([path for _, path, _, _ in inner if path][-DEEP:]), joined, links))
                within.append(tuple([k for _, _, _, k in inner if k >= 0][-DEEP:]))
            text.clear()
        links = 0

    def pop(k: int) -> None:
        nonlocal dropped
        while len(stack) > k:
            name, _, off, suspect = stack[-1]
            if name in BLOCKS or suspect >= 0:
                flush()
            stack.pop()
            dropped -= off

    at = 0
    for m in TOKEN.finditer(page):
        if not dropped and m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if stack and stack[-1][0] == "a":
                links += len(piece)
        at = m.end()
        name = m[3].lower() if m[3] else ""
        if not name:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in CONTAINERS and name not in CONTAINERS and name not in BLOCKS and name not in DROPPED:
                    break  # an inline end tag doesn't close a container
            continue
        if name == "br":
            text.append(" ")
        if name in VOID:
            if name in BLOCKS and not dropped:
                flush()
            continue
        if name in BLOCKS or name in DROPPED:
            if not dropped:
                shut = CLOSES.get(name, ("p",))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        pop(k)
                        break
                    if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
                flush()
        attrs = m[4]
        named = " ".join(f"{a or b or c}" for _, a, b, c in NAMED.findall(attrs)) if attrs and name not in ("body", "html") else ""
        off = name in DROPPED
        suspect = -1
        if named and not off and not dropped and (word := BOILERPLATE.search(named)):
            flush()
            suspect = len(suspects)
            names = named.lower().split()
            suspects.append(2 if READERS.intersection(names) else int(word[0].strip().lower() in names))
        path = ""
        if name in CONTAINERS:
            above = next((p for _, p, _, _ in reversed(stack) if p), "")
            key = (name, named)
            if key not in steps:
                steps[key] = ".".join([name, *DIGITS.sub("0", named.lower()).split()])
            path = ">".join([*above.split(">")[1 - DEEP :], steps[key]]) if above else steps[key]
        stack.append((name, path, off, suspect))
        dropped += off
    if not dropped and at < len(page):
        text.append(page[at:])
    pop(0)
    flush()
    return [b for b, gone in zip(out, judged(out, within, suspects), strict=True) if not gone] if suspects else out


def judged(blocks: list, within: list[tuple[int, ...]], suspects: list[int]) -> list[bool]:
    """Of each block, whether a suspect around it goes."""
    size, linked = [0] * len(suspects), [0] * len(suspects)
    outside = 0
    by_first: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # blocks by their outermost suspect not cleared
    for (_, text, links), around in zip(blocks, within, strict=True):
        plain = max(0, len(text) - links)
        for k in around:
            size[k] += len(text)
            linked[k] += links
        if around:
            by_first[around[0]].append((plain, around[1:]))
        else:
            outside += plain
    gone: set[int] = set()
    for k in sorted(range(len(suspects)), key=lambda k: (suspects[k], -size[k], k)):
        if outside >= OUTSIDE * size[k] or (2 * linked[k] > size[k] or suspects[k] == 2) and outside > 0:
            gone.add(k)
            continue
        # Cleared: what no other suspect holds stands outside now, what others hold waits for them.
        for first in list(by_first):
            kept = []
            for plain, rest in by_first.pop(first):
                left = tuple(x for x in ((first, *rest)) if x != k)
                if left:
                    kept.append((plain, left))
                else:
                    outside += plain
            for plain, left in kept:
                by_first[left[0]].append((plain, left[1:]))
    return [any(k in gone for k in around) for around in within]


def scores(blocks: list) -> dict[str, float]:
    """Score of each container path: characters of its blocks outside links; what is one container deeper counts a little less.

    Article and main elements count half as much again, since pages name their text so.
    """
    total: dict[str, float] = defaultdict(float)
    for paths, text, links in blocks:
        plain = max(0, len(text) - 2 * links)
        for depth, path in enumerate(reversed(paths)):
            named = path.rpartition(">")[2].partition(".")[0]
            total[path] += plain * 0.9**depth * (1.5 if named in ("article", "main") else 1)
    return total


def _best(total: dict[str, float], n: int) -> list[tuple[str, float]]:
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:n]


def votes(html: Column) -> Column:
    """array<struct<path,score>>: a page's containers; its best one has 1000, others the square of their share of that.

    So pages have equal weight, however long. Whole numbers add up alike in any order.
    """

    @F.arrow_udf("array<struct<path:string,score:double>>")
    def vote(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64())]))
        totals = [scores(blocks_of(x)) if x else {} for x in each(pages)]
        return pa.array([[{"path": p, "score": float(round(1000 * (s / top) ** 2))} for p, s in t.items()] if (top := max(t.values(), default=0)) else [] for t in totals], kind)

    return vote.asNondeterministic()(html)


def around(path: str) -> tuple[str | None, frozenset[str]]:
    """Of a container: the innermost article (else main) that it is or stands in, and the div and section containers around it."""
    steps = path.split(">")
    above = [">".join(steps[: k + 1]) for k in range(len(steps))]
    tag = lambda p: p.rpartition(">")[2].partition(".")[0]
    for name in ("article", "main"):
        if own := [p for p in above if tag(p) == name]:
            return own[-1], frozenset()
    return None, frozenset(p for p in above[:-1] if tag(p) in ("div", "section"))


def main_text(page: str | None, path: str | None) -> str:
    """The text of the containers at the path; without such text, that of the page's best container.

    The container's article is the text, if it stands in one; else its own blocks, and those that stand directly in the containers
    around it, as a headline, a lead and a close stand around a body.
    """
    blocks = blocks_of(page) if page else []
    if not any(path in paths for paths, _, _ in blocks):
        best = _best(scores(blocks), 1)
        path = best[0][0] if best else None
    if path is None:
        return " ".join(text for _, text, _ in blocks)
    article, beside = around(path)
    return " ".join(text for paths, text, _ in blocks if (article or path) in paths or paths and paths[-1] in beside)


def extract(html: Column, path: Column) -> Column:
    @F.arrow_udf("string")
    def texts(pages: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(map(main_text, each(pages), each(paths)), pa.string())

    return texts(html, path)


def host_paths(pages: DataFrame, html: str = "html") -> DataFrame:
    """host, path: each host's winning path. pages need host."""
    each = pages.select("host", F.explode(votes(F.col(html))).alias("v"))
    sums = each.groupBy("host", F.col("v.path").alias("path")).agg(F.sum("v.score").alias("score"))
    best = F.max(F.struct(F.col("score"), -F.length("path"), F.col("path")))  # of equals the shorter, then the later by name
    return sums.groupBy("host").agg(best.alias("b")).select("host", F.col("b.path").alias("path"))


#: Up to so many hosts (rows of a hundred bytes) are broadcast; beyond it Spark shuffles and splits hot hosts.
FEW = 50_000


def html_extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with text and n_chars."""
    hosted = pages.withColumn("__host", F.coalesce(host_of(F.col(url)), F.lit("")))
    winners = cut(host_paths(hosted.select(F.col("__host").alias("host"), html), html)).select(F.col("host").alias("__h"), F.col("path").alias("__path"))
    if winners.count() <= FEW:
        winners = F.broadcast(winners)
    read = hosted.join(winners, F.col("__host") == F.col("__h"), "left")
    out = read.withColumn("text", extract(F.col(html), F.col("__path")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).drop("__host", "__h", "__path")
