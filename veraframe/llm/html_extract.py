"""Main-text extraction: boosted trees over DOM-node features with hierarchical decoding.

A page is parsed into its block nodes. Each gets features of its subtree (text, words, links, punctuation, blocks, as
densities and as shares of parent and page), of the tokens of its and its ancestors' class, id and role attributes, of
its depth and of its siblings. Boosted trees give each node the log-odds that it belongs to the article. Decoding is
hierarchical: a node can only be kept if all its ancestors are, and the kept tree is the one with the largest sum of
log-odds, found by one pass up (what keeping a node gains with its best descendants) and one down. So an ancestor that
is dropped can't have a kept descendant, and no choice contradicts another.

Training uses at most ``TRAIN_PAGES`` pages, those with the smallest hashes of their ids among the pages that mark their
article with ``article`` or ``main``: blocks within it that no menu, form, aside, footer or the like holds are positive,
as are its ancestors. Each page is used as it is and in variants in which the telling tags are plain blocks, boilerplate
has other tags and class names, and a sidebar, notice, form or comments are added, so that the model also works where
nothing is marked. Everything else covers all pages and whole texts.

Text: character references are decoded, white space inside a block becomes one blank, blocks are trimmed, empty ones are
left out, and blocks are joined in page order by one line end.

Defined cases: an empty table gives no rows; null and empty pages have the empty text; without any page that marks its
article, all blocks outside boilerplate tags are kept; unclosed and stray tags are closed as browsers do; copies get
equal texts; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraframe.llm.boosted_trees import BoostedTrees, fit
from veraframe.llm.common import fresh, small_batches

TRAIN_PAGES = 300

MATHML = "math mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts mstyle mpadded mphantom merror menclose mtable mtr mtd maction semantics annotation"
INLINE = frozenset(f"{MATHML} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Nothing inside is shown. Without their end tag, only the start tag is passed over.
HIDDEN = frozenset("svg template iframe select".split())
#: What can stand in head; any other start tag, and text, ends it.
IN_HEAD = RAW - {"textarea"} | frozenset("head base basefont bgsound link meta noscript template".split())
#: These can stand within a paragraph.
IN_P = frozenset("noscript object canvas".split())
BOILER = frozenset("nav footer header aside form menu dialog button fieldset dir address".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl dt dd".split())
#: Opening one of these closes an open one of the named tags, as browsers do.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
GOOD_WORDS = "article content post entry story body text main page blog"
BAD_WORDS = "nav menu foot footer head header side sidebar aside ad ads advert advertisement sponsor promo banner cookie consent notice alert comment comments reply share social related recommend widget subscribe newsletter login signup form popup modal breadcrumb pager pagination tags meta toolbar search disqus hidden"
GOOD, BAD = frozenset(GOOD_WORDS.split()), frozenset(BAD_WORDS.split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Block nodes in page order (a parent before its children) and text segments (node, block number, text, in a link)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    good: list[int] = field(default_factory=lambda: [0])
    bad: list[int] = field(default_factory=lambda: [0])
    main: list[bool] = field(default_factory=lambda: [False])
    segments: list[tuple[int, int, str, bool]] = field(default_factory=list)

    def add(self, parent: int, tag: str, attrs: str = "") -> int:
        good = bad = 0
        main = tag in MAIN
        if "=" in attrs:
            for m in _ATTR.finditer(attrs):
                value = (m[1] or m[2] or m[3] or "").lower()
                words = set(_WORD.findall(value))
                good, bad, main = good + len(words & GOOD), bad + len(words & BAD), main or value in ("main", "articlebody")
        for column, v in ((self.parent, parent), (self.tag, tag), (self.good, good), (self.bad, bad), (self.main, main)):
            column.append(v)
        return len(self.tag) - 1


def raw_end(source: str, name: str, pos: int) -> int:
    """Where the end tag of a raw element begins; -1 if there is none."""
    end = re.compile(f"</{name}", re.I).search(source, pos)
    return end.start() if end else -1


def hidden_ends(source: str) -> dict[int, int]:
    """Ends of the hidden elements that have an end tag, by the end of their start tag."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {name: [] for name in HIDDEN}
    pos = 0
    while found := _TAG.search(source, pos):
        pos, name = found.end(), (found[2] or "").lower()
        if name in HIDDEN:
            if not found[1]:
                if not found[3].endswith("/"):
                    begun[name].append(pos)
            elif begun[name]:
                out[begun[name].pop()] = pos
        elif name in RAW and not found[1] and not found[3].endswith("/"):
            pos = raw_end(source, name, pos)
            if pos < 0:
                break
    return out


def parse(source: str) -> Page:
    page, stack, links, block, head = Page(), [0], 0, 0, False
    ends = None
    at = 0

    def text(lo: int, hi: int) -> None:
        nonlocal head
        if hi > lo:
            s = source[lo:hi]
            head = head and not s.strip()
            if not head:
                page.segments.append((stack[-1], block, html.unescape(s) if "&" in s else s, links > 0))

    pos = 0
    while found := _TAG.search(source, pos):
        text(at, found.start())
        at = pos = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        if head:
            head = name not in ("head", "body", "html", "br") if closing else name in IN_HEAD
            if head and name not in RAW and name not in HIDDEN or closing and name == "head":
                continue
        if name == "head":
            head = not closing and not found[3].endswith("/")
            block += 1
        elif name in RAW or name in HIDDEN:
            if not closing and not found[3].endswith("/"):
                if name in RAW:  # nothing inside is markup
                    at = pos = raw_end(source, name, pos)
                    if pos < 0:
                        at = len(source)
                        break
                else:
                    ends = hidden_ends(source) if ends is None else ends
                    at = pos = ends.get(pos, pos)
            block += 1
        elif name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
        elif name in VOID:
            if name == "br":
                page.segments.append((stack[-1], block, " ", False))
            elif name == "hr":
                block += 1
        elif closing:
            block, links = block + 1, 0
            if any(page.tag[n] == name for n in stack[1:]):
                while page.tag[stack.pop()] != name:
                    pass
        else:
            block, links = block + 1, 0
            shut = CLOSES.get(name, ("p",))
            if name not in IN_P and (page.tag[stack[-1]] in shut or page.tag[stack[-1]] == "p"):
                stack.pop()
                if len(stack) > 1 and page.tag[stack[-1]] in shut:
                    stack.pop()
            stack.append(page.add(stack[-1], name, found[3]))
    text(at, len(source))
    return page


FEATURES = 30


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all pages' nodes, parent's index among them (-1: none), where each page's nodes begin)."""
    sizes = np.array([len(p.tag) for p in pages])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(pages) else np.zeros(0, int)
    n = int(sizes.sum())
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, begins, strict=True)]) if n else np.zeros(0, int)
    tags = [t for p in pages for t in p.tag]
    flat = lambda name: np.array([v for p in pages for v in getattr(p, name)], float)
    own = np.zeros((n, 4))  # characters, characters in links, words, sentence marks
    for p, b in zip(pages, begins, strict=True):
        for node, _, s, link in p.segments:
            row, size = own[b + node], len(s)
            row[0] += size
            row[1] += size * link
            row[2] += s.count(" ") + 1
            row[3] += s.count(".") + s.count(",")
    good, bad, main = flat("good"), flat("bad"), flat("main")
    boiler = np.array([t in BOILER for t in tags], float)
    depth, position = np.zeros(n), np.arange(n) - np.repeat(begins, sizes)
    up_good, up_bad, up_main, up_boiler = good.copy(), bad.copy(), main.copy(), boiler.copy()
    levels = []
    todo = np.flatnonzero(parent < 0)
    inner = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[inner], np.arange(n), "left")
    last = np.searchsorted(parent[inner], np.arange(n), "right")
    while len(todo):
        levels.append(todo)
        counts = last[todo] - first[todo]
        kids = inner[np.repeat(first[todo] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())]
        for up in (up_good, up_bad, up_main, up_boiler):
            up[kids] += up[parent[kids]]
        depth[kids] = depth[parent[kids]] + 1
        todo = kids
    below, blocks = own.copy(), np.ones(n)
    for nodes in levels[:0:-1]:
        np.add.at(below, parent[nodes], below[nodes])
        np.add.at(blocks, parent[nodes], blocks[nodes])
    root = np.repeat(begins, sizes)
    over = np.where(parent < 0, np.arange(n), parent)
    siblings = np.bincount(over, minlength=n)[over].astype(float)
    around = lambda d: np.where((np.arange(n) + d >= 0) & (np.arange(n) + d < n), own[np.clip(np.arange(n) + d, 0, max(0, n - 1)), 0], 0)
    chars = np.maximum(below[:, 0], 1)
    is_in = lambda group: np.array([t in group for t in tags], float)
    x = np.stack(
        [
            np.log1p(below[:, 0]), np.log1p(own[:, 0]), below[:, 1] / chars, below[:, 3] / np.maximum(below[:, 2], 1), below[:, 2], blocks, chars / blocks,
            below[:, 0] / np.maximum(below[over, 0], 1), below[:, 0] / np.maximum(below[root, 0], 1), own[:, 0] / chars, depth, siblings, position / np.maximum(sizes.repeat(sizes) if n else 1, 1),
            np.log1p(around(-1)), np.log1p(around(1)), np.log1p(own[over, 0]), below[over, 1] / np.maximum(below[over, 0], 1), chars[over] / blocks[over],
            good, bad, up_good - good, up_bad - bad, main, up_main - main, boiler, up_boiler - boiler,
            is_in(("p", "blockquote", "pre")), is_in(HEADINGS), is_in(LISTS), is_in(("table", "tr", "td", "th", "tbody", "thead")),
        ],
        1,
    ) if n else np.zeros((0, FEATURES))
    return x, parent, begins


def decode(gain: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Kept nodes: the subtree-closed choice with the largest sum; roots are always kept. Parents stand before children."""
    best = gain.copy()
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0 and best[i] > 0:
            best[parent[i]] += best[i]
    kept = np.zeros(len(parent), bool)
    for i in range(len(parent)):
        kept[i] = parent[i] < 0 or (kept[parent[i]] and best[i] > 0)
    return kept


def block_text(page: Page, kept: np.ndarray) -> str:
    out, parts, now = [], [], -1
    for node, block, s, _ in page.segments:
        if block != now:
            out.append(" ".join("".join(parts).split()))
            parts, now = [], block
        if kept[node]:
            parts.append(s)
    out.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in out if b)


def extract(sources: list[str], model: BoostedTrees | None) -> list[str]:
    pages = [parse(s) for s in sources]
    x, parent, begins = features(pages)
    if model is None:
        gain = np.where(x[:, 24] > 0, -1.0, 1.0)
    else:
        gain = model.log_odds(x)
    out = []
    for p, b in zip(pages, begins, strict=True):
        up = parent[b : b + len(p.tag)]
        out.append(block_text(p, decode(gain[b : b + len(p.tag)], np.where(up < 0, -1, up - b))))
    return out


def labels(page: Page) -> np.ndarray:
    """1 for blocks of the marked article and their ancestors, else 0."""
    n = len(page.tag)
    inside, y = np.zeros(n, bool), np.zeros(n)
    for i in range(1, n):
        up = page.parent[i]
        inside[i] = (page.main[i] or inside[up]) and page.tag[i] not in BOILER and not page.bad[i]
        if inside[i]:
            j = i
            while j >= 0 and not y[j]:
                y[j], j = 1, page.parent[j]
    y[0] = 1
    return y


def variant(page: Page, y: np.ndarray, rng: random.Random) -> tuple[Page, np.ndarray]:
    """The page with its telling tags disguised and boilerplate added, and its labels."""
    out = Page()
    plain = ["div", "section", "td"]
    moved, new_y = {0: 0}, [1.0]
    named = rng.random() < 0.5
    for i in range(1, len(page.tag)):
        tag, attrs = page.tag[i], ""
        if page.main[i]:
            tag = rng.choice(plain)
            attrs = f'class="{rng.choice(sorted(GOOD))}"' if named else ""
        elif tag in BOILER or page.bad[i]:
            tag = rng.choice(plain)
            attrs = f'class="{rng.choice(sorted(BAD))}"' if rng.random() < 0.7 else ""
        moved[i] = out.add(moved[page.parent[i]], tag, attrs)
        new_y.append(y[i])
    block = 0
    for node, block, s, link in page.segments:
        out.segments.append((moved[node], block, s, link))
    texts = [s for _, _, s, _ in page.segments if len(s) > 40] or ["some words, and more."]
    host = rng.choice([0, *[moved[i] for i in range(1, len(page.tag)) if page.main[i]]])
    for _ in range(rng.randint(0, 2)):  # a sidebar, notice, form or comments
        tag = rng.choice([*plain, "aside", "form", "footer"])
        extra = out.add(host, tag, f'class="{rng.choice(sorted(BAD))}"' if tag in plain or rng.random() < 0.5 else "")
        new_y.append(0)
        for _ in range(rng.randint(1, 4)):
            block += 1
            new_y.append(0)
            out.segments.append((out.add(extra, rng.choice(["p", "div", "li"]), ""), block, rng.choice(texts)[: rng.randint(5, 400)], rng.random() < 0.3))
    return out, np.array(new_y)


def train(pages: DataFrame, key: str = "page_id", source: str = "html", most: int = TRAIN_PAGES, variants: int = 3, seed: int = 7) -> BoostedTrees | None:
    """The model, from at most ``most`` marked pages; None if no page marks its article."""
    order = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(source)), 16)
    marked = pages.filter(F.lower(F.col(source)).rlike("<(article|main)[ >]")).select(F.col(source).alias("html"), order.alias("order"))
    # Only rows below a threshold of the hash are sent, which are about twice as many as are taken.
    share = min(1.0, 2 * most / max(1, marked.count()))
    sample = [r.html for r in marked.filter(F.col("order") <= int(share * 2**48)).orderBy("order").limit(most).collect()]
    rng, parsed = random.Random(seed), []
    for s in sample:
        page = parse(s)
        y = labels(page)
        parsed += [(page, y)] + [variant(page, y, rng) for _ in range(variants)]
    if not parsed:
        return None
    x, _, _ = features([p for p, _ in parsed])
    y = np.concatenate([y for _, y in parsed])
    return fit(x, y, trees=50)


def extract_pages(pages: DataFrame, model: BoostedTrees | None, source: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``columns`` with text and n_chars (code points) of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    n = len(columns)
    kept = pages.select(*columns)
    picked = pages.select(*columns, F.coalesce(F.col(source), F.lit("")).alias(fresh(kept, "source")))
    schema = T.StructType([*picked.schema.fields[:n], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in small_batches(batches, n, 1_000_000):
            texts = extract(b.column(n).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return picked.mapInArrow(run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages, train(pages))
