"""Main text of web pages by wrapper induction.

Pages are parsed into trees. Their nodes are aligned by place: the labels on the way from the root, like siblings
sharing one, so that all that simple tree matching could pair is aligned. The blocks of all pages of a host are
counted by place and text, each different page once, whatever their number and lengths. A text that stands at its
place on at least CONSTANT different pages, and on half of the host's that have the place, is template; other text
fills slots. The content of a page is all that fills slots, in the page's order, outside of elements that are
navigation, forms, notices or the like by tag or role, or by class or id where no article or most text speaks
against it.

Defined results: null and empty pages, and pages without content, give the empty text; unclosed tags end
with what contains them; an unfinished tag at the end is dropped; pages without a host are a host of their
own. White space is what Unicode says. Repeated rows give equal rows; no page is dropped or cut.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidied

#: Pages that are parsed before their blocks are handed on.
CHUNK = 64
#: Parts that the pages of a common host are joined in.
SALTS = 64
#: Different pages that must agree before their common text counts as template.
CONSTANT = 5

#: Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title select object canvas video audio head".split()) - {"head"}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("table ul ol dl select body html article section div td th main nav".split())
ASIDE = frozenset("nav header footer aside form dialog menu button label fieldset search head".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing "
    "social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation sidebar comment comments disqus replies reply footer masthead topbar toolbar pagination pager login signup signin widget alert skip hidden toc copyright disclaimer".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_WORDS = frozenset("article post entry story content maincontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("aside", "children", "main", "tag", "weak", "words")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.words = tag, [], ""
        self.aside, self.main, self.weak = tag in ASIDE, 2 * (tag == "article") or tag == "main", False
        if attributes and not attributes.isspace():
            words: list[str] = []
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "role":
                    self.aside = self.aside or value in ROLES
                    self.main = self.main or value in ("main", "article")
                elif name == "hidden" or name == "aria-hidden":
                    self.aside = self.aside or name == "hidden" or value == "true"
                elif name == "class" or name == "id":
                    words += _PARTS.split(value)
            if words:
                self.words = " ".join(sorted(set(words) - {""}))
                # words alone are a hint, which `main_text` takes up
                self.weak = tag not in ("html", "body") and self.main < 1 and not ASIDE_WORDS.isdisjoint(words)
                if not self.main and tag in ("div", "section") and not MAIN_WORDS.isdisjoint(words):
                    self.main = 0.5


    def label(self) -> str:
        """What nodes at like places share: tag and words, without numbers; the whole page's words are often its own."""
        if not self.words or self.tag in ("html", "body"):
            return self.tag
        return " ".join([self.tag, *(w for w in self.words.split() if not w.isdigit())])


def parse(html: str) -> Node:
    """The page's tree: nodes hold nodes and strings."""
    root = Node("#page", "")
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            s = m[0]
            if s[0] != "<":
                stack[-1].children.append(s)
            elif s == "<":
                after = html[at : at + 1]
                if (after.isalpha() or after == "/") and html.find(">", at) < 0:
                    break
                stack[-1].children.append(s)
            elif s.startswith("<![CDATA["):
                stack[-1].children.append(s[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, attributes = tag.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].children.append(Node(tag, ""))
            continue
        closes = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            t = stack[k].tag
            if t in closes or t == "p" and tag in ENDS_P:
                del stack[k:]
                break
            if t in SCOPES:
                break
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>|\\Z", re.IGNORECASE).search(html, at)
            at = end.end()
            continue
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if not attributes.endswith("/") or tag in BLOCKS:
            stack.append(node)
    return root


def _hash(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _bytes(n: int) -> bytes:
    return n.to_bytes(8, "little", signed=True)


def _inside(place: int, label: str) -> int:
    """The place of a node in one at `place`: a hash of the labels on the way to it."""
    if (k := (place, label)) not in _places:
        if len(_places) > 100_000:
            _places.clear()
        _places[k] = _hash(_bytes(place), label.encode("utf-8", "replace"))
    return _places[k]


_places: dict[tuple[int, str], int] = {}


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


class Block:
    """Text between two edges of block elements: its place, and runs (text, inside an article or main element, weak elements around it)."""

    __slots__ = ("place", "runs", "weak")

    def __init__(self, place: int, weak: tuple[int, ...], runs: list):
        self.place, self.weak, self.runs = place, weak, runs

    def own(self) -> str:
        """What its place and others' are compared by: the text outside of weak inline elements."""
        return _clean("".join(t for t, _, weak in self.runs if len(weak) == len(self.weak)))


def blocks(root: Node) -> list[Block]:
    """The blocks of a page, in its order, without what is aside by tag or role. Weak elements are numbered."""
    out: list[Block] = []
    now: list = []
    n_weak = 0
    # children still to come, the block they are text of (place, weak), their own place, within an article or main, weak elements around
    todo: list = [(iter(root.children), (0, ()), 0, 0, ())]

    def close(block: tuple) -> None:
        if now:
            if any(not t.isspace() for run in now for t in run[0]):
                out.append(Block(*block, [("".join(run[0]), *run[1:]) for run in now]))
            now.clear()

    def add(text: str, main: bool, weak: tuple[int, ...]) -> None:
        if now and now[-1][1:] == (main, weak):
            now[-1][0].append(text)
        else:
            now.append(([text], main, weak))

    while todo:
        children, block, place, main, weak = todo[-1]
        for c in children:
            if isinstance(c, str):
                add(c, main >= 1, weak)
            elif c.tag == "br":
                add(" ", main >= 1, weak)
            elif not c.aside or c.tag == "header" and main and not c.words:
                at, around = _inside(place, c.label()), weak
                if c.weak:
                    around, n_weak = (*weak, n_weak), n_weak + 1
                own = block
                if c.tag in BLOCKS:
                    close(block)
                    own = at, around
                todo.append((iter(c.children), own, at, max(main, c.main), around))
                break
            elif c.tag in BLOCKS:
                close(block)
        else:
            todo.pop()
            if todo and todo[-1][1] is not block:
                close(block)
    close((0, ()))
    return out


def keys(host: str, page: list[Block]) -> tuple[list[int], list[int], int]:
    """(places, places with their text) of a page's blocks within its host, and a hash of the page that equal pages share."""
    h = host.encode("utf-8", "replace")
    places = [_hash(h, _bytes(b.place)) for b in page]
    texts = [_hash(_bytes(p), b.own().encode("utf-8", "replace")) for p, b in zip(places, page, strict=True)]
    return places, texts, _hash(*(_bytes(t) for t, b in zip(texts, page, strict=True) if not b.weak))


def main_text(page: list[Block], texts: list[int], template: frozenset[int] | set[int]) -> str:
    """The text of the blocks that fill slots.

    Elements whose class or id says so are aside, but not those with most of the text that fills slots: of that
    inside articles and main elements, if any has some, else of the page's.
    """
    kept = [b for b, t in zip(page, texts, strict=True) if t not in template] if template else page
    every, inside = Counter(), Counter()
    for b in kept:
        for t, main, weak in b.runs:
            n = len(t) - t.count(" ")
            for w in (-1, *weak):
                every[w] += n
                inside[w] += n * main
    size = inside if inside[-1] else every
    aside = {w for w in every if w >= 0 and 2 * size[w] <= size[-1]}
    lines = (_clean("".join(t for t, _, weak in b.runs if aside.isdisjoint(weak))) for b in kept)
    return "\n".join(x for x in lines if x)


def is_template(pages: int, of: int) -> bool:
    """Whether a text on so many different pages of a host, of those that have its place, is template; of columns too."""
    return (pages >= CONSTANT) & (2 * pages >= of)


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of pages that make up one host."""
    found = [blocks(parse(p or "")) for p in pages]
    known = [keys("", b) for b in found]
    stand, of, place_of = defaultdict(set), defaultdict(set), {}
    for places, texts, page in known:
        for p, t in zip(places, texts, strict=True):
            place_of[t] = p
            of[p].add(page)
            stand[t].add(page)
    template = {t for t, on in stand.items() if is_template(len(on), len(of[place_of[t]]))}
    return [main_text(b, texts, template) for b, (_, texts, _) in zip(found, known, strict=True)]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    @tidied
    def read(batches):
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                part = batch.slice(a, CHUNK)
                out = ([], [], [], [])
                for html, host in zip(part.column("html"), part.column("host").to_pylist(), strict=True):
                    page = blocks(parse(html.as_py() or ""))
                    for column, x in zip(out, (*keys(host, page), json.dumps([(b.weak, b.runs) for b in page], ensure_ascii=False)), strict=True):
                        column.append(x)
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host")), *map(pa.array, out, kinds)], ["page_id", "url", "host", "places", "texts", "page", "blocks"])

    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    parsed = scratch.keep(rows.mapInArrow(read, "page_id bigint, url string, host string, places array<bigint>, texts array<bigint>, page bigint, blocks string"), "parsed")
    # each different page counts once: rows of 64-bit numbers, dealt by all of them, then summed where they are
    pair = F.explode(F.array_distinct(F.arrays_zip("places", "texts"))).alias("x")
    stand = parsed.select("host", "page", pair).select("host", "page", "x.places", "x.texts").distinct()
    on = stand.groupBy("host", "places", "texts").agg(F.count("*").alias("n")).filter(F.col("n") >= CONSTANT)
    of = stand.select("places", "page").distinct().groupBy("places").agg(F.count("*").alias("of")).filter(F.col("of") >= CONSTANT)
    # at a place at least half of its pages agree on: few texts for a host; salts split a common host if Spark doesn't broadcast
    chosen = on.join(of, "places").filter(is_template(F.col("n"), F.col("of"))).groupBy("host").agg(F.collect_set("texts").alias("template"))
    template = scratch.keep(chosen.select("host", "template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "template")
    salted = parsed.select("page_id", "url", "host", "texts", "blocks", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    judged = salted.join(template, ["host", "salt"], "left").select("page_id", "url", "texts", "blocks", "template")

    @tidied
    def write(batches):
        for batch in batches:
            out = []
            for texts, found, constant in zip(batch.column("texts"), batch.column("blocks"), batch.column("template"), strict=True):
                page = [Block(0, weak, runs) for weak, runs in json.loads(found.as_py())]
                out.append(main_text(page, texts.as_py(), set(constant.as_py() or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return judged.mapInArrow(write, "page_id bigint, url string, text string, n_chars bigint")
