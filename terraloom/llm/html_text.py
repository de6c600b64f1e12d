"""Main text of web pages by equivalence-class template deduction.

First pass: every page is parsed into elements and text blocks. Tokens are the elements by their path from the root (opening and
closing tags) and the text blocks by path and content. The occurrence vector of a token over the pages of a host is never gathered: it is
summed up as a signature (sums of hashes of page and count), so tokens with equal signatures form an equivalence class. A
class is valid if it is frequent on the host, has at least two tokens, and all its elements lie in elements of valid classes; the
valid classes nest into the host's template. A text block whose vector is that of a valid class belongs to the template, wherever it
stands, in articles too, if so many different pages hold it (``IN_ARTICLE``); outside of articles so does one that is the same on most different pages of the host. Slots are the paths that hold
other text; the content slot is the article element, or else the deepest element that holds most of the host's changing text.

Second pass: each page is parsed again and the blocks in the content slot are taken, without template text and without menus, notices,
adverts, forms and the like. Those are known by element, role, class or id; where such a name within an article can also be the
article's own (``UNSURE``), the template breaks the tie: the element goes if its path belongs to the template. Pages of hosts without a template, or
without the template's slot, choose their own slot by the same rules and go by names alone.

Pages with the same longest block count as one when template text is judged, so that copies of an article don't look like a template.

What is shuffled are counts by host and token, summed before they are dealt out, and a host's frequent tokens, at most twice a
page's. Templates go to the pages by broadcast only while they are small (``send_bytes``), else by a shuffled join, in which Spark
splits hot hosts. Parsing takes time in proportion to the page, however deep its elements nest.

Defined cases: null or empty html has empty text; urls that are null or have no host share one host; rows that repeat an
id are extracted one by one; broken or unclosed markup is read like a browser would, by what is open; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import written

#: Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover mstyle mspace semantics annotation".split()
)
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
APART = frozenset("head nav footer aside form script style noscript template iframe svg object audio video canvas button select option textarea dialog menu input".split())
ARTICLE = frozenset("article main".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion recommended related replies reply search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar tracking widget widgets".split()
)
#: Those of them that an article may use for its own parts: a menu of dishes, a notice, an alert, a reply.
UNSURE = frozenset("alert banner complementary dialog login menu modal notice notices overlay popup recommended replies reply search social toolbar tracking widget widgets".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+)>|<[!?][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
NAMES = re.compile(r"[a-z]+|[0-9]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_M = 0x7FFFFFFF


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


@dataclass(slots=True)
class Node:
    """An element: its path, the nearest element around it that is not inline, and what its names say; flags hold for all inside it."""

    path: int
    up: Node | None
    depth: int
    tag: str
    apart: bool
    article: bool
    inside: bool
    unsure: int = 0  # path of the outermost element whose names leave it open whether it is the article's own


@dataclass
class Page:
    """Elements in order of their opening tags, number of explicit closing tags by path, and text blocks with the element around them."""

    opened: list[Node] = field(default_factory=list)
    closed: Counter = field(default_factory=Counter)
    blocks: list[tuple[Node | None, str]] = field(default_factory=list)


def _marked(attrs: str) -> tuple[str, bool, bool, bool]:
    """Class names, whether attributes set the element apart, whether they may, and whether they name it the article."""
    names, apart, unsure, article = "", False, False, False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            if name == "class":
                names = value
            words = set(NAMES.findall(value)) & MARKS
            unsure = unsure or bool(words)
            apart = apart or bool(words - UNSURE)
            article = article or (name == "role" and value == "main")
        elif name == "itemprop" and value == "articlebody":
            article = True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            apart = True
    return names, apart, unsure, article


def parse(source: str) -> Page:
    page = Page()
    stack: list[Node] = []
    open_now: Counter = Counter()
    blocks_open: list[Node] = []  # the elements of the stack that are not inline
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                page.blocks.append((blocks_open[-1] if blocks_open else None, text))

    def close(to: int) -> None:
        if any(x.tag not in INLINE for x in stack[to:]):
            flush()
        for x in stack[to:]:
            open_now[x.tag] -= 1
            if x.tag not in INLINE:
                blocks_open.pop()
        del stack[to:]

    def top(tags, until=()) -> int | None:
        if not any(open_now[t] for t in tags):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in until:
                return None
        return None

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            i = top((tag,))
            if i is not None:
                page.closed[stack[i].path] += 1
                close(i)
            continue
        if tag in ("br", "wbr", "img"):
            held.append(" ")
            continue
        if tag in CLOSES_P and (i := top(("p",), ("article", "main", "section", "td", "th", "button", "object"))) is not None:
            close(i)
        if tag in SAME_CLOSES and (i := top((tag,) if tag not in ("dt", "dd", "td", "th") else (("dt", "dd") if tag[1] != "h" and tag[0] == "d" else ("td", "th")), SAME_CLOSES[tag])) is not None:
            close(i)
        above = stack[-1] if stack else None
        names, apart, unsure, article = _marked(m[3]) if m[3] else ("", False, False, False)
        article = article or tag in ARTICLE
        inside = above is not None and above.inside
        if article or tag in ("html", "body"):
            apart = unsure = False  # An article is not set apart by its own names.
        # The header of an article holds its headline; the header of a page does not. Outside of articles any name sets apart.
        apart = (above is not None and above.apart) or apart or (unsure and not inside) or tag in APART or (tag == "header" and not inside)
        path = _signed(_hash(above.path if above else 0, tag, names))
        open_to_doubt = (above.unsure if above else 0) or (path if unsure and inside else 0)
        node = Node(path, blocks_open[-1] if blocks_open else None, (above.depth if above else 0) + 1, tag, apart, article, inside or article, open_to_doubt)
        if tag not in INLINE:
            flush()
            page.opened.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not (m[3].rstrip().endswith("/") and (tag in INLINE or tag in FOREIGN)):
            stack.append(node)
            open_now[tag] += 1
            if tag not in INLINE:
                blocks_open.append(node)
    flush()
    return page


def slot(nodes: dict[int, tuple[int, int, bool, int]]) -> tuple[int, bool] | None:
    """The content element among path -> (parent, depth, article, chars of text in it), and whether it is an article."""
    articles = [(v[3], -v[1], p) for p, v in nodes.items() if v[2] and v[3] > 0]
    if articles:
        return max(articles)[2], True
    held = [(v[1], v[3], p) for p, v in nodes.items()]
    most = max((h[1] for h in held), default=0)
    if most <= 0:
        return None
    return max(h for h in held if h[1] >= 0.7 * most)[2], False


def _measured(page: Page) -> dict[int, list]:
    """path -> [parent, depth, article, chars of text in it that isn't set apart, openings, whether its names leave it open]."""
    chars: Counter = Counter()
    for around, text in page.blocks:
        if around is not None and not around.apart:
            chars[id(around)] += len(text)
    for n in reversed(page.opened):
        if n.up is not None and chars[id(n)]:
            chars[id(n.up)] += chars[id(n)]
    out: dict[int, list] = {}
    for n in page.opened:
        have = out.setdefault(n.path, [n.up.path if n.up else 0, n.depth, n.article and not n.apart, 0, 0, n.unsure == n.path])
        have[3] += chars[id(n)]
        have[4] += 1
    return out


def _text_token(around: Node | None, text: str) -> int:
    return _signed(_hash(around.path if around else 0, text))


def text_of(page: Page, content: int | None = None, fixed: frozenset[int] = frozenset(), furniture: frozenset[int] | None = None) -> str:
    """The blocks of the content slot; without one, or where the page lacks it, of the page's own.

    fixed: template text; furniture: the template's elements among those whose names leave it open (None: no template, so names decide).
    """
    chosen: int | None = None
    if content is not None and any(n.path == content for n in page.opened):
        chosen = content
    else:
        fixed, furniture = frozenset(), None
        own = slot({p: tuple(v[:4]) for p, v in _measured(page).items()})
        chosen = own[0] if own else None
    within: set[int] = set()
    for n in page.opened:
        if n.path == chosen or n.up is not None and id(n.up) in within:
            within.add(id(n))
    out = []
    for around, text in page.blocks:
        if around is not None and (around.apart or around.unsure and (furniture is None or around.unsure in furniture)):
            continue
        if chosen is not None and id(around) not in within:
            continue
        if fixed and _text_token(around, text) in fixed:
            continue
        out.append(text)
    return "\n".join(out)


#: Rows of elements, and rows of text blocks (depth -1, parent the element around them).
TOKENS = "host string, token long, parent long, depth int, article boolean, unsure boolean, pages long, chars long, a long, b long, body long"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the batch by host and token."""
    names = [x.split()[0] for x in TOKENS.split(", ")]
    for batch in batches:
        sums: dict[tuple, list] = {}

        def add(key: tuple, pid, count: int, chars: int) -> None:
            h = _hash(pid, count)
            s = sums.setdefault(key, [0, 0, 0, 0])
            for i, v in enumerate((1, chars, h & _M, h >> 31 & _M)):
                s[i] += v

        for host, pid, source in zip(batch.column("host").to_pylist(), batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
            page = parse(source or "")
            body = _signed(_hash(max((t for n, t in page.blocks if n is None or not n.apart), key=len, default="")))
            for path, (parent, depth, article, chars, opened, unsure) in _measured(page).items():
                add((host, path, parent, depth, article, unsure, 0), pid, opened, chars)
                # A closing tag is a token of its own, its element's with the last bit turned; it holds no text, so it is no slot.
                if page.closed[path]:
                    add((host, path ^ 1, parent, depth, False, False, 0), pid, page.closed[path], 0)
            texts = Counter((_text_token(n, t), n.path if n else 0, len(t)) for n, t in page.blocks if n is None or not n.apart)
            for (token, parent, size), count in texts.items():
                add((host, token, parent, -1, False, False, body), pid, count, size * count)
        rows = [(*k[:6], *v, k[6]) for k, v in sums.items()]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=names)


#: So many different pages must share a text block before it is taken for template text within an article.
IN_ARTICLE = 10


def _template(rows: pd.DataFrame) -> pd.DataFrame:
    """One host's frequent tokens -> its content slot, template texts, and the template's elements among those of unsure names."""
    elements, texts = rows[rows["depth"] >= 0], rows[rows["depth"] < 0]
    sizes = elements.groupby(["pages", "a", "b"])["token"].transform("size")
    valid: dict[int, list] = {}
    vectors: set[tuple[int, int, int]] = set()
    furniture: list[int] = []
    for t, parent, depth, article, unsure, chars, pages, a, b in elements[sizes >= 2].sort_values("depth")[["token", "parent", "depth", "article", "unsure", "chars", "pages", "a", "b"]].itertuples(index=False):
        if depth == 1 or parent in valid or parent ^ 1 in valid:
            valid[t] = [parent, depth, article, chars]
            vectors.add((pages, a, b))
            if unsure:
                furniture.append(t)
    same = [v in vectors for v in texts[["pages", "a", "b"]].itertuples(index=False, name=None)]
    template = texts[pd.Series(same, index=texts.index, dtype=bool)]
    # What the template itself says is no slot's changing text.
    for parent, chars in template[["parent", "chars"]].itertuples(index=False):
        while parent in valid:
            valid[parent][3] -= chars
            parent = valid[parent][0]
    best = slot({t: tuple(v) for t, v in valid.items()}) if valid else None
    content, article = best if best else (None, False)
    fixed = [] if content is None else sorted(set(template["token"][template["held"] >= IN_ARTICLE]) if article else set(template["token"]) | set(texts["token"]))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "content": pd.array([content], dtype="Int64"), "fixed": [fixed], "furniture": [furniture]})


def templates(pages: DataFrame, least_pages: int = 3, share: float = 0.5) -> DataFrame:
    """(host, content, fixed, furniture) of every host with a template; pages has host, page_id and html."""
    found = written(pages.select("host", "page_id", "html").mapInArrow(_tokens, TOKENS), "tokens")
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "a", "b")]
    hosts = pages.groupBy("host").agg(F.count("*").alias("of"))
    elements = found.where("depth >= 0").groupBy("host", "token", "parent", "depth", "article", "unsure").agg(*sums)
    often = elements.join(hosts, "host").where((F.col("pages") >= least_pages) & (F.col("pages") >= share * F.col("of"))).drop("of")
    by_body = found.where("depth < 0").groupBy("host", "token", "parent", "body").agg(*sums)
    bodies = by_body.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("bodies"))
    texts = by_body.groupBy("host", "token", "parent").agg(F.count("*").alias("held"), *sums)
    texts = texts.join(bodies, "host").where((F.col("held") >= least_pages) & (F.col("held") >= share * F.col("bodies")))
    no = F.lit(False)
    both = often.withColumn("held", F.col("pages")).unionByName(texts.select("host", "token", "parent", F.lit(-1).alias("depth"), no.alias("article"), no.alias("unsure"), "pages", "chars", "a", "b", "held"))
    return both.groupBy("host").applyInPandas(_template, "host string, content long, fixed array<long>, furniture array<long>")


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for source, content, fixed, furniture in zip(*[b.column(c).to_pylist() for c in ("html", "content", "fixed", "furniture")]):
            out.append(text_of(parse(source), content, frozenset(fixed or ()), None if furniture is None else frozenset(furniture)) if source else "")
        cols = [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", send_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), HOST, 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    known = written(templates(rows), "templates")
    size = known.agg(F.sum(64 + F.length("host") + 8 * F.size("fixed") + 8 * F.size("furniture"))).first()[0] or 0
    met = rows.join(F.broadcast(known) if size <= send_bytes else known, "host", "left")
    return met.select("page_id", "url", "html", "content", "fixed", "furniture").mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")
