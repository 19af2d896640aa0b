"""HTML main-text extraction by a linear-chain CRF over DOM leaf blocks (operator 9).

A page is read into leaf blocks: stretches of text between block-level tags, each
with its chain of open elements. Ancestor tags, words of their classes, ids and
roles, whether they stand inside an article, and features of the text (length,
share of link text, end mark) score a block as main text or not; transitions link
neighbouring blocks, and Viterbi picks the labels of the whole page at once. Main
blocks are joined by line breaks in page order.

The model is trained on labelled pages that `labelled_pages` composes from the
usual parts of web pages: articles in several wrappers with headings, lists,
quotes and tables, and menus, headers, footers, sidebars, notices, adverts, forms
and reader comments around and inside them.

Scripts, styles, titles, frames, templates, drawings (svg) and comments never become
blocks, and their text is not the page's; the text of noscript, math and object is
for the chain to judge. Names that only begin like theirs, as svg-icon, are other
elements. Unclosed tags, cut-off
pages and stray end tags are read as browsers do in the main: an unfinished tag at
the end is dropped, an end tag without its start is ignored, HTML ends an unclosed
drawing, and an unclosed template lasts as long as what it stands in. Work and memory
follow a page's length, however deep its elements nest. A null or empty page, and one
without main blocks, gives the empty text; pages that repeat are each read, and extra
columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm import crf
from streamledger.llm.common import mapped, slices, table

SLOTS, SCORE_CACHE, TRAINING_PAGES = 1 << 14, 50_000, 1200
MAIN, OTHER = "main", "other"
#: Names of HTML elements by their kind.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: What ends a drawing that is still open.
BREAKS = BLOCKS | frozenset("b big br code em embed i img meta nobr ruby s small span strike strong sub sup tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|iframe|noframes"
#: Elements without text of the page, and those in a drawing that hold HTML again.
UNSEEN, HTML_AGAIN = ("svg", "template"), ("foreignobject", "desc")
#: What an opening tag ends that is still open, up to the nearest of the third names.
GROUPS = [tuple(frozenset(x.split()) for x in g) for g in (("li", "li", "ul ol menu dir"), ("dt dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td th", "td th", "table tr"), ("option", "option", "select"))]
GROUP_OF = {t: k for k, (tags, _, _) in enumerate(GROUPS) for t in tags}
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*+(?:(?<=/)>|>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN_START = re.compile(rf"<(?:{'|'.join(UNSEEN)})[\s/>]", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An open block element: what it adds to what stands above it, so that a chain of elements is never copied."""

    __slots__ = ("inline", "nearest", "new_words", "parent", "scores", "tag", "tags", "words")

    def __init__(self, tag: str, words: frozenset, new_words: tuple, parent: Element | None, at: int):
        self.tag, self.words, self.new_words, self.parent = tag, words, new_words, parent
        above = parent.tags if parent else frozenset()
        self.tags = above if tag in above or tag in ("html", "body") else above | {tag}
        self.inline: dict[str, int] = {}  # elements within its text that are open
        self.nearest = [at if tag in close or tag in stop else parent.nearest[k] if parent else -1 for k, (_, close, stop) in enumerate(GROUPS)]
        self.scores: np.ndarray | None = None

    @property
    def inside(self) -> str:
        return "article" if "article" in self.tags else "main" if "main" in self.tags else "none"


class Block:
    __slots__ = ("context", "linked", "text")

    def __init__(self, text: str, context: Element, linked: float):
        self.text, self.context, self.linked = text, context, linked


def unseen(page: str) -> dict[int, int]:
    """Where each drawing and template that has an end tag begins and ends; HTML inside a drawing ends it before that."""
    out: dict[int, int] = {}
    if not UNSEEN_START.search(page):
        return out
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {t: [] for t in (*UNSEEN, *HTML_AGAIN)}

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    for m in TOKEN.finditer(page):
        tag = (m.group(3) or m.group(6) or "").lower()
        if m.group(2) or m.group(5):
            last = places[tag][-1] if places.get(tag) else -1
            if last >= 0 and (tag == "template" or not places["template"] or places["template"][-1] < last):  # nothing inside a template ends what is outside
                if tag in UNSEEN:
                    out[stack[last][1]] = m.end()
                cut(last)
        elif tag in BREAKS:
            while stack and stack[-1][0] == "svg":
                cut(len(stack) - 1)
        elif (tag in UNSEEN or stack and tag in HTML_AGAIN) and not (m.group(4) or m.group(7) or "").endswith("/"):
            places[tag].append(len(stack))
            stack.append((tag, m.start()))
    return out


def leaf_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, each with the innermost block element that it stands in."""
    out: list[Block] = []
    root = Element("", frozenset(), (), None, 0)
    stack = [root]
    places: dict[str, list[int]] = {}  # where the open elements of a name stand
    words_open: dict[str, int] = {}
    inline_open: dict[str, int] = {}
    before_drawing: list[dict[str, int]] = []  # what was open in the text when an unclosed drawing began
    parts: list[str] = []
    linked = [0, 0]  # characters inside links, all characters

    def text(piece: str) -> None:
        if piece and not any(inline_open.get(t) for t in UNSEEN):
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            n = len(piece.strip())
            linked[1] += n
            if inline_open.get("a"):
                linked[0] += n

    def flush() -> None:
        if parts:
            clean = " ".join("".join(parts).split())
            if clean:
                out.append(Block(clean, stack[-1], linked[0] / max(1, linked[1])))
            parts.clear()
        linked[0] = linked[1] = 0

    def set_inline(held: dict[str, int], tag: str, n: int) -> None:
        inline_open[tag] = inline_open.get(tag, 0) + n - held.get(tag, 0)
        held[tag] = n

    def cut(k: int) -> None:
        while len(stack) > k:
            gone = stack.pop()
            places[gone.tag].pop()
            for w in gone.words:
                words_open[w] -= 1
            for t in gone.inline:
                inline_open[t] -= gone.inline[t]

    def push(tag: str, attributes: str) -> None:
        words = frozenset(w.lower() for g in NAMES.findall(attributes) for w in PART.findall(" ".join(g))) if "=" in attributes else frozenset()
        new = tuple(w for w in words if not words_open.get(w))
        for w in words:
            words_open[w] = words_open.get(w, 0) + 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, words, new, stack[-1], len(stack)))

    at, skipped = 0, unseen(page)
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m.group(3) or m.group(6) or "").lower()
        if not tag:
            continue
        block, held = tag in BLOCKS, stack[-1].inline
        if m.group(2) or m.group(5):
            if block and places.get(tag):
                flush()
                cut(places[tag][-1])
            elif not block and held.get(tag):
                set_inline(held, tag, held[tag] - 1)
            continue
        if m.start() in skipped:
            at = skipped[m.start()]
            continue
        if tag in BREAKS and held.get("svg"):
            kept = before_drawing.pop()
            before_drawing.clear()
            for t in list(held):
                set_inline(held, t, min(held[t], kept.get(t, 0)))
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            if stack[-1].tag == "p":
                cut(len(stack) - 1)
            if tag in GROUP_OF:
                near = stack[-1].nearest[GROUP_OF[tag]]
                if near >= 0 and stack[near].tag in GROUPS[GROUP_OF[tag]][1]:
                    cut(near)
        if tag in VOID:
            continue
        attributes = m.group(4) or m.group(7) or ""
        if block:
            push(tag, attributes)
        elif not attributes.endswith("/"):
            if tag == "svg" and not held.get("svg"):
                before_drawing[:] = [dict(held)]
            set_inline(held, tag, held.get(tag, 0) + 1)
    if at < len(page):
        text(page[at:])
    flush()
    return out


def own_names(element: Element) -> list[str]:
    """Names of what an element is and stands in, but for the words of its chain."""
    own, inside = element.tag, element.inside
    names = ["bias", f"own:{own}", f"in:{inside}", f"own:{own}:{inside}"]
    for t in sorted(element.tags):
        names += [f"tag:{t}", f"tag:{t}:{inside}"] if t else []
    return names


def near_words(element: Element) -> frozenset:
    return element.words | element.parent.words if element.parent else element.words


def context_names(element: Element) -> list[str]:
    words, e = [], element
    while e:
        words += e.new_words
        e = e.parent
    return own_names(element) + sorted([f"word:{w}" for w in words] + [f"near:{w}" for w in near_words(element)])


def text_names(block: Block) -> tuple:
    n = len(block.text)
    size = 0 if n < 12 else 1 if n < 30 else 2 if n < 80 else 3 if n < 200 else 4
    links = 0 if block.linked < 0.05 else 1 if block.linked < 0.5 else 2
    return (size, links, block.text[-1] in ".!?…:”\"'", "©" in block.text[:80] or "copyright" in block.text[:80].lower(), block.text[:1].isdigit())


def slots_of(names) -> np.ndarray:
    return np.array([zlib.crc32(str(x).encode("utf-8", "surrogatepass")) & (SLOTS - 1) for x in names], np.int32)


def text_slots(t: tuple) -> np.ndarray:
    return slots_of([f"size:{t[0]}", f"links:{t[1]}", f"size:{t[0]}:links:{t[1]}", f"ends:{t[2]}", f"right:{t[3]}", f"digit:{t[4]}"])


def labelled_pages(n: int, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """Pages, and for each of their blocks in order its label."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(4, 25).capitalize() + r.choice(".....!?")
    link = lambda s: f'<a href="/{word()}">{s}</a>'
    attr = lambda names: f' {r.choice(("class", "class", "id"))}="{r.choice(names.split())}{r.choice(("", "", " " + word()))}"'

    def prose() -> str:
        s = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 4, 8))))
        if r.random() < 0.3:
            s = f"<b>{s}</b>" if r.random() < 0.5 else s + " " + link(words(1, 3)) + " " + sentence()
        return s

    def items(k: int, what) -> str:
        return "".join(f"<li>{what()}</li>" for _ in range(k))

    def body() -> list[tuple[str, list[str]]]:
        out = []
        for _ in range(r.randint(1, 8)):
            kind, k = r.random(), r.randint(2, 5)
            if kind < 0.62:
                out.append((f"<p>{prose()}" + r.choice(("</p>", "</p>", "")), [MAIN]))
            elif kind < 0.72:
                out.append((f"<h{(h := r.randint(2, 4))}>{words(1, 7)}</h{h}>", [MAIN]))
            elif kind < 0.79:
                out.append((f"<ul>{items(k, lambda: words(2, 15))}</ul>", [MAIN] * k))
            elif kind < 0.83:
                out.append((f"<blockquote><p>{prose()}</p></blockquote>", [MAIN]))
            elif kind < 0.86:
                out.append((f"<pre>{words(3, 20)}</pre>", [MAIN]))
            elif kind < 0.89:
                out.append((f"<table><tr>{''.join(f'<td>{words(1, 4)}</td>' for _ in range(k))}</tr></table>", [MAIN] * k))
            elif kind < 0.91:
                out.append((f"<figure><img src='x.png'><figcaption>{words(3, 10)}</figcaption></figure>", [MAIN]))
            else:
                out.append(junk_inside())
        return out

    def comments() -> tuple[str, list[str]]:
        k, inner = r.randint(1, 4), r.choice(("div", "li", "article", "p"))
        one = lambda: f'<{inner}{attr("comment comment-body reply user-comment")}>' + (f"<p>{prose()}</p>" if inner != "p" else prose()) + f"</{inner}>"
        tag = r.choice(("section", "div", "aside", "ul", "ol"))
        head = r.random() < 0.5 and tag not in ("ul", "ol")
        return f'<{tag}{attr("comments comment-list reader-comments discussion disqus responses")}>' + (f"<h3>{words(1, 3)}</h3>" if head else "") + "".join(one() for _ in range(k)) + f"</{tag}>", [OTHER] * (k + head)

    def form() -> tuple[str, list[str]]:
        return f'<form{attr("search login newsletter signup subscribe contact")}><label>{words(1, 4)}</label><input name="q"><button>{word()}</button></form>', [OTHER, OTHER]

    def advert() -> tuple[str, list[str]]:
        tag = r.choice(("div", "div", "aside", "section"))
        inner = prose() if r.random() < 0.5 else words(2, 12)
        return f'<{tag}{attr("ad ads advert advertisement sponsored promo banner ad-slot adbox sponsor")}>' + (f"<p>{inner}</p>" if r.random() < 0.4 else inner) + f"</{tag}>", [OTHER]

    def notice() -> tuple[str, list[str]]:
        return f'<div{attr("cookie cookies cookie-notice consent gdpr notice alert popup modal paywall banner privacy-notice")}>' + (f"<p>{prose()}</p>" if r.random() < 0.6 else prose()) + f"<button>{word()}</button></div>", [OTHER, OTHER]

    def related() -> tuple[str, list[str]]:
        k, tag = r.randint(2, 5), r.choice(("div", "aside", "section", "nav"))
        return f'<{tag}{attr("related related-posts recommended more-stories share social tags pagination breadcrumb breadcrumbs")}><ul>{items(k, lambda: link(words(1, 8)))}</ul></{tag}>', [OTHER] * k

    def sidebar() -> tuple[str, list[str]]:
        k, tag = r.randint(1, 4), r.choice(("aside", "aside", "div"))
        names = attr("sidebar side widget widgets rail sidebar-right") if tag == "div" or r.random() < 0.6 else ""
        return f"<{tag}{names}>" + "".join(f"<p>{prose()}</p>" if r.random() < 0.5 else f"<div>{link(words(1, 6))}</div>" for _ in range(k)) + f"</{tag}>", [OTHER] * k

    def menu() -> tuple[str, list[str]]:
        k, tag = r.randint(2, 7), r.choice(("nav", "nav", "div"))
        names = attr("menu nav navbar navigation main-menu topnav") if tag == "div" or r.random() < 0.5 else ""
        return f"<{tag}{names}><ul>{items(k, lambda: link(words(1, 2)))}</ul></{tag}>", [OTHER] * k

    def header() -> tuple[str, list[str]]:
        tag = r.choice(("header", "header", "div"))
        names = attr("header site-header masthead topbar page-header") if tag == "div" or r.random() < 0.5 else ""
        inner, labels = (f"<h{(h := r.randint(1, 2))}>{words(1, 4)}</h{h}>", [OTHER]) if r.random() < 0.5 else (f"<div>{words(1, 4)}</div><p>{words(2, 9)}</p>", [OTHER, OTHER])
        if r.random() < 0.4:
            m, more = menu()
            inner, labels = inner + m, labels + more
        return f"<{tag}{names}>{inner}</{tag}>", labels

    def footer() -> tuple[str, list[str]]:
        tag = r.choice(("footer", "footer", "footer", "div"))
        names = attr("footer site-footer bottom colophon page-footer") if tag == "div" or r.random() < 0.4 else ""
        inner = ("&copy; " if r.random() < 0.7 else "") + words(1, 4) + " &middot; " + (prose() if r.random() < 0.6 else words(1, 6))
        return f"<{tag}{names}>" + (f"<p>{inner}</p>" if r.random() < 0.5 else inner) + f"</{tag}>", [OTHER]

    def junk_inside() -> tuple[str, list[str]]:
        return r.choice((advert, advert, form, notice, related, sidebar, comments))()

    for page in range(n):
        parts = [f() for f, p in ((notice, 0.3), (header, 0.5), (menu, 0.7), (advert, 0.5), (form, 0.2), (sidebar, 0.2), (related, 0.15)) if r.random() < p]
        if r.random() < 0.5:
            r.shuffle(parts)
        kind = r.random()
        tag, names = ("article", attr("post article entry story") if r.random() < 0.3 else "") if kind < 0.6 else ("main", "") if kind < 0.75 else ("div", attr("content post-content entry-content article-body story-body main-content article"))
        title = f"<h1>{words(2, 10)}</h1>"
        inner = [(f"<header>{title}</header>" if tag == "article" and r.random() < 0.2 else title, [MAIN])] if r.random() < 0.85 else []
        inner += body()
        if tag == "article" and r.random() < 0.2:
            inner.append((f"<footer>{words(1, 5)}</footer>", [OTHER]))
        if page % 6 == 0:  # of what stands beside scripts, half within the article
            (inner if page % 12 else parts).insert(0, (f"<noscript>{sentence()}</noscript>", [OTHER]))
        bare = r.random() < 0.1  # text stands in the body itself
        parts += inner if bare else [(f"<{tag}{names}>", []), *inner, (f"</{tag}>", [])]
        parts += [f() for f, p in ((comments, 0.4), (related, 0.3), (advert, 0.2), (sidebar, 0.3), (form, 0.2), (notice, 0.1), (footer, 0.8)) if r.random() < p]
        yield "<html><head><title>x</title></head><body>" + "".join(s for s, _ in parts) + "</body></html>", [x for _, labels in parts for x in labels]


def train(pages: int = TRAINING_PAGES) -> crf.Crf:
    labels, sequences = [MAIN, OTHER], []
    for page, gold in labelled_pages(pages):
        blocks = leaf_blocks(page)
        if len(blocks) != len(gold):
            raise ValueError("a training page's blocks do not follow its labels")
        sequences.append(([np.concatenate([slots_of(context_names(b.context)), text_slots(text_names(b))]) for b in blocks], [labels.index(x) for x in gold]))
    return crf.train(sequences, labels, SLOTS, epochs=10)


class Extractor:
    """Scores of names and of kinds of text are computed once and kept, in bounded memory; an element's words add to its parent's."""

    def __init__(self, model: crf.Crf):
        self.model, self.kept = model, {}

    def held(self, key, names) -> np.ndarray:
        found = self.kept.get(key)
        if found is None:
            if len(self.kept) > SCORE_CACHE:
                self.kept.clear()
            found = self.kept[key] = self.model.weights[names()].sum(axis=0)
        return found

    def word(self, name: str) -> np.ndarray:
        return self.held(name, lambda: slots_of([name]))

    def words(self, element: Element) -> np.ndarray:
        """Scores of the words of a whole chain."""
        chain = []
        while element.scores is None:
            chain.append(element)
            if element.parent is None:
                break
            element = element.parent
        total = element.scores if element.scores is not None else np.zeros(2)
        for e in reversed(chain):
            e.scores = total = sum((self.word(f"word:{w}") for w in e.new_words), total)
        return total

    def scores(self, block: Block) -> np.ndarray:
        e = block.context
        own = self.held((e.tag, e.tags), lambda: slots_of(own_names(e)))
        near = sum((self.word(f"near:{w}") for w in near_words(e)), np.zeros(2))
        kind = text_names(block)
        return own + self.words(e) + near + self.held(kind, lambda: text_slots(kind))

    def extract(self, pages: list[str | None]) -> list[str]:
        found = [leaf_blocks(p) if p else [] for p in pages]
        lengths = np.array([len(b) for b in found], np.int64)
        scores = np.array([self.scores(b) for blocks in found for b in blocks]).reshape(-1, 2)
        best, out, at = crf.viterbi(self.model, scores, lengths[lengths > 0]), [], 0
        for blocks in found:
            out.append("\n".join(b.text for b, x in zip(blocks, best[at : at + len(blocks)], strict=True) if x == 0))
            at += len(blocks)
        return out


def extract_main_text(pages: DataFrame, model: crf.Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, url and text."""
    held = pages.sparkSession.sparkContext.broadcast(model or train())
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(held.value)
        for batch in batches:
            pages = batch.column("html").to_pylist()
            for a, b in slices(pages):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(extractor.extract(pages[a:b]), pa.string())], names=["id", "url", "text"])

    out = mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
