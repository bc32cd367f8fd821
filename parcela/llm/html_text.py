"""Main text of web pages by a conditional random field over DOM leaf blocks (operator 3).

A page is read into leaf blocks: runs of text between block-level tags, each
with what its ancestors say (tags, words of class, id and role) and what its
text looks like.  A linear-chain field labels every block content or not,
fitted on labelled pages (``labelled_pages``) and decoded by Viterbi; the
content blocks, in page order, are the text.

Character references are decoded, white space within a block becomes one
space, ``br`` counts as white space, blocks are joined by an empty line.

Defined cases: a null, empty or tag-only page has an empty text; markup that is
never closed ends with the page; text outside any tag is a block; rows that
repeat give their rows again; a null ``page_id`` stays null; other columns
are left out.
"""

from __future__ import annotations

import functools
import html as references
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import crf
from parcela.llm.common import chunks, table, to_batch

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

#: HTML's block-level elements (with table and list parts).
BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table
tbody td tfoot th thead tr ul
""".split())
#: Elements whose content is no page text.
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that the start of another ends.
ENDED_BY = {"p": BLOCK_TAGS - {"button", "option", "select"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"},
            "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "head": {"body"}}
#: Elements that an end tag from within does not reach past.
SCOPES = frozenset("table td th li ul ol nav aside article section main header footer form div body".split())

ANCESTORS = ("nav", "header", "footer", "aside", "article", "main", "section", "form", "ul", "table", "figure", "blockquote", "dialog",
             "button")
#: Words of class, id and role, by what they usually mark.
ROLES = {
    "advert": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored dfp adsense",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toolbar pager pagination skip toc",
    "footer": "footer foot copyright contentinfo legal colophon",
    "header": "header masthead topbar logo branding",
    "side": "sidebar aside rail widget widgets complementary related recommended trending tags",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader readers",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog subscribe newsletter signup paywall message",
    "share": "share sharing social follow login search",
    "content": "content article post entry story body text articlebody main prose",
}
ROLE_OF = {w: k for k, words in ROLES.items() for w in words.split()}
OWN_TAGS = (("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd", "option"), ("td", "th", "caption"), ("div", "section", "article"),
            ("blockquote", "pre"))
TEXT_BITS = ("words<=1", "words<=3", "words<=8", "words<=20", "words<=50", "words>50", "links", "half_links", "all_links", "sentence",
             "commas", "copyright", "first", "last", "after_h1", "no_body")
NAMES = ([f"in:{t}" for t in ANCESTORS] + [f"role:{r}" for r in ROLES] + [f"own_role:{r}" for r in ROLES]
         + [f"own:{t[0]}" for t in OWN_TAGS] + list(TEXT_BITS))
BIT = {n: 1 << i for i, n in enumerate(NAMES)}
assert len(NAMES) <= 64
ALIAS = {"ol": "ul", "menu": "ul", "dl": "ul", "select": "form", "fieldset": "form", "figcaption": "figure", "tbody": "table", "hgroup": "header"}
OWN_BIT = {t: BIT[f"own:{g[0]}"] for g in OWN_TAGS for t in g}


def _marks(tag: str, attributes: str) -> tuple[int, int]:
    """Bits that an element gives to all blocks below it, and those for its own blocks."""
    down = BIT.get(f"in:{ALIAS.get(tag, tag)}", 0)
    own = 0
    if attributes:
        for _, a, b, c in ATTRIBUTE.findall(attributes):
            for w in WORD.findall((a or b or c).lower()):
                if w in ROLE_OF:
                    down |= BIT[f"role:{ROLE_OF[w]}"]
                    own |= BIT[f"own_role:{ROLE_OF[w]}"]
    return down, own


def leaf_blocks(html: str) -> list[tuple[str, int]]:
    """(text, feature bits) of the leaf blocks of a page, in order."""
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]      # (tag, inherited bits, own bits)
    parts: list[str] = []
    link_parts: list[int] = []                              # whether each part stands in a link
    in_link = seen_h1 = False

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, down, own = stack[-1]
                bits = down | own | OWN_BIT.get(tag, 0) | _text_bits(text)
                linked = sum(len(p.strip()) for p, k in zip(parts, link_parts) if k)
                if linked:
                    share = linked / len(text)
                    bits |= BIT["links"] | (BIT["half_links"] if share > 0.4 else 0) | (BIT["all_links"] if share > 0.8 else 0)
                blocks.append((text, bits | (BIT["after_h1"] if seen_h1 else 0) | (0 if len(stack) > 1 else BIT["no_body"])))
            parts.clear()
            link_parts.clear()

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            piece = html[at:stop]
            parts.append(references.unescape(piece) if "&" in piece else piece)
            link_parts.append(in_link)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK_TAGS:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        seen_h1 = seen_h1 or tag == "h1"
                        del stack[k:]
                        in_link = False
                        break
                    if stack[k][0] in SCOPES and tag not in SCOPES:
                        break
            continue
        if tag in RAW_TAGS:
            if not m[3].endswith("/"):
                close = _raw_end(tag).search(html, at)
                at = close.end() if close else end
        elif tag == "a":
            in_link = True
        elif tag == "br":
            parts.append(" ")
            link_parts.append(False)
        elif tag in BLOCK_TAGS:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if tag in ENDED_BY.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in ENDED_BY:
                    break
            if tag not in VOID_TAGS:
                down, own = _marks(tag, m[3])
                stack.append((tag, stack[-1][1] | down, own))
    flush()
    if blocks:
        blocks[0] = (blocks[0][0], blocks[0][1] | BIT["first"])
        blocks[-1] = (blocks[-1][0], blocks[-1][1] | BIT["last"])
    return blocks


@functools.lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


def _text_bits(text: str) -> int:
    words = text.count(" ") + 1
    size = next((f"words<={n}" for n in (1, 3, 8, 20, 50) if words <= n), "words>50")
    bits = BIT[size]
    if text[-1] in ".!?:\"'”…":
        bits |= BIT["sentence"]
    if text.count(",") > 1:
        bits |= BIT["commas"]
    if "©" in text or "copyright" in text.lower():
        bits |= BIT["copyright"]
    return bits


# --- labelled pages -------------------------------------------------------------------------------------------------

SYLLABLES = "the and ing ent ion sch ver auf eau que los cion mente re ta no ki do ra mi su le".split()
MARK = {0: "\x01", 1: "\x02"}          # stands in a labelled block's text


class _Page:
    """Draws one labelled page.  Blocks carry their label as a control character."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, a: int, b: int) -> str:
        r = self.rng
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b))]
        style = r.random()
        if style < 0.06:
            out = [w + r.choice(["###", "$$$", "&amp;&amp;"]) for w in out]
        elif style < 0.1:
            out = [w.upper() + "!!" for w in out]
        elif len(out) > 4:
            out = [w + r.choice(["", "", "", "", ",", "."]) for w in out]
            out[-1] += "."
        return " ".join([out[0].capitalize(), *out[1:]])

    def pick(self, *items: str) -> str:
        return self.rng.choice(items)

    def text(self, label: int, a: int, b: int) -> str:
        return MARK[label] + self.words(a, b)

    def named(self, role: str) -> str:
        word = self.rng.choice(ROLES[role].split())
        name = self.pick(word, f"{word}-{self.rng.choice(SYLLABLES)}", f"site-{word}", f"{word}_box")
        return f'{self.pick("class", "class", "id")}="{name}"'

    def links(self, n: int, a: int = 1, b: int = 3) -> str:
        return "".join(f'<li><a href="/x">{self.text(0, a, b)}</a></li>' for _ in range(n))

    def menu(self) -> str:
        items = f"<ul>{self.links(self.rng.randint(2, 8))}</ul>"
        return self.pick(f"<nav>{items}</nav>", f"<div {self.named('menu')}>{items}</div>", f"<nav {self.named('menu')}>{items}</nav>",
                         f"<header><nav>{items}</nav></header>")

    def top(self) -> str:
        inner = f"<p>{self.text(0, 1, 12)}</p>"
        return self.pick(f"<header>{inner}</header>", f"<div {self.named('header')}>{inner}</div>", f"<header><h1>{self.text(0, 1, 4)}</h1></header>")

    def advert(self) -> str:
        inner = self.text(0, 2, 60)
        return self.pick(f'<div class="ad">{inner}</div>', f"<div {self.named('advert')}>{inner}</div>", f"<div {self.named('advert')}><p>{inner}</p></div>",
                         f"<aside {self.named('advert')}><p>{inner}</p></aside>")

    def side(self) -> str:
        inner = self.pick(f"<h3>{self.text(0, 1, 3)}</h3><ul>{self.links(4, 2, 8)}</ul>", f"<p>{self.text(0, 4, 50)}</p>")
        return self.pick(f"<aside>{inner}</aside>", f"<div {self.named('side')}>{inner}</div>", f"<aside {self.named('side')}>{inner}</aside>")

    def notice(self) -> str:
        inner = self.text(0, 4, 40)
        return self.pick(f"<div {self.named('notice')}><p>{inner}</p></div>", f"<div {self.named('notice')}>{inner}<button>{self.text(0, 1, 2)}</button></div>",
                         f"<dialog><p>{inner}</p></dialog>", f"<p {self.named('notice')}>{inner}</p>", f'<div role="alert">{inner}</div>')

    def form(self) -> str:
        return (f"<form><p>{self.text(0, 1, 20)}</p><label>{self.text(0, 1, 3)}</label><input><select><option>{self.text(0, 1, 2)}"
                f"</select><button>{self.text(0, 1, 2)}</button></form>")

    def comments(self) -> str:
        each = "".join(f"<{t}><p>{self.text(0, 1, 60)}</p></{t}>" for t in [self.pick("div", "li", "article")] * self.rng.randint(1, 5))
        head = f"<h2>{self.text(0, 1, 3)}</h2>"
        return self.pick(f"<section {self.named('comment')}>{head}{each}</section>", f"<div {self.named('comment')}>{each}</div>",
                         f"<ol {self.named('comment')}>{each}</ol>")

    def share(self) -> str:
        return f"<div {self.named('share')}><ul>{self.links(3, 1, 1)}</ul></div>"

    def bottom(self) -> str:
        inner = f"&copy; {self.text(0, 1, 30)}" if self.rng.random() < 0.6 else f"<p>{self.text(0, 2, 30)}</p>"
        return self.pick(f"<footer>{inner}</footer>", f"<div {self.named('footer')}>{inner}</div>", f"<footer>{inner}<ul>{self.links(3)}</ul></footer>")

    def paragraph(self) -> str:
        t = self.text(1, 1, self.rng.choice([2, 8, 30, 120]))
        link = f"{t} <a href='/y'>{self.words(1, 3)}</a> {self.words(2, 9)}"
        return self.pick(f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p>{link}</p>", f"<h2>{self.text(1, 1, 8)}</h2>",
                         f"<ul><li>{t}</li><li>{self.text(1, 1, 12)}</li></ul>", f"<blockquote>{t}</blockquote>", f"<div>{t}</div>",
                         f"<table><tr><td>{self.text(1, 1, 3)}</td><td>{self.text(1, 1, 3)}</td></tr></table>",
                         f"<pre>{t}</pre>", f"<figure><figcaption>{self.text(1, 2, 10)}</figcaption></figure>")

    def article(self) -> str:
        r = self.rng
        title = f"<h1>{self.text(1, 1, 12)}</h1>"
        body = []
        for _ in range(r.randint(1, 12)):
            body.append(self.paragraph())
            if r.random() < 0.08:
                body.append(self.pick(self.advert(), self.side(), self.notice(), self.share(), self.form()))
        if r.random() < 0.25:
            body.append(self.pick(self.comments(), self.share(), self.form()))
        inner = "\n".join([title if r.random() < 0.85 else f"<header>{title}</header>", *body])
        return self.pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>",
                         f"<div {self.named('content')}>{inner}</div>", f"<div id='page'><div>{inner}</div></div>",
                         f"<article {self.named('content')}><section>{inner}</section></article>")

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.05:
            return self.pick("", "<html><body>") + "".join(f"<p>{self.text(1, 3, 60)}</p>" for _ in range(r.randint(1, 5)))
        if r.random() < 0.04:
            return self.text(1, 3, 60)
        before = [f for f, p in ((self.notice, 0.25), (self.top, 0.35), (self.menu, 0.85), (self.advert, 0.5), (self.side, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.comments, 0.3), (self.side, 0.35), (self.advert, 0.2), (self.form, 0.2), (self.share, 0.15), (self.bottom, 0.85),
                                (self.notice, 0.1)) if r.random() < p]
        return "".join(["<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>", *(f() for f in before), self.article(),
                        *(f() for f in after), "</body></html>" if r.random() < 0.9 else ""])


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """Pages in many layouts whose block texts hold their label (``MARK``)."""
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]


def labelled_blocks(page: str) -> list[tuple[int, int]]:
    """(feature bits, label) of a labelled page's blocks.  Marks are no white space and end no sentence, so bits stay as they are."""
    return [(bits, int(MARK[1] in text)) for text, bits in leaf_blocks(page)]


def _indicators(bits: list[int]) -> np.ndarray:
    """(blocks, features) 0/1 matrix of feature bits."""
    raw = np.array(bits, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :len(NAMES)]


@functools.lru_cache(maxsize=2)
def learn(n_pages: int = 400, seed: int = 11) -> crf.LinearChain:
    """The field fitted on ``n_pages`` labelled pages; feature ``2 i + b`` stands for bit i being b."""
    sequences = []
    for page in labelled_pages(n_pages, seed):
        if found := labelled_blocks(page):
            on = _indicators([b for b, _ in found]).astype(np.int64)
            sequences.append((2 * np.arange(len(NAMES)) + on, np.array([y for _, y in found])))
    return crf.train(sequences, 2 * len(NAMES), steps=120, penalty=0.3)


def content_blocks(blocks: list[tuple[str, int]], model: crf.LinearChain) -> list[str]:
    """Texts of the blocks on the best path that are content."""
    if not blocks:
        return []
    on, off = model.weights[1::2], model.weights[0::2]
    emissions = _indicators([b for _, b in blocks]) @ (on - off) + off.sum(0)
    return [t for (t, _), y in zip(blocks, model.decode(emissions)) if y]


def extract(html: str, model: crf.LinearChain) -> str:
    """The main text of one page."""
    return "\n\n".join(content_blocks(leaf_blocks(html), model))


def extract_pages(pages: DataFrame, model: crf.LinearChain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    fitted = model or learn()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                rows = []
                for p, u, h in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    text = extract(h or "", fitted)
                    rows.append((p, u, text, len(text)))
                yield to_batch(rows, schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
