"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with its open
elements. Features come from ancestor tags, from words of their class, id and role, and from
the text (length, link share, punctuation). The field has two labels, text and boilerplate;
weights are learned by stochastic gradient on labelled pages, labels are decoded by Viterbi.

No table holds labelled pages, so ``labelled_pages`` writes them: layouts of known truth drawn
by a seeded generator. ``train`` takes any pages in that form.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import with_fields

# HTML's own sets of elements: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title iframe object svg math canvas audio video select textarea datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt s samp small span strike strong sub sup time tt u var wbr img label".split())
#: An opening tag closes the open element of these names, up to the nearest of the stops.
CLOSES = {
    "p": (("p",), ("button", "td", "th", "table")),
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Block-level tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+|(?<=[a-z])[A-Z]")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Context:
    """The open elements above a block, as features; shared by all blocks below the same elements."""

    __slots__ = ("tag", "marks", "features", "below", "inline")

    def __init__(self, tag: str, marks: tuple[str, ...], features: frozenset[str], inline: bool) -> None:
        self.tag, self.marks, self.features, self.inline = tag, marks, features, inline
        self.below: dict[tuple[str, str], Context] = {}

    def child(self, tag: str, attrs: str) -> Context:
        found = self.below.get((tag, attrs))
        if found is None:
            marks = _marks(attrs)
            inline = tag in INLINE
            own = () if inline and not marks else (f"in={tag}", *(f"mark={m}" for m in marks))
            found = Context(tag, marks, self.features if self.features.issuperset(own) else self.features.union(own), inline)
            if len(self.below) < 4096:  # odd attributes are not kept for ever
                self.below[tag, attrs] = found
        return found


def _marks(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role, and whether the element is hidden."""
    out: list[str] = []
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.append("hidden")
        elif name in ("class", "id", "role"):
            out += [w.rstrip("s") for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if len(w) > 1]
    return tuple(dict.fromkeys(out))


@dataclass
class Block:
    text: str
    context: Context
    tag: str
    linked: int  # characters within links
    features: list[str] = field(default_factory=list)


_ROOT = Context("", (), frozenset(), False)


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space runs as one space, trimmed; empty ones left out."""
    if not page:
        return []
    global _ROOT
    if len(_ROOT.below) > 512:
        _ROOT = Context("", (), frozenset(), False)
    stack = [_ROOT]
    opened: dict[str, int] = {}  # how many elements of a tag are open: the stack is searched only for those that are
    blocks: list[Block] = []
    buffer: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            if text:
                top = stack[-1]
                tag = next((c.tag for c in reversed(stack) if not c.inline), "")
                blocks.append(Block(text, top, tag, linked))
            buffer.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link
        for c in stack[depth:]:
            opened[c.tag] -= 1
            if c.tag == "a":
                in_link -= 1
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            text = page[at : lt if lt >= 0 else n]
            buffer.append(text)
            if in_link:
                linked += len(text)
            if lt < 0:
                break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            elif page[lt + 1 : lt + 2].isalpha():
                break  # a tag that the page's end cuts off
            else:
                buffer.append("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag == "br":
            buffer.append(" ")
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened.get(tag) else 0
            if tag not in INLINE:
                flush()
            if depth:
                if tag in INLINE and any(not c.inline for c in stack[depth:]):
                    continue  # closes across a block: no effect on the blocks
                pop_to(depth)
            continue
        if tag in RAW:
            if tag not in ("svg", "math", "img"):
                flush()
            if not attrs.endswith("/") or tag not in ("svg", "math"):
                end = _END_RAW[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag not in INLINE:
            flush()
            if (tag in ENDS_P or tag == "p") and opened.get("p"):
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", "button", "td", "th", "table")), 0)
                if depth and stack[depth].tag == "p":
                    pop_to(depth)
            if tag in CLOSES and tag != "p":
                names, stops = CLOSES[tag]
                for i in range(len(stack) - 1 if any(map(opened.get, names)) else 0, 0, -1):
                    if stack[i].tag in stops:
                        break
                    if stack[i].tag in names:
                        pop_to(i)
                        break
        if tag not in VOID and not (attrs.endswith("/") and tag not in INLINE and tag not in ENDS_P and tag != "p"):
            stack.append(stack[-1].child(tag, attrs))
            opened[tag] = opened.get(tag, 0) + 1
            in_link += tag == "a"
    flush()
    return blocks


def text_features(block: Block) -> list[str]:
    """Features of the block's text and own tag."""
    text = block.text
    n = text.count(" ") + 1
    size = min(7, n.bit_length())
    share = min(4, 4 * block.linked // max(1, len(text)))
    out = ["bias", f"tag={block.tag}", f"words={size}", f"links={share}"]
    if text[-1] in ".!?\"'»”…":
        out.append("ends")
    low = text.lower()
    if "©" in low or "copyright" in low or "all rights reserved" in low:
        out.append("rights")
    if n <= 3:
        out.append(f"short:{block.tag}")
    return out


@dataclass
class Field:
    """Log-odds weights of the label text, and transition scores; labels: 0 boilerplate, 1 text."""

    weights: dict[str, float]
    steps: list[list[float]]
    start: list[float]
    known: dict[frozenset, float] = field(default_factory=dict, repr=False)

    def score(self, block: Block) -> float:
        own = self.known.get(block.context.features)
        if own is None:
            own = sum(self.weights.get(f, 0.0) for f in block.context.features)
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[block.context.features] = own
        return own + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels of a page by Viterbi; ties go to boilerplate."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.steps
        a, b = self.start[0], self.start[1] + self.score(blocks[0])
        back = []
        for block in blocks[1:]:
            e = self.score(block)
            from0, from1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((from0, from1))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def _log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def train(pages: list[tuple[str, list[int]]], rounds: int = 8, rate: float = 0.3, penalty: float = 1e-4, seed: int = 5) -> Field:
    """Maximum conditional likelihood by AdaGrad. pages: html and the label of each leaf block."""
    data = []
    for page, labels in pages:
        blocks = leaf_blocks(page)
        if blocks and len(blocks) == len(labels):
            data.append(([sorted(b.context.features) + text_features(b) for b in blocks], labels))
    w: dict[str, float] = {}
    g: dict[str, float] = {}
    trans, start = [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0]
    g_trans, g_start = [[1e-6, 1e-6], [1e-6, 1e-6]], [1e-6, 1e-6]
    rng = random.Random(seed)

    for _ in range(rounds):
        rng.shuffle(data)
        for feats, labels in data:
            n = len(feats)
            e = [(0.0, sum(w.get(f, 0.0) for f in fs)) for fs in feats]
            alpha = [[start[y] + e[0][y] for y in (0, 1)]]
            for i in range(1, n):
                alpha.append([_log_add(alpha[-1][0] + trans[0][y], alpha[-1][1] + trans[1][y]) + e[i][y] for y in (0, 1)])
            beta = [[0.0, 0.0]]
            for i in range(n - 1, 0, -1):
                nxt = beta[-1]
                beta.append([_log_add(trans[x][0] + e[i][0] + nxt[0], trans[x][1] + e[i][1] + nxt[1]) for x in (0, 1)])
            beta.reverse()
            z = _log_add(alpha[-1][0], alpha[-1][1])
            d_trans = [[0.0, 0.0], [0.0, 0.0]]
            for i in range(1, n):
                for x in (0, 1):
                    for y in (0, 1):
                        d_trans[x][y] -= math.exp(alpha[i - 1][x] + trans[x][y] + e[i][y] + beta[i][y] - z)
                d_trans[labels[i - 1]][labels[i]] += 1
            slope: dict[str, float] = {}
            for i in range(n):
                p = math.exp(alpha[i][1] + beta[i][1] - z)
                for f in feats[i]:
                    slope[f] = slope.get(f, 0.0) + labels[i] - p
            for y in (0, 1):
                d = (labels[0] == y) - math.exp(alpha[0][y] + beta[0][y] - z)
                g_start[y] += d * d
                start[y] += rate * d / math.sqrt(g_start[y])
                for x in (0, 1):
                    d = d_trans[x][y]
                    g_trans[x][y] += d * d
                    trans[x][y] += rate * d / math.sqrt(g_trans[x][y])
            for f, d in slope.items():
                d -= penalty * w.get(f, 0.0)
                g[f] = g.get(f, 1e-6) + d * d
                w[f] = w.get(f, 0.0) + rate * d / math.sqrt(g[f])
    return Field(w, trans, start)


# ---------------------------------------------------------------- labelled pages

_SIDE = {
    "nav": ("<nav{a}>{links}</nav>", ("menu", "navigation", "main-nav", "")),
    "menu": ("<div{a}>{links}</div>", ("menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "topbar")),
    "header": ("<header{a}>{heads}</header>", ("site-header", "masthead", "header", "")),
    "head_div": ("<div{a}>{heads}</div>", ("header", "masthead", "page-header", "site-head", "logo", "tagline")),
    "footer": ("<footer{a}>{foot}</footer>", ("footer", "site-footer", "")),
    "foot_div": ("<div{a}>{foot}</div>", ("footer", "bottom", "copyright", "legal", "colophon", "page-footer")),
    "aside": ("<aside{a}>{mixed}</aside>", ("sidebar", "widget", "related", "")),
    "side_div": ("<div{a}>{mixed}</div>", ("sidebar", "side", "widget", "right-rail", "related", "recommended", "trending", "popular", "more-stories", "tags", "author-bio")),
    "ad": ("<div{a}>{prose}</div>", ("ad", "ads", "advert", "advertisement", "adbox", "sponsored", "sponsor", "promo", "promotion", "banner", "ad-banner")),
    "notice": ("<div{a}>{prose}</div>", ("notice", "cookie", "cookie-notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "warning", "disclaimer")),
    "form": ("<form{a}>{form}</form>", ("search", "login", "signup", "contact", "")),
    "form_div": ("<div{a}>{form}</div>", ("search-form", "login-form", "subscribe", "form", "newsletter-form")),
    "share": ("<div{a}>{links}</div>", ("share", "social", "sharing", "follow", "toolbar", "buttons")),
    "comments": ("<section{a}>{replies}</section>", ("comments", "comment-list", "reader-comments", "discussion", "responses")),
    "comment_div": ("<div{a}>{replies}</div>", ("comments", "comment-thread", "disqus", "replies", "reply", "user-comments")),
    "hidden": ("<div{a}>{prose}</div>", ("hidden", "visually-hidden", "sr-only", "skip")),
}
_MAIN = ("<article{a}>{body}</article>", "<main{a}>{body}</main>", "<main><article{a}>{body}</article></main>", "<div{a}>{body}</div>", "<section{a}>{body}</section>", "<div id=\"page\"><div{a}>{body}</div></div>")
_MAIN_MARKS = ("content", "article", "post", "entry", "story", "article-body", "post-content", "main", "text", "entry-content", "")
_SAID = "\x02"  # marks main text within a page while it is drawn


def labelled_pages(count: int = 500, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of drawn layouts with the label of each leaf block: what a training table of labelled pages would hold."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(("ta", "ri", "on", "el", "mu", "sé", "der", "th", "ing", "ko", "ña", "ün")) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return words(a, b).capitalize() + rng.choice((".", ".", ".", "!", "?", "", " |", "$$$"))

    def prose(sents: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, sents)))

    def links(a: int = 2, b: int = 8) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(a, b))]
        return rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), "".join(f"<div>{x}</div>" for x in items)))

    def side(kind: str) -> str:
        shape, marks = _SIDE[kind]
        mark = rng.choice(marks)
        name = rng.choice(("class", "id", "class"))
        attr = f' {name}="{mark}"' if mark else ""
        if attr and name == "class" and rng.random() < 0.3:
            attr = f' class="{mark} {word()}"'
        fill = {
            "a": attr,
            "links": lambda: links(),
            "heads": lambda: rng.choice((f"<h1>{words(1, 5)}</h1>", f"<p>{words(1, 8)}</p>", f"<a href='/'>{words(1, 3)}</a>", f"<h2>{words(1, 4)}</h2><p>{sentence()}</p>")) + (links(1, 4) if rng.random() < 0.3 else ""),
            "foot": lambda: rng.choice((f"&copy; {word()} &middot; {prose(2)}", f"<p>{sentence()}</p>", f"<p>Copyright {words(1, 4)}</p>" + links(1, 4), prose(3))),
            "mixed": lambda: rng.choice((f"<h3>{words(1, 4)}</h3>" + links(), f"<p>{prose(3)}</p>", f"<h2>{words(1, 3)}</h2><p>{prose(2)}</p><ul><li>{words(1, 5)}</li></ul>")),
            "prose": lambda: rng.choice((prose(3), f"<p>{prose(4)}</p>", f"<h4>{words(1, 4)}</h4><p>{prose(2)}</p>", f"<a href='#'>{words(1, 5)}</a>", f"<span>{prose(2)}</span>")),
            "form": lambda: f"<label>{words(1, 3)}</label><input type=text>" + rng.choice((f"<button>{words(1, 2)}</button>", f"<p>{sentence()}</p><button>{words(1, 2)}</button>", f"<div>{prose(2)}</div>")),
            "replies": lambda: "".join(rng.choice((f"<div class='comment'><p>{prose(5)}</p></div>", f"<p>{prose(4)}</p>", f"<article class='comment'><h4>{words(1, 2)}</h4><p>{prose(4)}</p></article>", f"<ol><li>{prose(3)}</li></ol>", f"<b>{word()}</b>: {prose(3)}")) for _ in range(rng.randint(1, 4))),
        }
        return re.sub(r"\{(\w+)\}", lambda m: fill[m[1]] if isinstance(fill[m[1]], str) else fill[m[1]](), shape)

    def main_part() -> str:
        kind = rng.random()
        s = _SAID
        if kind < 0.55:
            inner = prose(8)
            if rng.random() < 0.3:
                inner = f"<b>{inner}</b>" if rng.random() < 0.5 else f"<b>{inner}<br>"
            if rng.random() < 0.25:
                inner += f' <a href="/{word()}">{words(1, 4)}</a> {words(1, 6)}.'
            return f"<p>{s}{inner}</p>"
        if kind < 0.65:
            return f"<p>{s}{words(1, 4)}{rng.choice(('.', ''))}</p>"
        if kind < 0.75:
            h = rng.randint(2, 4)
            return f"<h{h}>{s}{words(1, 8)}</h{h}>"
        if kind < 0.83:
            return "<ul>" + "".join(f"<li>{s}{sentence(1, 12)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{s}{prose(3)}</blockquote>"
        if kind < 0.92:
            return "<table><tr>" + "".join(f"<td>{s}{words(1, 4)}</td>" for _ in range(rng.randint(1, 4))) + "</tr></table>"
        if kind < 0.95:
            return f"<pre>{s}{words(2, 20)}</pre>"
        return f"<div>{s}{prose(4)}</div>"

    out = []
    for _ in range(count):
        body = []
        if rng.random() < 0.7:
            body.append(f"<h1>{_SAID}{words(1, 9)}{rng.choice(('', '.', '!'))}</h1>")
        for _ in range(rng.randint(1, 9)):
            body.append(main_part())
            if rng.random() < 0.12:
                body.append(side(rng.choice(("ad", "share", "aside", "notice", "form", "side_div"))))
        shape = rng.choice(_MAIN)
        mark = rng.choice(_MAIN_MARKS)
        main = shape.replace("{a}", f' class="{mark}"' if mark else "").replace("{body}", "".join(body))
        if rng.random() < 0.1:
            main = "".join(body)
        kinds = list(_SIDE)
        before = [side(rng.choice(kinds)) for _ in range(rng.randint(0, 4))]
        after = [side(rng.choice(kinds)) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.5:
            before = [side("nav"), *before, side("ad")]
            after = [*after, side("footer")]
        page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
        labels = [int(_SAID in b.text) for b in leaf_blocks(page)]
        out.append((page.replace(_SAID, ""), labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, model.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, model: Field | None = None, source: str = "html", blocks: bool = False) -> DataFrame:
    """pages with `main_text` and, if asked, `blocks` (text, tag, main) of the whole html.

    Null and empty html give an empty text and no blocks; html is read whole whatever its length
    and depth. Labellings of equal score go to boilerplate. Repeated rows get the same answer each,
    an empty table gives none. Columns of these two names in the input are replaced, all others
    stay. Rows are independent; nothing is shuffled.
    """
    added = ["main_text"] + ["blocks"] * blocks
    src = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in added))
    schema = with_fields(src, "main_text string" + ", blocks array<struct<text:string,tag:string,main:boolean>>" * blocks)
    held = src.sparkSession.sparkContext.broadcast(model or default_field())  # a few hundred weights
    kind = pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string()), ("main", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            texts, found = [], []
            for value in batch.column(source):
                page = leaf_blocks(value.as_py())
                labels = f.decode(page)
                texts.append("\n\n".join(b.text for b, y in zip(page, labels, strict=True) if y))
                if blocks:
                    found.append([{"text": b.text, "tag": b.tag, "main": bool(y)} for b, y in zip(page, labels, strict=True)])
            cols = [*batch.columns, pa.array(texts, pa.string())] + ([pa.array(found, kind)] if blocks else [])
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *added])

    return src.mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
