"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding (operator 1).

A page is read into a tree of its block elements; inline elements only count in features.
Boosted trees give each node the probabilities of three roles: ``frame`` (its own text isn't
main text, but something below may be), ``main`` and ``other``. Decoding takes the most
probable roles of the whole tree under the rule that below ``other`` all is other and below
``main`` all is main or other, so an ancestor and a descendant never contradict each other.

There are no labelled pages in the tables, so the model is trained on labelled pages that
``example_page`` generates from many layouts; nothing of a table is learnt from.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import map_texts
from corvane.llm.boosted_trees import BoostedTrees

FRAME, MAIN, OTHER = 0, 1, 2
#: Generated training pages, and the seed of their generator.
EXAMPLES, SEED = 800, 7

# Elements of HTML that are blocks by default.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul head button".split()
)
# Elements without an end tag, and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea svg iframe object canvas audio video math".split())
# What an opening tag closes if it is still open, up to a limit.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
LIMITS = frozenset("ul ol dl menu table select body html article section div main aside nav header footer form".split())
NOT_IN_P = BLOCKS - {"option", "optgroup", "button"}

TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z))", re.DOTALL)
#: One attribute after the other, so that none is looked for inside another's name or value.
ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
TOKEN = re.compile(r"[a-z]+")

TAGS = {t: i for i, t in enumerate("html head body div article main section p h1 h2 h3 h4 h5 h6 ul ol li nav header footer aside form button table tr td blockquote pre figure figcaption dl dd dt".split(), 1)}


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "mark", "text", "links", "inline", "marks", "words", "children", "inputs")

    def __init__(self, tag: str, parent: int, depth: int, tokens: list[str], mark: str):
        self.tag, self.parent, self.depth, self.tokens, self.mark = tag, parent, depth, tokens, mark
        self.text = self.links = self.inline = self.marks = self.words = self.children = self.inputs = 0


def read_page(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block nodes in page order, and the text blocks as (node, text with single spaces)."""
    nodes = [Node("#", -1, 0, [], "")]
    stack, blocks, buffer = [0], [], []
    link_depth, at = 0, 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node = nodes[stack[-1]]
                node.text += len(text)
                node.words += text.count(" ") + 1
                node.marks += sum(map(text.count, ".,!?;:"))
                blocks.append((stack[-1], text))

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if link_depth:
            nodes[stack[-1]].links += len(text)
        buffer.append(text)

    while m := TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[6]
        if not name:
            continue
        name, closing = name.lower(), m[1] or m[5]
        if name in RAW:
            if not closing and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
        elif name == "a":
            link_depth = 0 if closing else 1
            nodes[stack[-1]].inline += 1
        elif name in ("br", "hr"):
            buffer.append(" ")
            nodes[stack[-1]].inline += 1
        elif name in ("input", "label", "option", "button") and name not in BLOCKS:
            nodes[stack[-1]].inputs += 1
        elif name in BLOCKS:
            flush()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == name:
                        del stack[depth:]
                        break
                continue
            link_depth = 0
            if name in NOT_IN_P:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = nodes[stack[depth]].tag
                    if tag == "p":
                        del stack[depth:]
                        break
                    if tag in LIMITS:
                        break
            if name in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = nodes[stack[depth]].tag
                    if tag in CLOSES[name]:
                        del stack[depth:]
                    elif tag in LIMITS:
                        break
            if name == "body":
                del stack[1 + (len(stack) > 1 and nodes[stack[1]].tag == "html") :]
            tokens, mark = [], ""
            attributes = m[3] if m[2] else m[7]
            if attributes:
                for a in ATTRIBUTE.finditer(attributes):
                    key, value = a[1].lower(), (a[2] or "").strip("\"'")
                    if key == "data-role-mark":
                        mark = value if value in ("frame", "main", "other") else ""  # a cut-off page has cut-off values
                    elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and UNSEEN.search(value):
                        tokens.append("hidden")
                    elif key in ("class", "id", "role"):
                        tokens += TOKEN.findall(value.lower())
            nodes[stack[-1]].children += 1
            nodes.append(Node(name, stack[-1], len(stack), tokens, mark))
            if name in ("button", "select"):
                nodes[-1].inputs += 1
            stack.append(len(nodes) - 1)
        else:
            nodes[stack[-1]].inline += 1
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")
        add(rest if cut < 0 or not re.match(r"<[/!?a-zA-Z]|<\Z", rest[cut:]) else rest[:cut])
    flush()
    return nodes, blocks


def features(nodes: list[Node], weights: dict[str, float]) -> list[list[float]]:
    """Own, subtree, sibling and ancestor measures of each node."""
    n = len(nodes)
    text, links, tags, marks, words, inputs, paragraphs = ([0.0] * n for _ in range(7))
    for i in range(n - 1, -1, -1):
        v = nodes[i]
        text[i] += v.text
        links[i] += min(v.links, v.text)
        tags[i] += 1 + v.inline
        marks[i] += v.marks
        words[i] += v.words
        inputs[i] += v.inputs
        paragraphs[i] += v.tag == "p"
        if v.parent >= 0:
            p = v.parent
            text[p] += text[i]
            links[p] += links[i]
            tags[p] += tags[i]
            marks[p] += marks[i]
            words[p] += words[i]
            inputs[p] += inputs[i]
            paragraphs[p] += paragraphs[i]
    total = text[0] + 1
    seen, rows, own, low, high, same = [0] * n, [], [0.0] * n, [0.0] * n, [0.0] * n, Counter((v.parent, v.tag) for v in nodes)
    for i, v in enumerate(nodes):
        p = max(v.parent, 0)
        own[i] = sum(weights.get(t, 0.0) for t in v.tokens)
        low[i], high[i] = min(own[i], low[p]), max(own[i], high[p])
        rows.append(
            [
                TAGS.get(v.tag, 0), TAGS.get(nodes[p].tag, 0), v.depth, v.text, text[i], text[i] / tags[i], links[i] / (text[i] + 1),
                marks[i] / (words[i] + 1), text[i] / (words[i] + 1), text[i] / total, text[i] / (text[p] + 1), v.children, nodes[p].children, seen[p],
                same[v.parent, v.tag], inputs[i], paragraphs[i], own[i], low[p], high[p], links[p] / (text[p] + 1), float("hidden" in v.tokens),
                v.text / (text[i] + 1), paragraphs[p], nodes[p].text / (text[p] + 1),
            ]
        )
        if v.parent >= 0:
            seen[v.parent] += 1
    return rows


def decode(nodes: list[Node], logs: list[list[float]]) -> list[int]:
    """The most probable roles of the tree; equal ones in the order frame, main, other."""
    n = len(nodes)
    best = [list(row) for row in logs]
    for i in range(n - 1, 0, -1):
        frame, main, other = best[i]
        up = best[nodes[i].parent]
        up[MAIN] += max(main, other)
        up[OTHER] += other
        up[FRAME] += max(frame, main, other)
    roles = [FRAME] * n
    for i, v in enumerate(nodes):
        above = roles[v.parent] if i else FRAME
        free = range(3) if above == FRAME else (MAIN, OTHER) if above == MAIN else (OTHER,)
        roles[i] = FRAME if not i else max(free, key=lambda r: best[i][r])
    return roles


def example_page(rng: random.Random) -> str:
    """A page of a random layout, whose elements carry their role in an attribute that only training reads."""
    syllables = [a + b for a in "b c d f g l m n p r s t v th st".split() for b in "a e i o u er in on é ä".split()]

    def prose(n: int) -> str:
        words = ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3)))) + rng.choice(("", "", "", "", ",", ".")) for _ in range(n)]
        if style < 0.15:
            words = [w + rng.choice(("###", "***", "&amp;&amp;", "$$$")) for w in words]
        return " ".join(words).capitalize() + ("." if rng.random() < 0.9 else "")

    def named(role: str, tag: str, names: str, inside: str, close: float = 1.0) -> str:
        name = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names.split("|"))}"' if names and rng.random() < 0.8 else ""
        return f'<{tag}{name} data-role-mark="{role}">{inside}' + (f"</{tag}>" if rng.random() < close else "")

    def links(n: int) -> str:
        items = [f'<a href="/x{k}">{prose(rng.randint(1, 4))}</a>' for k in range(n)]
        kind = rng.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind < 0.6 else "".join(f"<div>{x}</div>" for x in items) if kind < 0.8 else " | ".join(items)

    def unseen() -> str:
        mark = rng.choice((" hidden", ' style="display:none"', ' style="display: none; color:red"', ' aria-hidden="true"', ' style="visibility:hidden"'))
        tag = rng.choice(("p", "div", "section"))
        return f'<{tag}{mark} data-role-mark="other">{prose(rng.randint(3, 60))}</{tag}>'

    def paragraph(n: int) -> str:
        inner = prose(n)
        if rng.random() < 0.2:
            inner = f"<b>{inner}<br>" if rng.random() < 0.5 else f"{inner} <a href='/y'>{prose(2)}</a> {prose(4)}"
        plain = rng.choice((' style="border:none"', ' aria-label="hidden notes"', ' data-id="nav"', ' title="class=ad"')) if rng.random() < 0.03 else ""
        return f"<p{plain}>{inner}" + ("</p>" if rng.random() < 0.85 else "")

    style = rng.random()
    body = []
    if rng.random() < 0.7:
        body.append(named("other", rng.choice(("header", "div")), "header|masthead|top|site-header|logo", f"<h2>{prose(2)}</h2>" + (f"<p>{prose(6)}</p>" if rng.random() < 0.4 else "")))
    if rng.random() < 0.85:
        body.append(named("other", rng.choice(("nav", "nav", "div", "ul")), "nav|menu|navbar|breadcrumb|main-menu", links(rng.randint(3, 9))))
    extras = [
        lambda: named("other", "div", "ad|ads|advert|banner|sponsored|promo|ad-box", prose(rng.randint(3, 30))),
        lambda: named("other", rng.choice(("div", "section", "p")), "cookie|notice|consent|gdpr|alert|cookie-banner|message", prose(rng.randint(5, 40)) + (f"<button>{prose(1)}</button>" if rng.random() < 0.5 else "")),
        lambda: f'<form data-role-mark="other"><label>{prose(2)}</label><input type="text"><p>{prose(5)}</p><select><option>{prose(1)}<option>{prose(1)}</select><button>{prose(1)}</button></form>',
        lambda: named("other", "aside", "sidebar|related|widget|side", f"<h3>{prose(2)}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{prose(rng.randint(5, 40))}</p>")),
        lambda: named("other", "div", "sidebar|related|widget|share|social|newsletter|subscribe|popular|tags", links(rng.randint(2, 8)) if rng.random() < 0.6 else f"<h3>{prose(3)}</h3><p>{prose(rng.randint(8, 30))}</p>"),
    ]
    before = [rng.choice(extras)() for _ in range(rng.choice((0, 1, 1, 2)))]
    parts = [f"<{rng.choice(('h1', 'h1', 'h2'))}>{prose(rng.randint(2, 14))}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14))):
        kind = rng.random()
        parts.append(
            paragraph(rng.choice((2, 5, 12, 30, 60, 120))) if kind < 0.82 else f"<h2>{prose(4)}</h2>" if kind < 0.88 else f"<blockquote><p>{prose(20)}</p></blockquote>" if kind < 0.92 else "<ul>" + "".join(f"<li>{prose(9)}</li>" for _ in range(4)) + "</ul>" if kind < 0.97 else f"<table><tr><td>{prose(3)}</td><td>{prose(3)}</td></tr></table>"
        )
    for _ in range(rng.choice((0, 0, 0, 1))):
        parts.insert(rng.randint(0, len(parts)), rng.choice(extras[:2])())
    for _ in range(rng.choice((0, 0, 0, 0, 0, 1, 2))):
        parts.insert(rng.randint(0, len(parts)), unseen())
    tag, names = rng.choice((("article", "post|article|entry"), ("article", ""), ("main", "content|main"), ("div", "content|post|entry-content|article-body|story|main-text"), ("div", "content|post-body|text"), ("section", "article|story|content")))
    article = named("main", tag, names, "".join(parts))
    after = [rng.choice(extras)() for _ in range(rng.choice((0, 0, 1, 2)))]
    if rng.random() < 0.45:
        comments = "".join(named("other", rng.choice(("div", "li", "article")), "comment|reply|comment-body", f"<p>{prose(rng.randint(4, 40))}</p>") for _ in range(rng.randint(1, 5)))
        after.append(named("other", rng.choice(("section", "div", "ol")), "comments|comment-list|responses|discussion", f"<h3>{prose(2)}</h3>" + comments))
    middle = "".join([*before, article, *after])
    for _ in range(rng.choice((0, 0, 1, 2))):
        middle = named("frame", rng.choice(("div", "div", "main", "section")), "wrapper|container|page|row|layout|site", middle)
    body.append(middle)
    if rng.random() < 0.85:
        body.append(named("other", rng.choice(("footer", "footer", "div")), "footer|bottom|copyright|site-footer", f"&copy; {prose(rng.randint(2, 20))}" if rng.random() < 0.6 else links(4)))
    page = f'<!DOCTYPE html><html data-role-mark="frame"><head data-role-mark="other"><title>{prose(3)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body data-role-mark="frame">' + "".join(body) + "</body></html>"
    return page[: rng.randint(len(page) // 2, len(page))] if rng.random() < 0.08 else page


class MainTextModel:
    """Token weights and boosted trees, trained on generated pages."""

    def __init__(self, examples: int = EXAMPLES, seed: int = SEED):
        rng = random.Random(seed)
        pages = [read_page(example_page(rng))[0] for _ in range(examples)]
        names = {"frame": FRAME, "main": MAIN, "other": OTHER}
        labels = []
        for nodes in pages:
            own = []
            for v in nodes:
                own.append(names[v.mark] if v.mark else own[v.parent] if v.parent >= 0 else FRAME)
            labels.append(own)
        good, bad = Counter(), Counter()
        for nodes, own in zip(pages, labels, strict=True):
            for v, role in zip(nodes, own, strict=True):
                for t in set(v.tokens):
                    (bad if role == OTHER else good)[t] += 1
        self.weights = {t: math.log((good[t] + 0.5) / (bad[t] + 0.5)) for t in {*good, *bad}}
        x = np.array([row for nodes in pages for row in features(nodes, self.weights)])
        self.trees = BoostedTrees(3).fit(x, np.array([r for own in labels for r in own]))

    def extract(self, pages: list[str]) -> list[str]:
        """The main text of each page: its main blocks, joined by a line feed."""
        read = [read_page(p) for p in pages]
        rows = [row for nodes, _ in read for row in features(nodes, self.weights)]
        logs = self.trees.log_probabilities(np.array(rows)).tolist() if rows else []
        out, at = [], 0
        for nodes, blocks in read:
            roles = decode(nodes, logs[at : at + len(nodes)])
            at += len(nodes)
            out.append("\n".join(text for i, text in blocks if roles[i] == MAIN))
        return out


@functools.cache
def default_model() -> MainTextModel:
    return MainTextModel()


def extract_main_text(pages: DataFrame, model: MainTextModel | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per page: id, ``keep``, text and n_chars (code points).

    A null, empty or text-less page has the empty text. Pages of any length are read whole;
    cut-off pages and tags, and unknown elements, are read as far as they go. Repeated rows
    each get a row, an empty table an empty result; a kept column that is called like a result
    gives way to it. No shuffle; the model's size doesn't depend on the data.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def work(texts: pa.Array) -> dict:
        found = shared.value.extract(texts.to_pylist())
        return {"text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())}

    return map_texts(pages, work, "text string, n_chars long", id_col, html_col, keep, limit=1 << 20)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", F.col("text"), "n_chars")
