"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the stretches of text between block-level tags. Each block has
features of its ancestor tags (names, class and id words) and of its text; a chain over the page's
blocks decides which are main text. Weights are learned from labelled pages, decoding is Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import bounded, by_bytes

#: Pages that lend their sentences to the labelled pages, labelled pages made, and training steps.
#: Sentences of more than SENTENCE characters are not lent.
SENTENCE = 1_000
SOURCE_PAGES, LABELLED_PAGES, STEPS, RATE, RIDGE = 200, 600, 300, 0.1, 0.0005

# HTML's element kinds.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "template textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template title textarea iframe object svg math select head xmp noembed noframes".split())
#: Any other opening tag, and any text, ends an open head.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes".split())
CLOSES_P = BLOCK_TAGS - {"button", "body", "caption", "dialog", "head", "html", "legend", "option", "select", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr"}
#: An opening tag ends an open element of these kinds, unless one of the kinds behind it stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# A quote opens a value right behind "=" only; elsewhere it belongs to a name or a bare value.
_VALUE = r"""\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*|)"""
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=" + _VALUE + r")*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)\s*(?:=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Around:
    """An open element that counts, in the chain of those around a block: its tag, and the features that it adds to theirs."""

    outer: Around | None
    tag: str
    adds: tuple[str, ...]


@dataclass
class Block:
    """A leaf block: text with white space turned into single spaces, and the open elements around it."""

    text: str
    around: Around | None
    linked: int  # characters inside links


def _element(tag: str, attributes: str) -> tuple[str, tuple[str, ...], bool]:
    """(tag, words of class, id and role, is hidden)."""
    words, hidden, seen = [], tag in HIDDEN_TAGS, set()
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in seen:  # the first of a name counts
                continue
            seen.add(name)
            if name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden = hidden or value.strip().lower() == "true"
            elif name == "style":
                hidden = hidden or bool(_HIDDEN_STYLE.search(value))
            elif name in ("class", "id", "role", "itemprop"):
                words.extend(p.lower() for p in _PARTS.findall(value))
    return tag, tuple(dict.fromkeys(words)), hidden


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks with text in page order; scripts, styles, comments and other hidden parts hold none.

    Never fails: end tags that match nothing are ignored, what is open at the end is closed.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, bool, Around | None]] = []
    places: dict[str, list[int]] = {}  # of each tag's open elements
    held: set[str] = set()  # features of the open elements
    pieces: list[tuple[str, bool]] = []
    links = hidden = at = 0

    def close() -> None:
        nonlocal pieces
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
            if text:
                linked = sum(len(_SPACE.sub(" ", html.unescape(p)).strip()) for p, is_link in pieces if is_link)
                blocks.append(Block(text, stack[-1][2] if stack else None, min(linked, len(text))))
            pieces = []

    def pop(to: int) -> None:
        nonlocal links, hidden
        while len(stack) > to:
            tag, is_hidden, around = stack[-1]
            if tag in BLOCK_TAGS or is_hidden:
                close()
            stack.pop()
            places[tag].pop()
            if around is not (stack[-1][2] if stack else None):
                held.difference_update(around.adds)
            links -= tag == "a"
            hidden -= is_hidden

    def last(kinds, until) -> int:
        place = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)
        i = place(kinds)
        return i if i > place(until) else -1

    def push(tag: str, words: tuple[str, ...], is_hidden: bool) -> None:
        around = stack[-1][2] if stack else None
        if tag in BLOCK_TAGS or words:
            adds = tuple(f for f in (f"in:{tag}", *(f"word:{w}" for w in words)) if f not in held)
            held.update(adds)
            around = Around(around, tag, adds)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, is_hidden, around))

    size = len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        start = m.start() if m else size
        if start > at and stack and stack[-1][0] == "head" and not page[at:start].isspace():
            pop(len(stack) - 1)
        if start > at and not hidden:
            pieces.append((page[at:start], links > 0))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            i = last({tag}, ())
            if i >= 0:
                if tag in BLOCK_TAGS:
                    close()
                pop(i)
            elif tag == "p":
                close()
            continue
        if tag == "body":
            i = last({"head"}, {"template"})
            if i >= 0:
                pop(i)
        elif tag not in HEAD_TAGS and stack and stack[-1][0] == "head":
            pop(len(stack) - 1)
        if tag in CLOSES_P:
            i = last({"p"}, {"button", "table", "td", "th", "caption"})
            if i >= 0:
                pop(i)
        if tag in ENDS:
            i = last(*ENDS[tag])
            if i >= 0:
                pop(i)
        if tag in BLOCK_TAGS:
            close()
        elif tag == "br":
            pieces.append((" ", False))
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
        element = _element(tag, m[3])
        push(*element)
        links += tag == "a"
        hidden += element[2]
    pop(0)
    close()
    return blocks


def _own_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block's text, place, innermost element and neighbours."""
    out, n = [], len(blocks)
    form = [f"{b.around.tag if b.around else ''}:{min(6, (b.text.count(' ') + 1).bit_length())}:{min(2, int(2 * b.linked / len(b.text)))}" for b in blocks]
    for i, b in enumerate(blocks):
        f = ["bias"]
        if b.around:
            f.append(f"own:{b.around.tag}")
        size = len(b.text)
        f.append(f"size:{min(8, size.bit_length())}")
        f.append(f"links:{min(4, int(4 * b.linked / size))}")
        words = b.text.count(" ") + 1
        f.append(f"words:{min(6, words.bit_length())}")
        f.append("stop" if b.text[-1] in ".!?…:;\"'”»" else "nostop")
        if "©" in b.text:
            f.append("copyright")
        if "|" in b.text or "»" in b.text or "›" in b.text:
            f.append("bars")
        if sum(c.isdigit() for c in b.text) * 5 > size:
            f.append("digits")
        f.append(f"form:{form[i]}")
        f.append(f"before:{form[i - 1]}" if i else "first")
        f.append(f"behind:{form[i + 1]}" if i < n - 1 else "last")
        out.append(f)
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold, per block, those of all elements around it included."""
    out = _own_features(blocks)
    for f, b in zip(out, blocks, strict=True):
        around = b.around
        while around:
            f.extend(around.adds)
            around = around.outer
    return out


@dataclass
class ChainModel:
    """Weights of 'is main text' per feature, and of the four pairs of neighbouring labels."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> ChainModel:
    """Penalised likelihood of labelled chains (features per block, label per block), by Adam steps.

    Forward and backward sums run over all chains side by side.
    """
    pages = [p for p in pages if p[0]]
    if not pages:
        return ChainModel()
    names = sorted({f for fs, _ in pages for block in fs for f in block})
    number = {f: k for k, f in enumerate(names)}
    count, longest = len(pages), max(len(fs) for fs, _ in pages)
    chain = np.array([c for c, (fs, _) in enumerate(pages) for b in fs for _ in b])
    place = np.array([t for fs, _ in pages for t, b in enumerate(fs) for _ in b])
    feat = np.array([number[f] for fs, _ in pages for b in fs for f in b])
    size = np.array([len(fs) for fs, _ in pages])
    inside = np.arange(longest)[:, None] < size[None, :]
    gold = np.zeros((longest, count))
    for c, (_, labels) in enumerate(pages):
        gold[: len(labels), c] = labels
    joint = inside[1:]
    seen = np.array([[((gold[:-1] == a) & (gold[1:] == b) & joint).sum() for b in (0, 1)] for a in (0, 1)], float)
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    blocks = size.sum()
    for step in range(1, steps + 1):
        score = np.bincount(place * count + chain, weights=theta[feat], minlength=longest * count).reshape(longest, count)
        pair = theta[-4:].reshape(2, 2)
        node = np.stack([np.zeros_like(score), score], axis=-1)
        alpha, beta = np.zeros((longest, count, 2)), np.zeros((longest, count, 2))
        alpha[0] = node[0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[t - 1, :, 0, None] + pair[0], alpha[t - 1, :, 1, None] + pair[1]) + node[t]
            alpha[t] = np.where(inside[t][:, None], new, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = node[t + 1] + beta[t + 1]
            new = np.logaddexp(pair[:, 0][None] + ahead[:, 0, None], pair[:, 1][None] + ahead[:, 1, None])
            beta[t] = np.where(inside[t + 1][:, None], new, 0)
        total = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        p = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - total)) * inside
        grad = np.zeros_like(theta)
        grad[:-4] = np.bincount(feat, weights=(p - gold * inside)[place, chain], minlength=len(names))
        for a in (0, 1):
            for b in (0, 1):
                two = alpha[:-1, :, a] + pair[a, b] + node[1:, :, b] + beta[1:, :, b] - total
                grad[len(names) + 2 * a + b] = (np.exp(np.minimum(0, two)) * joint).sum() - seen[a, b]
        grad = grad / blocks + RIDGE * theta / 10
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    pair = theta[-4:].reshape(2, 2).tolist()
    return ChainModel({f: float(w) for f, w in zip(names, theta, strict=False) if abs(w) > 1e-4}, (tuple(pair[0]), tuple(pair[1])))


def scores(model: ChainModel, blocks: list[Block]) -> list[float]:
    """Sum of the weights of each block's features; elements around several blocks are summed once."""
    sums: dict[Around | None, float] = {None: 0.0}
    out, get = [], model.weights.get
    for f, b in zip(_own_features(blocks), blocks, strict=True):
        todo, around = [], b.around
        while around not in sums:
            todo.append(around)
            around = around.outer
        for x in reversed(todo):
            sums[x] = sums[x.outer] + sum(get(name, 0.0) for name in x.adds)
        out.append(sums[b.around] + sum(get(name, 0.0) for name in f))
    return out


def decode(model: ChainModel, found: list[list[str]]) -> list[int]:
    """Most likely labels of a chain with the given features (Viterbi); ties go to 'not main text'."""
    return viterbi(model, [sum(model.weights.get(f, 0.0) for f in block) for block in found])


def viterbi(model: ChainModel, weights: list[float]) -> list[int]:
    """Most likely labels of a chain of blocks with these scores for 'main text'."""
    if not weights:
        return []
    (p00, p01), (p10, p11) = model.pairs
    back, zero, one = [], 0.0, weights[0]
    for w in weights[1:]:
        back.append((one + p10 > zero + p00, one + p11 > zero + p01))
        zero, one = max(zero + p00, one + p10), max(zero + p01, one + p11) + w
    labels = [int(one > zero)]
    for choice in reversed(back):
        labels.append(int(choice[labels[-1]]))
    return labels[::-1]


def main_text(model: ChainModel, page: str | None) -> str:
    """Main blocks joined by line ends; empty for a null page or one without main text."""
    blocks = leaf_blocks(page or "")
    labels = viterbi(model, scores(model, blocks))
    return "\n".join(b.text for b, is_main in zip(blocks, labels, strict=True) if is_main)


# --- labelled pages ---------------------------------------------------------------------------------------------------

# Names that sites give to the parts around an article.
_AROUND = {
    "menu": ("nav", ["menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumb", "pagination"]),
    "header": ("header", ["header", "site-header", "masthead", "banner", "branding", "top-bar"]),
    "footer": ("footer", ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"]),
    "sidebar": ("aside", ["sidebar", "side", "rail", "widget", "related", "recommended", "popular", "trending", "tags", "toc", "author-bio"]),
    "advert": ("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbygoogle"]),
    "notice": ("div", ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "overlay"]),
    "form": ("form", ["form", "search", "login", "signup", "contact-form", "comment-form"]),
    "comments": ("section", ["comments", "comment-list", "comment", "responses", "discussion", "replies", "disqus"]),
    "share": ("div", ["share", "social", "sharing", "follow-us", "meta", "byline", "toolbar"]),
}
_CONTENT = ["content", "article-body", "post", "entry-content", "story", "post-content", "main-content", "text", "article", "body"]


#: Share of labelled pages whose parts carry no telling names, and kinds of parts that such pages hold: their form tells them.
NAMELESS, TOLD_BY_FORM = 0.35, frozenset(("menu", "header", "footer", "form", "share"))


def labelled_pages(
    sentences: list[str], count: int, seed: int = 7, nameless: float = NAMELESS
) -> Iterator[tuple[str, list[int]]]:
    """(html, label of each leaf block) of pages laid out in many ways around the given sentences.

    In a share of the pages, all parts sit in plain elements without names or with random ones, as
    generated style sheets give; there, length, links, sentence ends and place must decide.

    Each page has an article and some of the parts around one; the layout decides a block's label, so
    labels are known by construction. Sentences appear on both sides, so that text alone cannot tell.
    """
    draw = random.Random(seed)
    sentences = sentences or ["A short line.", "Another line of text, a little longer than the first one.", "Words"]

    def words(least: int, most: int) -> str:
        return html.escape(" ".join(draw.choice(sentences).split()[: draw.randint(least, most)]) or "Text")

    def paragraph() -> str:
        text = " ".join(draw.choice(sentences) for _ in range(draw.choice([1, 1, 2, 4, 8])))
        return html.escape(text) or "Text"

    def random_name() -> str:
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return draw.choice(["css-", "sc-", "_", "x", "jsx-"]) + "".join(draw.choice(letters) for _ in range(draw.randint(4, 8)))

    def nameless_box(inner: str) -> str:
        for _ in range(draw.randint(1, 3)):
            mark = draw.choice(["", f' class="{random_name()}"', f' class="{random_name()} {random_name()}"', f' id="{random_name()}"'])
            inner = f"<div{mark}>{inner}</div>"
        return inner

    def named(tag: str, names: list[str], inner: str, plain: float) -> str:
        if bare:
            return f"<form>{nameless_box(inner)}</form>" if tag == "form" else nameless_box(inner)
        name = draw.choice(names)
        mark = draw.choice(["", f' class="{name}"', f' class="{name}"', f' id="{name}"', f' class="{name} block-{draw.randint(1, 99)}"'])
        if draw.random() < plain:
            return f"<{tag}{mark}>{inner}</{tag}>"
        return f'<div class="{name}">{inner}</div>'

    def around(kind: str) -> str:
        tag, names = _AROUND[kind]
        if kind in ("menu", "share") or kind in ("sidebar", "footer", "header") and draw.random() < 0.4:
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(draw.randint(2, 8))) + "</ul>"
        elif kind == "form":
            inner = f'<label>{words(1, 4)}</label><input type="text" name="q"><p>{words(2, 8)}</p><button>{words(1, 2)}</button>'
        elif kind == "comments":
            one = draw.choice(['<div class="comment"><p>%s</p></div>', "<p>%s</p>", '<li class="comment">%s</li>'])
            inner = "".join(one % paragraph().replace("%", "") for _ in range(draw.randint(1, 4)))
        elif kind == "footer":
            inner = f"&copy; {words(1, 3)} &middot; {words(2, 12)}"
        elif bare or draw.random() < 0.5:
            inner = words(2, 5 if bare else 20)
        else:
            inner = "".join(f"<p>{paragraph() if draw.random() < 0.5 else words(2, 15)}</p>" for _ in range(draw.randint(1, 3)))
        return named(tag, names, inner, 0.6 if tag != "div" else 1.0)

    def article() -> str:
        parts = [f"<h1>{words(4, 12)}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.randint(1, 9)):
            kind = draw.random()
            if kind < 0.72:
                opening = "<p>" + ("<b>" if draw.random() < 0.2 else "")
                parts.append(f"{opening}{paragraph()}" + draw.choice(["</p>", "</p>", "</p>", "<br>"]))
            elif kind < 0.82:
                level = draw.choice("234")
                parts.append(f"<h{level}>{words(2, 8)}</h{level}>")
            elif kind < 0.9:
                parts.append("<ul>" + f"<li>{words(3, 15)}" + f"<li>{words(3, 15)}</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote>{paragraph()}</blockquote>")
            else:
                parts.append(f"<p>{paragraph()} <a href='/x'>{words(1, 4)}</a> {words(3, 12)}</p>")
        body = "\n".join(parts)
        form = draw.random()
        if bare:
            return nameless_box(body)
        if form < 0.5:
            body = f"<article>{body}</article>"
        elif form < 0.65:
            body = f"<main>{body}</main>"
        else:
            body = f'<div class="{draw.choice(_CONTENT)}">{body}</div>'
        return f"<main>{body}</main>" if draw.random() < 0.2 else body

    for _ in range(count):
        bare = draw.random() < nameless
        before = [k for k in ("header", "menu", "notice", "advert", "sidebar", "form", "share") if draw.random() < 0.4]
        after = [k for k in ("share", "advert", "sidebar", "form", "comments", "notice", "footer") if draw.random() < 0.4]
        if bare:
            before, after = ([k for k in kinds if k in TOLD_BY_FORM] for kinds in (before, after))
        chain, labels = [], []
        for kind in [*before, "article", *after]:
            piece = article() if kind == "article" else around(kind)
            chain.append(piece)
            labels += [int(kind == "article")] * len(leaf_blocks(piece))
        page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var a='<p>';</script></head><body>{''.join(chain)}"
        page += draw.choice(["</body></html>", ""])
        if len(leaf_blocks(page)) == len(labels):  # parts that run into each other have no clear label
            yield page, labels


def learn(pages: DataFrame, source_pages: int = SOURCE_PAGES, count: int = LABELLED_PAGES) -> ChainModel:
    """A model learned from ``count`` labelled pages laid out around sentences of at most about
    ``source_pages`` rows of ``pages``. Works without rows: the layout carries the labels."""
    rows = bounded(pages.select("page_id", "html").where("html is not null"), "page_id", source_pages).collect()
    lines = []
    for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0, r.html)):
        for b in leaf_blocks(r.html):
            lines.extend(x for x in re.split(r"(?<=[.!?]) ", b.text) if 0 < len(x) <= SENTENCE)
    return fit([(features(leaf_blocks(page)), labels) for page, labels in labelled_pages(lines, count)])


def extract(pages: DataFrame, model: ChainModel) -> DataFrame:
    """page_id, url, text (main blocks joined by line ends, empty if none), n_chars of every row; no shuffle.

    Null and empty pages give an empty text. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches):
        for batch in by_bytes(batches, "html"):
            texts = [main_text(model, page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

