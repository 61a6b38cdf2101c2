"""Main-text extraction from HTML by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in page order: runs of text between block-level tags, with their
open ancestors. Each block has features of its ancestors' tags and of the words in their class, id
and role attributes, and of its text (length, share of link text, sentence ends, telling words). The field gives
blocks one of two labels, main or other, with weights for features and for neighbouring labels; it
is trained by gradient ascent on the likelihood of labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, table, unused

#: Labelled pages that the field is trained on by default.
TRAINING_PAGES = 900

# Elements by their role in HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title head-only textarea noscript template svg iframe canvas math noframes xmp".split())
#: Drawings and formulas, which end at the first of these tags if nothing ends them before.
FOREIGN_TAGS = frozenset(("svg", "math"))
LEAVES_FOREIGN = "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
#: Tags that may stand in a head; any other one, or text, ends it.
HEAD_TAGS = frozenset("html head title meta link base basefont bgsound style script noscript noframes template head-only".split())
CLOSES_P = BLOCK_TAGS - frozenset("body html button label".split())
SELF_NESTING = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "td": "tr table", "th": "tr table", "tr": "table tbody thead tfoot", "option": "select"}

# Words in class, id and role attributes that tell what an element is for.
PURPOSES = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs topbar toolbar submenu links sitemap",
    "head": "header masthead branding logo banner topbar hero",
    "foot": "footer foot copyright colophon legal imprint contentinfo bottom",
    "side": "sidebar aside side rail complementary widget widgets related recommended recommendations popular trending more teaser also",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense banner",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay privacy disclaimer announcement paywall message",
    "form": "form search signup subscribe subscription newsletter login register contact input",
    "comment": "comment comments reply replies respond discussion disqus feedback thread responses",
    "share": "share sharing social follow tweet facebook",
    "main": "article content main post entry story body text page maincontent articlebody postbody entrycontent prose",
}
PURPOSE_OF = {w: p for p, ws in PURPOSES.items() for w in ws.split()}
# Words that page furniture in several languages holds.
TELLING = {
    "legal": "copyright © rights reserved imprint impressum datenschutz privacy terms mentions légales aviso",
    "cookie": "cookie cookies consent",
    "call": "subscribe newsletter login register advertisement sponsored share follow reply werbung anzeige publicité publicidad abonnieren",
}
#: What elements are for by their tag alone.
TAG_PURPOSES = {"nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form", "dialog": "notice", "main": "main", "article": "main"}
#: Tags of single texts; their blocks belong to the box around them.
TEXT_TAGS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr tbody thead tfoot caption legend summary button label option pre blockquote figcaption".split())
TELLING_OF = {w: p for p, ws in TELLING.items() for w in ws.split()}

_NAME_AT = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"[>\"']")
#: A raw element's end tag has white space, a slash or its end behind its name, whatever follows.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
_FOREIGN_END = {t: re.compile(rf"</{t}(?=[\s/>])|<(?={'|'.join(LEAVES_FOREIGN)})(?:{'|'.join(LEAVES_FOREIGN)})(?=[\s/>])", re.I) for t in FOREIGN_TAGS}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """A leaf block: its text, its ancestors' tags and purposes, how much of it is link text, what the nearest ancestor with a purpose is for, and the box that it stands in."""

    __slots__ = ("text", "path", "linked", "tag", "near", "box")

    def __init__(self, text: str, path: tuple, linked: int, tag: str, near: str = "", box: int = 0):
        self.text, self.path, self.linked, self.tag, self.near, self.box = text, path, linked, tag, near, box


def tokens_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) along the page: 'text', 'open', 'close' or 'raw' (a raw element, swallowed whole). A CDATA section is a comment up to its first '>', as HTML has none.

    Reads each character once or twice, whatever the page is: what was looked for in vain is not looked for again. A quote counts inside a tag behind an
    equals sign, as in browsers; a tag without an end, and one in whose quotes the page would end, is cut at its first '>', or else text.
    """
    n, at, start = len(page), 0, 0
    gone: set[str] = set()  # what does not come any more

    def find(what: str, begin: int) -> int:
        if what in gone:
            return -1
        place = page.find(what, begin)
        if place < 0:
            gone.add(what)
        return place

    def tag_end(begin: int) -> int:
        """Where the tag's '>' is, -1 if nowhere."""
        here = begin
        while m := _TAG_STOP.search(page, here) if ">" not in gone else None:
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while before >= begin and page[before].isspace():
                before -= 1
            if before >= begin and page[before] == "=":
                close = find(m[0], m.end())
                if close < 0:
                    return find(">", begin)
                here = close + 1
            else:
                here = m.end()
        gone.add(">")
        return -1

    def raw_end(tag: str, begin: int) -> int:
        """Where a raw element ends: behind its end tag, at the tag that leaves a drawing, or with the page."""
        if f"/{tag}" in gone:
            return n
        m = (_FOREIGN_END if tag in FOREIGN_TAGS else _RAW_END)[tag].search(page, begin)
        if m is None:
            gone.add(f"/{tag}")
            return n
        if m[0][1] != "/":
            return m.start()
        stop = tag_end(m.end())
        return stop + 1 if stop >= 0 else n

    while (lt := page.find("<", at)) >= 0:
        follow = page[lt + 1 : lt + 2]
        closing = follow == "/"
        name = _NAME_AT.match(page, lt + 1 + closing) if closing or follow.isalpha() else None
        end, out = -1, None
        if name:
            stop = tag_end(name.end())
            if stop >= 0:
                tag, attributes, end = name[0].lower(), page[name.end() : stop], stop + 1
                if tag in RAW_TAGS and not closing:
                    if not (tag in FOREIGN_TAGS and attributes.endswith("/")):
                        end = raw_end(tag, end)
                    out = ("raw", tag, "")
                else:
                    out = ("close" if closing else "open", tag, attributes)
        elif page.startswith("<!--", lt):
            stop = find("-->", lt + 4)
            end, out = (stop + 3 if stop >= 0 else n), ("comment", "", "")
        elif follow in ("!", "?") and (stop := find(">", lt + 2)) >= 0:
            end, out = stop + 1, ("comment", "", "")
        if out is None:
            at = lt + 1
            continue
        if lt > start:
            yield "text", page[start:lt], ""
        if out[0] != "comment":
            yield out
        at = start = end
    if start < n:
        yield "text", page[start:], ""


_purposes: dict[str, tuple[tuple[str, ...], str]] = {}


def _element_features(tag: str, attributes: str) -> tuple[tuple[str, ...], str]:
    """(features that an ancestor gives its blocks, what it is for): its tag, and purposes of the words of its attributes. A comment's body is no main text: any other purpose goes before it."""
    key = f"{tag} {attributes}"
    known = _purposes.get(key)
    if known is None:
        out = [f"in={tag}"] if tag in BLOCK_TAGS else []
        purposes = [TAG_PURPOSES[tag]] if tag in TAG_PURPOSES else []
        named: list[str] = []
        for name, value in _ATTR.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                out.append("hidden")
            elif name in ("class", "id", "role"):
                for word in _NAME.findall(value):
                    if (purpose := PURPOSE_OF.get(word.lower())) is not None:
                        named.append(purpose)
        if any(p != "main" for p in named):
            named = [p for p in named if p != "main"]
        out += [f"for={p}" for p in named]
        purposes += named
        if len(_purposes) > 50_000:
            _purposes.clear()
        known = _purposes[key] = tuple(dict.fromkeys(out)), purposes[-1] if purposes else ""
    return known


class _Open:
    """An open element: its tag, the nearest block tag, features of all open elements, and the nearest element below that nesting rules ask for."""

    __slots__ = ("tag", "block", "path", "rule", "near", "box")

    def __init__(self, tag: str, block: str, path: tuple, rule: int, near: str, box: int):
        self.tag, self.block, self.path, self.rule, self.near, self.box = tag, block, path, rule, near, box


_NOTHING = _Open("", "", (), -1, "", 0)
_RULED = frozenset(SELF_NESTING) | frozenset(t for scope in SELF_NESTING.values() for t in scope.split())
#: Tags that end an open element of the same kind.
_LIKE = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of the whole page in order. Character references are decoded, white space is one space."""
    out: list[Block] = []
    stack: list[_Open] = []
    count: Counter[str] = Counter()
    text: list[str] = []
    linked, in_head, boxes = 0, False, 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join(htmllib.unescape("".join(text)).split())
        if joined:
            top = stack[-1] if stack else _NOTHING
            out.append(Block(joined, top.path, linked, top.block, top.near, top.box))
        text.clear()
        linked = 0

    def close_from(place: int) -> None:
        for x in stack[place:]:
            count[x.tag] -= 1
        del stack[place:]

    for kind, value, attributes in tokens_of(page or ""):
        if kind == "text":
            in_head = in_head and not value.strip()
            if not in_head:
                text.append(value)
                if count["a"]:
                    linked += len(value)
            continue
        if kind == "raw":
            in_head = in_head and value in HEAD_TAGS
            continue
        tag, closing = value, kind == "close"
        if tag == "head":
            in_head = not closing
            continue
        if tag not in HEAD_TAGS and (not closing or tag in ("body", "br")):
            in_head = False
        if tag == "br":
            text.append(" ")
            continue
        if in_head:
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if count[tag]:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close_from(place)
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P and stack and stack[-1].block == "p":
                place = len(stack) - 1
                while stack[place].tag != "p":
                    place -= 1
                close_from(place)
            if tag in SELF_NESTING:
                scope, like = SELF_NESTING[tag].split(), _LIKE.get(tag, (tag,))
                place = (len(stack) - 1 if stack[-1].tag in _RULED else stack[-1].rule) if stack and any(count[t] for t in like) else -1
                while place >= 0 and stack[place].tag not in scope:
                    if stack[place].tag in like:
                        close_from(place)
                        break
                    place = stack[place].rule
        if tag in VOID_TAGS:
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCK_TAGS or tag == "a":
            below = stack[-1] if stack else _NOTHING
            own, purpose = _element_features(tag, attributes)
            path = below.path if all(f in below.path for f in own) else tuple(dict.fromkeys((*below.path, *own)))
            rule = len(stack) - 1 if below.tag in _RULED else below.rule
            block = tag in BLOCK_TAGS
            boxes += block and tag not in TEXT_TAGS
            stack.append(_Open(tag, tag if block else below.block, path, rule, purpose or below.near, boxes if block and tag not in TEXT_TAGS else below.box))
            count[tag] += 1
    flush()
    return out


def features(block: Block, position: float, box: tuple[int, int, int] = (0, 0, 0)) -> list[str]:
    """Feature names of a block; box has the characters, linked characters and blocks of the box that it stands in."""
    words = block.text.split()
    n = len(words)
    share = block.linked / max(1, len(block.text))
    out = [*block.path, f"tag={block.tag}", f"near={block.near}", f"len={min(6, n.bit_length())}", f"links={min(4, int(share * 4.99))}", f"end={block.text[-1] in '.!?…:;»”'}", f"at={int(position * 4.99)}", "bias"]
    size, linked, blocks = box
    out += [f"box={min(6, (size // 32).bit_length())}", f"boxlinks={min(4, int(4.99 * linked / max(1, size)))}", f"boxed={min(3, blocks.bit_length())}"]
    said = Counter(TELLING_OF[w] for x in words if (w := x.lower().strip(".,:;!()")) in TELLING_OF)
    # a word tells more of a short block
    return out + [f"says={p},{min(3, int(8 * k / n))}" for p, k in said.items()]


class Field:
    """A linear-chain field with two labels; weights hold the score of label 1 (main) over label 0 for each feature."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """The most likely labels (Viterbi); equal scores go to label 0."""
        get, (m0, m1) = self.weights.get, self.moves
        back, s0, s1 = [], 0.0, 0.0
        for k, fs in enumerate(rows):
            e = sum([get(f, 0.0) for f in fs])
            if k:
                from0, from1 = s0 + m0[1] < s1 + m1[1], s0 + m0[0] < s1 + m1[0]
                s0, s1 = (s1 + m1[0] if from1 else s0 + m0[0]), (s1 + m1[1] if from0 else s0 + m0[1]) + e
                back.append((from1, from0))
            else:
                s1 = e
        label, out = s1 > s0, []
        for b in [*reversed(back), None]:
            out.append(bool(label))
            if b is not None:
                label = b[int(label)]
        return out[: len(rows)][::-1]


class Chains:
    """Pages as one array of labelled chains, for the likelihood of all at once, place by place."""

    def __init__(self, pages: list[tuple[list[list[str]], list[bool]]]):
        pages = [p for p in pages if p[0]]
        names: dict[str, int] = {}
        self.n, self.longest = len(pages), max((len(p[0]) for p in pages), default=0)
        rows, cols = [], []
        self.gold, self.real = np.zeros((self.n, self.longest), dtype=np.int64), np.zeros((self.n, self.longest), dtype=bool)
        for i, (fs, labels) in enumerate(pages):
            self.real[i, : len(fs)] = True
            self.gold[i, : len(fs)] = labels
            for t, f in enumerate(fs):
                for x in f:
                    rows.append(i * self.longest + t)
                    cols.append(names.setdefault(x, len(names)))
        self.rows, self.cols, self.names, self.size = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), list(names), len(names) + 4
        self.pairs = self.real[:, 1:]
        self.gold_moves = np.array([[(self.pairs & (self.gold[:, :-1] == a) & (self.gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])

    def likelihood(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean log-likelihood of the labels and its gradient: forward and backward sums. The last four weights are those of neighbouring labels."""
        n, longest, real, gold = self.n, self.longest, self.real, self.gold
        e = np.bincount(self.rows, weights=w[self.cols], minlength=n * longest).reshape(n, longest)
        emit = np.stack([np.zeros_like(e), e], axis=2)
        moves = w[-4:].reshape(2, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = (emit[:, t + 1] + behind[:, t + 1])[:, None, :] + moves
            behind[:, t] = np.where(real[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p1 = np.where(real, np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]), 0.0)
        both = np.exp(np.clip(ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None], -60, 0)) * self.pairs[:, :, None, None]
        slope = np.empty(self.size)
        slope[:-4] = np.bincount(self.cols, weights=(np.where(real, gold, 0) - p1).reshape(-1)[self.rows], minlength=self.size - 4)
        slope[-4:] = (self.gold_moves - both.sum(axis=(0, 1))).reshape(-1)
        value = (e * gold * real).sum() + (self.gold_moves * moves).sum() - total.sum()
        return float(value) / n, slope / n


def train(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 200, rate: float = 0.15, penalty: float = 1e-3) -> Field:
    """Fit a field to (features of blocks, labels) of pages: Adam on the mean log-likelihood less an L2 penalty."""
    chains = Chains(pages)
    if not chains.n:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    w, m, v = np.zeros(chains.size), np.zeros(chains.size), np.zeros(chains.size)
    for step in range(1, rounds + 1):
        slope = chains.likelihood(w)[1] - penalty * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({x: float(w[k]) for k, x in enumerate(chains.names)}, w[-4:].reshape(2, 2).tolist())


def labelled(pages: list[tuple[str, list[bool]]]) -> list[tuple[list[list[str]], list[bool]]]:
    """Training rows from pages with a label for each of their blocks."""
    out = []
    for page, labels in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        out.append((page_features(blocks), labels))
    return out


def page_features(blocks: list[Block]) -> list[list[str]]:
    boxes: dict[int, list[int]] = {}
    for b in blocks:
        box = boxes.setdefault(b.box, [0, 0, 0])
        box[0] += len(b.text)
        box[1] += min(b.linked, len(b.text))
        box[2] += 1
    return [features(b, k / len(blocks), tuple(boxes[b.box])) for k, b in enumerate(blocks)]


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, keep in zip(blocks, field.decode(page_features(blocks)), strict=True) if keep)


def extract(pages: DataFrame, field: Field, html: str = "html") -> DataFrame:
    """pages with text (the main text) and n_chars (its code points) in place of columns of those names.

    A null, empty or blank page, and one without main blocks, has an empty text. Pages are read
    whole; unclosed tags, comments and raw elements are read as browsers do, as far as blocks go.
    Repeated rows give repeated results. A map over partitions: no shuffle.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batch: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batch:
            yield pd.Series([main_text(x, field) for x in s])

    made = unused(pages, "text")["text"]
    out = pages.withColumn(made, run(F.col(f"`{html}`")))
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    return out.select(*columns, F.col(made).alias("text"), F.length(made).cast("bigint").alias("n_chars"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.labelled_pages import training_pages

    field = train(labelled(training_pages(TRAINING_PAGES)))
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), field).select("page_id", "url", "text", "n_chars")
