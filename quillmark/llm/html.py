"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page's tags are scanned once; text between block tags is a leaf block, with the
tags and names of the elements around it. A chain of two labels (main, other) runs
over the blocks. Its weights are fitted, by the gradient of the likelihood, on pages
written by a small grammar of layouts whose main blocks are known; Viterbi decoding
then labels whole pages.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_UNQUOTED = re.compile(r"""[^'">]*""")
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LETTERS = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_RAW = frozenset("script style template textarea title iframe noframes xmp".split())
#: Elements that may hold others of their kind, and none of whose text is the page's; a block element ends them.
_HIDDEN = frozenset("svg math select".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "thead", "tbody", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",))}
#: Elements that may stand in a head; any other start tag, or text, ends it.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_CUES = re.compile(r"©|copyright|rights reserved|cookie|subscribe|newsletter|sign in|log in|register|share this|advert|sponsored|comment|reply|related|read more|privacy|terms of|menu|search", re.I)


class Place:
    """An open element: its tag, and the tags and names of it and all elements around it."""

    def __init__(self, tag: str, words: tuple[str, ...], around: "Place | None"):
        self.tag = tag
        tags, names = (around.tags, around.names) if around else (frozenset(), frozenset())
        self.tags = tags if tag in tags else tags | {tag}
        self.names = names if names.issuperset(words) else names | set(words)


@dataclass
class Block:
    text: str
    place: Place | None
    linked: float
    features: list[str] = field(default_factory=list)


class _Scanner:
    """Tags of a page in order, in one pass: no part is searched twice, however many tags stay open."""

    def __init__(self, page: str):
        self.page, self.lenient = page, False
        self.last = {c: page.rfind(c) for c in "'\">"}

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends, after its ``>``; -1 if it never does.

        A ``>`` in quotes does not count. Once that leads past the page's end, the
        rest of its tags end at their first ``>``.
        """
        start = at
        while not self.lenient and at <= self.last[">"]:
            at = _UNQUOTED.match(self.page, at).end()
            if at >= len(self.page):
                break
            if self.page[at] == ">":
                return at + 1
            if at >= self.last[self.page[at]]:
                break
            at = self.page.find(self.page[at], at + 1) + 1
        if self.last[">"] < start:
            return -1
        self.lenient = True
        return self.page.find(">", start) + 1


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order: text with references decoded and white space made single."""
    out: list[Block] = []
    stack: list[Place] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    raw_ends: dict[str, bool] = {}
    places: dict[tuple, Place] = {}  # siblings of the same tag and names share a place
    plain = link = at = 0
    inside_link = False
    scan = _Scanner(page)

    def flush() -> None:
        nonlocal plain, link
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(whole, stack[-1] if stack else None, link / max(1, plain)))
            text.clear()
        plain = link = 0

    def shut(names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        if any(opened[x] for x in names):
            for x in _shut(stack, names, within):
                opened[x.tag] -= 1

    def push(name: str, words: tuple[str, ...]) -> None:
        around = stack[-1] if stack else None
        key = (id(around), name, words)
        if key not in places:
            places[key] = Place(name, words, around)
        stack.append(places[key])
        opened[name] += 1

    def hidden() -> bool:
        return any(opened[x] for x in _HIDDEN)

    def add(raw: str) -> None:
        nonlocal plain, link
        if raw and not hidden():
            raw = html.unescape(raw) if "&" in raw else raw
            if stack and stack[-1].tag == "head" and raw.strip():
                shut(("head",))
            text.append(raw)
            n = len(raw)
            plain += n
            link += n if inside_link else 0

    n = len(page)
    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m.group(2) is None:
            comment = m.group().endswith("--")
            end = page.find("-->" if comment else ">", m.end() - 2 * comment)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        end = scan.end(m.end())
        if end < 0:  # no tag ends any more
            add(page[m.start() :])
            break
        at, rest = end, page[m.end() : end - 1]
        name, closing = m.group(2).lower(), bool(m.group(1))
        if not closing and name not in _HEAD:
            shut(("head",))
        if name in _RAW and not closing:
            if not rest.endswith("/"):
                found = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at) if raw_ends.get(name, True) else None
                raw_ends[name] = found is not None
                at = found.end() if found else n
            if not hidden():
                flush()
            continue
        if name in _HIDDEN or hidden():
            if closing and opened[name] and name in _HIDDEN:
                shut((name,))
            elif not closing and name in _HIDDEN and not rest.endswith("/"):
                push(name, ())
            if name not in _CLOSES_P or closing:
                continue
            while hidden():
                shut(tuple(_HIDDEN))
        if name in _INLINE:
            if name == "br":
                add(" ")
            elif name == "a":
                inside_link = not closing
            continue
        flush()
        inside_link = False
        if closing:
            shut((name,))
            continue
        if name in _CLOSES_P:
            shut(("p",), ("article", "aside", "div", "section", "td", "th", "li", "button", "object"))
        elif name in _SIBLINGS:
            same, within = _SIBLINGS[name]
            shut(tuple(same.split()), within)
        if name not in _VOID and not rest.endswith("/"):
            words = tuple(w for found in _NAMED.findall(rest) for w in _LETTERS.findall("".join(found).lower())) if "=" in rest else ()
            push(name, words)
    while hidden():
        shut(tuple(_HIDDEN))
    flush()
    return [b for b in out if b.place is None or "head" not in b.place.tags]


def _shut(stack: list[Place], names: tuple[str, ...], within: tuple[str, ...]) -> list[Place]:
    """Close the innermost open element of ``names``, and what is open in it, unless one of ``within`` is."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in names:
            closed = stack[i:]
            del stack[i:]
            return closed
        if stack[i].tag in within:
            break
    return []


def describe(blocks: list[Block]) -> list[list[str]]:
    """Each block's features: tags and names of its ancestors, and marks of its text."""
    out, before = [], None
    for b in blocks:
        found = ["bias"]
        tags = b.place.tags - {"html", "body"} if b.place else frozenset()
        found += [f"in {t}" for t in tags]
        found.append(f"parent {b.place.tag if b.place else '-'}")
        found += [f"name {w}" for w in (b.place.names if b.place else ())]
        if not tags & {"article", "main"}:
            found.append("loose")
        size = b.text.count(" ") + 1
        found.append("words 1" if size < 3 else "words 2" if size < 8 else "words 3" if size < 25 else "words 4")
        if b.linked > 0.5:
            found.append("linked")
        if b.text[-1] in ".!?":
            found.append("stop")
        found += {f"cue {c.lower()}" for c in _CUES.findall(b.text)} if size < 40 else set()
        if out and before is b.place:
            found.append("same place")
        before = b.place
        out.append(found)
    return out


class Field:
    """The chain's weights: ``gain`` of each feature for main over other, and of starting and moving (other 0, main 1)."""

    def __init__(self, gain: dict[str, float], start: list[float], move: list[list[float]]):
        self.gain, self.start, self.move = gain, start, move

    def viterbi(self, described: list[list[str]]) -> list[bool]:
        """The likeliest labels; of equals, other."""
        if not described:
            return []
        gain, ((oo, om), (mo, mm)) = self.gain, self.move
        back = []
        other = main = 0.0
        for i, found in enumerate(described):
            e = 0.0
            for f in found:
                e += gain.get(f, 0.0)
            if i == 0:
                other, main = self.start[0], self.start[1] + e
                continue
            from_main = mo + main > oo + other, mm + main > om + other
            back.append(from_main)
            other, main = max(oo + other, mo + main), max(om + other, mm + main) + e
        labels = [main > other]
        for from_main in reversed(back):
            labels.append(from_main[labels[-1]])
        return labels[::-1]


def fitted(pages: list[tuple[list[list[str]], list[bool]]], epochs: int = 60, rate: float = 0.4, decay: float = 0.002) -> Field:
    """Weights that maximise the pages' conditional likelihood, by batch gradient steps of per-weight size."""
    names = sorted({f for described, _ in pages for found in described for f in found})
    number = {f: i for i, f in enumerate(names)}
    n = len(names)
    chains = [([np.array([number[f] for f in found]) for found in described], np.array(labels, int)) for described, labels in pages if described]
    w = np.zeros(n + 6)  # features, start of both, moves
    past = np.full(n + 6, 1e-8)
    for _ in range(epochs):
        grad = -decay * len(chains) * w
        for found, labels in chains:
            size = len(labels)
            score = np.zeros((size, 2))
            score[:, 1] = [w[f].sum() for f in found]
            score[0] += w[n : n + 2]
            move = w[n + 2 :].reshape(2, 2)
            ahead, back = np.empty((size, 2)), np.zeros((size, 2))
            ahead[0] = score[0]
            for i in range(1, size):
                ahead[i] = score[i] + np.logaddexp(ahead[i - 1, 0] + move[0], ahead[i - 1, 1] + move[1])
            for i in range(size - 2, -1, -1):
                later = score[i + 1] + back[i + 1]
                back[i] = np.logaddexp(move[:, 0] + later[0], move[:, 1] + later[1])
            total = np.logaddexp(*ahead[-1])
            chance = np.exp(ahead + back - total)
            for i, f in enumerate(found):
                grad[f] += labels[i] - chance[i, 1]
            grad[n : n + 2] += np.eye(2)[labels[0]] - chance[0]
            for i in range(1, size):
                pair = np.exp(ahead[i - 1][:, None] + move + (score[i] + back[i])[None, :] - total)
                pair[labels[i - 1], labels[i]] -= 1
                grad[n + 2 :] -= pair.ravel()
        past += grad * grad
        w += rate * grad / np.sqrt(past)
    return Field({f: float(w[i]) for f, i in number.items()}, w[n : n + 2].tolist(), w[n + 2 :].reshape(2, 2).tolist())


def labelled_pages(n: int = 160, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of varied layouts with the label of each leaf block, from a seeded grammar."""
    rng = random.Random(seed)
    syllables = "ba den ko li mar no pre sta ti ur vel wen os er an".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 1, hi: int = 30) -> str:
        return words(lo, hi).capitalize() + rng.choice([".", ".", ".", "!", "", "?"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k))

    def noise(tag: str, names: list[str], cue: str = "") -> tuple[str, int]:
        inner, count = rng.choice([(f"<ul>{links(3)}</ul>", 3), (f"{cue} {sentence()}", 1), (f"<p>{sentence()}</p><p>{cue} {sentence(1, 8)}</p>", 2), (f"<h3>{cue} {words(1, 3)}</h3><ul>{links(2)}</ul>", 3)])
        name = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if names and rng.random() < 0.85 else ""
        if tag == "div" and not name:
            name = f' class="{names[0]}"'
        return f"<{tag}{name}>{inner}</{tag}>", count

    kinds = {
        "menu": ("nav", ["menu", "nav", "navbar", "main-nav"], ""), "menus": ("div", ["menu", "navigation", "nav", "breadcrumb", "toolbar"], ""), "top": ("header", ["site-header", "top", "masthead"], ""),
        "head": ("div", ["header", "masthead", "topbar", "banner"], ""), "foot": ("footer", ["footer", "site-footer", "bottom"], "©"), "feet": ("div", ["footer", "bottom", "copyright"], "© All rights reserved"),
        "aside": ("aside", ["sidebar", "related", "widget"], "Related"), "side": ("div", ["sidebar", "side", "widget", "related", "trending", "recommended"], "Read more"),
        "ad": ("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], "Sponsored"), "plain ad": ("div", ["ad", "ad", "promo"], ""), "notice": ("div", ["cookie", "notice", "consent", "cookie-notice", "alert", "popup"], "This site uses cookies"),
        "form": ("form", ["search", "login", "newsletter-form"], "Subscribe"), "letter": ("div", ["newsletter", "subscribe", "signup", "login"], "Sign in"), "share": ("div", ["share", "social", "share-buttons"], "Share this"),
        "comments": ("section", ["comments", "responses", "discussion"], "Reply"), "comment": ("div", ["comment", "comments", "comment-list", "disqus", "replies"], "Comment"),
    }

    def body() -> tuple[str, list[bool]]:
        parts, labels = [], []
        if rng.random() < 0.85:
            parts.append(rng.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h1><a href='#'>{}</a></h1>", "<h1>{}</h1>"]).format(sentence(1, 12)))
            labels.append(True)
        for _ in range(rng.randint(1, 9)):
            shape = rng.random()
            if shape < 0.62:
                parts.append(f"<p>{sentence(1, 60)}</p>")
            elif shape < 0.7:
                parts.append(f"<p><b>{sentence()}<br>")  # never closed
            elif shape < 0.76:
                parts.append(f"<h2>{words(1, 5)}</h2>")
            elif shape < 0.82:
                parts.append(f"<blockquote>{sentence()}</blockquote>")
            elif shape < 0.9:
                k = rng.randint(1, 3)
                parts.append("<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(k)) + "</ul>")
                labels += [True] * (k - 1)
            elif shape < 0.95:
                parts.append(f"<p><a href='/x'>{words(1, 4)}</a> {sentence()}</p>")
            else:
                parts.append(f"<pre>{words(2, 9)}</pre>")
            labels.append(True)
            if rng.random() < 0.08:
                tag, names, cue = kinds[rng.choice(["ad", "plain ad", "aside", "share", "letter", "form", "comment", "notice", "side"])]
                piece, count = noise(tag, names, cue)
                parts.append(piece)
                labels += [False] * count
        return "".join(parts), labels

    out = []
    for _ in range(n):
        before = rng.sample(["menu", "menus", "top", "head", "ad", "plain ad", "notice", "form", "share", "side", "aside"], rng.randint(0, 4))
        after = rng.sample(["foot", "feet", "aside", "side", "ad", "plain ad", "comments", "comment", "letter", "form", "share", "notice"], rng.randint(0, 5))
        parts, labels = ["<html><head><title>x</title></head><body>"], []
        for kind in before:
            piece, count = noise(*kinds[kind])
            parts.append(piece)
            labels += [False] * count
        inner, own = body()
        names = rng.choice(["content", "post", "entry", "story", "article-body", "text", "main"])
        wrap = rng.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", f'<div class="{names}">{{}}</div>', f'<div id="{names}">{{}}</div>', "<section>{}</section>", "{}"])
        parts.append(wrap.format(inner))
        labels += own
        for kind in after:
            piece, count = noise(*kinds[kind])
            parts.append(piece)
            labels += [False] * count
        out.append(("".join([*parts, "</body></html>"]), labels))
    return out


def trained(pages: list[tuple[str, list[bool]]] | None = None) -> Field:
    """A field fitted on labelled pages: (html, label of each leaf block)."""
    chains = []
    for page, labels in pages if pages is not None else labelled_pages():
        described = describe(blocks_of(page))
        if len(described) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(described)} blocks: {page[:200]}")
        chains.append((described, labels))
    return fitted(chains)


def main_blocks(page: str | None, model: Field) -> list[str]:
    """The texts of the blocks that the field calls main, in page order; none for null or empty."""
    blocks = blocks_of(page or "")
    return [b.text for b, main in zip(blocks, model.viterbi(describe(blocks)), strict=True) if main]


def extracted(pages: DataFrame, model: Field, text: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html, blocks joined by one newline.

    A null or empty page, or one without main blocks, gives an empty text. Pages
    are read whole and repeated rows alike; other columns pass through, and one
    called ``name`` is replaced.
    """
    kept = [f for f in pages.schema.fields if f.name not in (text, name)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` string"])
    sent = pages.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n".join(main_blocks(x.as_py(), sent.value)) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*(f.name for f in kept), name])

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__html")).mapInArrow(run, schema)
