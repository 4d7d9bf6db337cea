"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A tolerant tokenizer cuts a page into leaf blocks: runs of text between the tags of block elements, each
with its open ancestors. The field labels every block as main text or not from ancestor tags (with
their class, id and role words), text features and their neighbours' labels; it is trained by
maximum likelihood on labelled pages, which labelled_pages() makes, and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import id_type, map_batches

#: Elements whose tags end a block; void ones among them leave nothing open (fixed values of the HTML standard).
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li "
    "main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; that of the first ones is no text either (fixed values).
UNSEEN, RAW = frozenset("script style template".split()), frozenset("script style title textarea".split())
#: A start tag of one of these ends an open p; li, dt, dd, tr, td, th and option end their like (fixed values).
ENDS_P = BLOCKS - frozenset("button caption dd dt html body head td th tr tbody thead tfoot li option legend summary iframe select title".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS_LIKE = frozenset("ul ol menu dl table select".split())
#: Tags, comments and other markup as the tokenizer of the HTML standard reads them: a quote opens a value only after "=", elsewhere it is
#: part of a name. A tag that the page's end cuts off is no tag and no text.
ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+)?+)*+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:([a-zA-Z][^\s/>]*+){ATTRIBUTES}(?:>|\Z)|[^a-zA-Z>][^>]*+(?:>|\Z)|>)|<([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>][^\s>]*+))""")
WORD = re.compile(r"[a-z]+")
#: Labelled pages to train on, passes over them, step and ridge.
PAGES, EPOCHS, RATE, RIDGE, SEED = 800, 10, 0.2, 1e-3, 7


LENGTHS, LINKS = [f"length:{k}" for k in range(10)], [f"links:{k}" for k in range(5)]
NO_WORDS: frozenset[str] = frozenset()


@dataclass
class Block:
    tags: tuple[str, ...]  # open elements, outermost first; of more than three each kind once and then the innermost three
    words: frozenset[str]  # of the attributes of all open elements
    text: str
    linked: int  # characters inside links


class Open:
    """An open element. What its blocks are told by is shared with its parent where it adds nothing, so that deep pages take no more room than shallow ones."""

    __slots__ = ("tag", "kinds", "depth", "inner", "words", "tags")

    def __init__(self, tag: str, words: frozenset[str], above: Open | None):
        self.tag = tag
        kinds, inner, seen, self.depth = (above.kinds, above.inner, above.words, above.depth) if above else ((), (), NO_WORDS, 0)
        self.words = seen if words <= seen else seen | words
        if tag not in BLOCKS:
            self.kinds, self.inner, self.tags = kinds, inner, above.tags if above else ()
            return
        self.kinds = kinds if tag in kinds else (*kinds, tag)
        self.inner = (*inner[-2:], tag)
        self.depth += 1
        self.tags = above.tags if self.depth > 4 and self.kinds is kinds and self.inner == inner else self.kinds + self.inner if self.depth > 3 else self.inner


def _attributes(rest: str) -> frozenset[str]:
    if "=" not in rest:
        return NO_WORDS
    found = set()
    for m in ATTRIBUTE.finditer(rest):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label"):
            found.update(WORD.findall((m[2] or m[3] or m[4] or "").lower()))
    return frozenset(found)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order. White space is normalised, character references are decoded, unseen elements and blank blocks left out.

    Unclosed and misnested tags never fail: an end tag closes up to its match, or is passed over. A page takes time
    in proportion to its length, however deep its elements lie.
    """
    page = page or ""
    stack: list[Open] = []
    count: dict[str, int] = {}
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                links = sum(len(" ".join(html.unescape(p).split())) for p, link in parts if link)
                top = stack[-1] if stack else None
                out.append(Block(top.tags if top else (), top.words if top else NO_WORDS, text, min(links, len(text))))
            parts.clear()

    def open_one(tag: str, words: frozenset[str] = NO_WORDS) -> None:
        stack.append(Open(tag, words, stack[-1] if stack else None))
        count[tag] = count.get(tag, 0) + 1

    def close(depth: int) -> None:
        for e in stack[depth:]:
            count[e.tag] -= 1
        del stack[depth:]

    def innermost(tags: frozenset[str] | set[str], stop: frozenset[str]) -> int:
        """The depth of the innermost open element of these, unless one to stop at lies further in; else -1."""
        if any(count.get(t) for t in tags):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag in tags:
                    return depth
                if stack[depth].tag in stop:
                    break
        return -1

    while at < n:
        mark = page.find("<", at)
        m = TOKEN.match(page, mark) if mark >= 0 else None
        end = n if mark < 0 else mark if m else mark + 1
        unseen = any(count.get(t) for t in UNSEEN)
        if end > at and not unseen:
            parts.append((page[at:end], count.get("a", 0) > 0))
        if not m:
            at = end
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append((" ", False))
            # An inline end tag does not close blocks.
            depth = innermost({tag}, NO_WORDS if tag in BLOCKS else BLOCKS)
            if depth >= 0:
                if tag not in BLOCKS and any(e.tag in BLOCKS for e in stack[depth + 1 :]):
                    flush()
                close(depth)
        elif m[2]:
            tag = m[2].lower()
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append((" ", False))
            if tag in ENDS_P and (depth := innermost({"p"}, BLOCKS)) >= 0:
                close(depth)
            if tag in LIKE and (depth := innermost(LIKE[tag], HOLDS_LIKE)) >= 0:
                close(depth)
            if tag in VOID or m[0].endswith("/>") and tag not in BLOCKS:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z){ATTRIBUTES}(?:>|\Z)", re.I).search(page, at)
                inside, at = page[at : stop.start() if stop else n], stop.end() if stop else n
                if tag in ("title", "textarea") and not unseen:
                    open_one(tag)
                    parts.append((inside, False))
                    flush()
                    close(len(stack) - 1)
                continue
            open_one(tag, _attributes(m[3]))
    flush()
    return out


def structure(tags: tuple[str, ...], words: frozenset[str]) -> list[str]:
    """Features of where a block stands."""
    names = [f"own:{tags[-1] if tags else ''}"] + [f"pair:{a}>{c}" for a, c in zip(tags[-3:], tags[-2:])]
    return names + [f"in:{t}" for t in dict.fromkeys(tags)] + [f"word:{w}" for w in words]


def surface(found: list[Block], k: int) -> list[str]:
    """Features of a block's text and place."""
    b = found[k]
    names = ["bias", LENGTHS[min(len(b.text).bit_length(), 9)], LINKS[b.linked * 4 // len(b.text)], "ends" if b.text[-1] in ".!?:;\"')»”" else "open"]
    if "©" in b.text:
        names.append("mark:copyright")
    if k == 0:
        names.append("first")
    if k == len(found) - 1:
        names.append("last")
    return names


def features(found: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    return [structure(b.tags, b.words) + surface(found, k) for k, b in enumerate(found)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float], tuple[float, float]]  # from label, to label
    known: dict = field(default_factory=dict, compare=False)  # sums for places already seen

    def _sum(self, names: list[str]) -> tuple[float, float]:
        got = [w for w in map(self.weights.get, names) if w]
        return sum(w[0] for w in got), sum(w[1] for w in got)

    def decode(self, found: list[Block]) -> list[int]:
        """The most probable labels (1: main text), by Viterbi."""
        if not found:
            return []
        (s00, s01), (s10, s11) = self.steps
        back, a, b = [], 0.0, 0.0
        for k, block in enumerate(found):
            where = block.tags, block.words
            if where not in self.known:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[where] = self._sum(structure(*where))
            (x, y), (u, v) = self.known[where], self._sum(surface(found, k))
            if k:
                from_0, from_1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
                back.append((from_0, from_1))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
            a, b = a + x + u, b + y + v
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _expected(scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and of label pairs, by the forward and backward recursions in logarithms."""
    n = len(scores)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0]
    for k in range(1, n):
        forward[k] = scores[k] + np.logaddexp.reduce(forward[k - 1][:, None] + steps, axis=0)
    for k in range(n - 2, -1, -1):
        backward[k] = np.logaddexp.reduce(steps + scores[k + 1] + backward[k + 1], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    pairs = np.exp(forward[:-1, :, None] + steps + (scores[1:] + backward[1:])[:, None, :] - total).sum(0) if n > 1 else np.zeros((2, 2))
    return np.exp(forward + backward - total), pairs


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS) -> Model:
    """Maximum likelihood by AdaGrad, page by page in a fixed order."""
    place: dict[str, int] = {}
    coded = [([np.array(sorted({place.setdefault(f, len(place)) for f in row})) for row in rows], np.array(labels)) for rows, labels in pages if rows]
    w, steps = np.zeros((len(place), 2)), np.zeros((2, 2))
    seen_w, seen_s = np.full(w.shape, 1e-6), np.full((2, 2), 1e-6)
    for epoch in range(epochs):
        order = list(range(len(coded)))
        random.Random(SEED + epoch).shuffle(order)
        for k in order:
            rows, labels = coded[k]
            flat, sizes = np.concatenate(rows), [len(r) for r in rows]
            scores = np.add.reduceat(w[flat], np.cumsum([0, *sizes[:-1]]), axis=0)
            gap, pairs = _expected(scores, steps)
            gap[np.arange(len(labels)), labels] -= 1
            slope = np.zeros_like(w)
            np.add.at(slope, flat, np.repeat(gap, sizes, axis=0))
            np.subtract.at(pairs, (labels[:-1], labels[1:]), 1)
            used = np.unique(flat)
            g = slope[used] + RIDGE * w[used]
            seen_w[used] += g**2
            w[used] -= RATE * g / np.sqrt(seen_w[used])
            seen_s += pairs**2
            steps -= RATE * pairs / np.sqrt(seen_s)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in place.items()}, tuple(map(tuple, steps.tolist())))


# Labelled pages

#: Names that templates of labelled pages give to their boxes: main text, and everything around it.
MAIN_NAMES = "content main article post entry story body text page-content post-content article-body entry-content story-body".split()
OTHER_NAMES = {
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion adsense".split(),
    "menu": "nav menu navbar navigation topbar breadcrumb breadcrumbs pagination tabs".split(),
    "side": "sidebar side widget related recommended popular trending newsletter tags share social subscribe".split(),
    "notice": "cookie cookies consent notice popup modal overlay gdpr alert".split(),
    "comments": "comment comments reply replies discussion respond disqus reader-comments".split(),
    "footer": "footer bottom copyright legal disclaimer credits".split(),
    "header": "header masthead top branding site-header logo".split(),
}


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages whose main-text blocks stand between U+E000 and U+E001, in many layouts: with and without sectioning elements, class names, comments, notices, adverts and forms."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkéöñçü"

    vocabulary = ["".join(r.choices(letters, k=r.choice((2, 3, 3, 4, 5, 6, 7, 9)))) for _ in range(3000)]

    def word() -> str:
        return vocabulary[int(r.random() * len(vocabulary))]

    def words(low: int, high: int) -> str:
        return " ".join(r.choices(vocabulary, k=r.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(3, 14).capitalize() + r.choice("....!?") for _ in range(r.randint(low, high)))

    def mine(text: str) -> str:
        return f"\ue000{text}\ue001"

    def links(low: int, high: int) -> str:
        item = lambda: f'<a href="/{word()}">{r.choice((word(), words(1, 3).capitalize()))}</a>'
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(low, high))) + "</ul>"
        return r.choice((" | ", " ", " &middot; ")).join(item() for _ in range(r.randint(low, high)))

    def prose() -> str:
        """A short text as boxes around the article hold it."""
        text = r.choice((sentences(1, 2), words(1, 8), sentences(1, 5), sentences(3, 9)))
        return r.choice((text, f"<p>{text}</p>", f"<p>{text}</p><p>{sentences(1, 6)}</p>", f"<h2>{words(1, 5)}</h2><p>{text}</p>"))

    def deeper(inside: str) -> str:
        """The same inside further boxes without a telling name."""
        for _ in range(r.choice((0, 0, 0, 1, 2, 3))):
            inside = r.choice((f"<div>{inside}</div>", f"<div>{inside}</div>", f'<div class="{r.choice(("row", "inner", "wrap", "container", "col", word()))}">{inside}</div>', f"<section>{inside}</section>"))
        return inside

    def box(kind: str, inside: str) -> str:
        inside = deeper(inside)
        tag = {"menu": ("nav", "div", "ul"), "side": ("aside", "div", "section"), "footer": ("footer", "div"), "header": ("header", "div"), "comments": ("section", "div", "ol")}.get(kind, ("div", "div", "section", "aside"))
        tag = r.choice(tag)
        plain = tag in ("nav", "aside", "footer", "header")
        if plain and r.random() < 0.5:
            return f"<{tag}>{inside}</{tag}>"
        name = r.choice(OTHER_NAMES[kind])
        name = r.choice((name, f"{name}-{word()[:4]}", f"{word()[:4]}-{name}", f"{name} {word()}"))
        return f'<{tag} {r.choice(("class", "class", "id"))}="{name}">{inside}</{tag}>'

    def comments() -> str:
        def each() -> str:
            tag, said = r.choice(("div", "li", "article")), r.choice((f"<p>{sentences(1, 4)}</p>", f"<p>{sentences(2, 9)}</p><p>{sentences(1, 5)}</p>", sentences(1, 6)))
            name = r.choice(('class="comment"', 'class="comment"', 'class="reply"', f'class="{word()}"', ""))
            return f"<{tag} {name}>" + r.choice(("", f"<h4>{word()}</h4>", f"<span>{words(1, 2)}</span>", f'<a href="/{word()}">{word()}</a> ')) + said + f"</{tag}>"

        plain = "".join(f"<p>{sentences(1, 6)}</p>" for _ in range(r.randint(1, 3)))
        return box("comments", r.choice(("", f"<h2>{words(1, 3)}</h2>", f"<h3>{words(1, 2)}</h3>")) + r.choice((plain, "".join(each() for _ in range(r.randint(1, 5))))))

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(1, 3)}</label><input name="q"><button>{word()}</button>{r.choice(("", f"<p>{words(3, 8)}</p>", f"<textarea>{words(1, 5)}</textarea>", f"<select><option>{word()}<option>{word()}</select>"))}</form>'

    def aside_box() -> str:
        kind = r.choice(("ad", "ad", "side", "notice"))
        return box(kind, r.choice((prose(), links(2, 6), f"<h3>{words(1, 4)}</h3>" + links(2, 5), f"<h4>{words(1, 3)}</h4><p>{sentences(1, 3)}</p>")))

    def paragraph() -> str:
        text = r.choice((sentences(1, 9), sentences(3, 9), sentences(1, 1), words(1, 3).capitalize() + ".", words(2, 9) + " | " + words(1, 5)))
        if r.random() < 0.2:
            text = text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if r.random() < 0.3:
            text = r.choice((f"<b>{text}</b>", f"<b>{text}", f"<em>{text}</em>", text.replace(". ", ".<br>", 1)))
        return text

    def article() -> str:
        out = []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p>{mine(paragraph())}" + r.choice(("</p>", "</p>", "</p>", "")))
            elif kind < 0.80:
                out.append(f"<h{(k := r.randint(2, 4))}>{mine(words(1, 6).capitalize())}</h{k}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{mine(words(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote>{mine(sentences(1, 3))}</blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{mine(words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.94:
                out.append(f"<pre>{mine(words(2, 12))}</pre>")
            elif kind < 0.96:
                out.append(f"<div>{mine(sentences(1, 4))}</div>")
            else:
                out.append(r.choice((aside_box, form))())
        return "".join(out)

    def page() -> str:
        title = words(2, 9).capitalize()
        head = f"<html><head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>"
        top = [box("header", r.choice((f"<a href=/>{word()}</a>", f"<h1>{word()}</h1>", f"<p>{words(1, 5)}</p>", prose(), prose())))] * (r.random() < 0.4)
        top += [box("menu", r.choice((links(3, 9), links(3, 9), links(2, 6) + prose(), prose() + links(2, 6), prose())))] * (r.random() < 0.85) + [aside_box() for _ in range(r.choice((0, 1, 1, 2)))] + [form()] * (r.random() < 0.2)
        first = f"<h1>{mine(title)}</h1>" * (r.random() < 0.85)
        inner = first + article()
        shape = r.random()
        if shape < 0.45:
            inner = f"<article>{inner}{comments() if r.random() < 0.08 else ''}</article>"
        elif shape < 0.6:
            inner = f"<main>{inner}</main>"
        elif shape < 0.9:
            inner = f'<div {r.choice(("class", "id"))}="{r.choice(MAIN_NAMES)}">{inner}</div>'
        else:
            inner = f"<div>{inner}</div>"
        if r.random() < 0.2:
            inner = f"<main>{inner}</main>"
        bare = r.random()
        if bare < 0.08:
            return inner
        if bare < 0.12:
            return article() if r.random() < 0.5 else mine(sentences(1, 3))
        low = [comments()] * (r.random() < 0.35) + [aside_box() for _ in range(r.choice((0, 0, 1, 2)))] + [form()] * (r.random() < 0.15)
        low += [box("menu", r.choice((links(3, 9), prose())))] * (r.random() < 0.15)
        low += [box("footer", r.choice((f"&copy; {word()}.example &middot; {sentences(1, 3)}", f"<p>{sentences(1, 2)}</p>", prose(), links(2, 6), f"<p>&copy; {words(1, 4)}</p>{links(2, 4)}")))] * (r.random() < 0.85)
        return head + "<!-- x -->".join((*top, inner, *low)) + r.choice(("</body></html>", "</body></html>", "", "</body>"))

    return [page() for _ in range(n)]


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """A labelled page's blocks, without the marks, and their labels."""
    found = blocks(page)
    labels = [int("\ue000" in b.text or "\ue001" in b.text) for b in found]
    for b in found:
        b.text = b.text.replace("\ue000", "").replace("\ue001", "").strip() or "."
    return found, labels


@functools.cache
def default_model() -> Model:
    pages = [labelled(p) for p in labelled_pages()]
    return train([(features(found), labels) for found, labels in pages])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, model.decode(found)) if y)


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    The whole html is read, in time in proportion to its length; null or empty html gives an empty text, as does a
    page without main text. Where two labellings are equally probable, blocks are no main text. Null ids and urls are
    handed on, repeated rows come back each, other columns are ignored; an empty table gives an empty table.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, run, f"page_id {id_type(pages, 'page_id')}, url string, text string, n_chars bigint")
