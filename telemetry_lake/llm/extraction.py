"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags, with the path of open elements.  A block is
read as the sum of vectors of its path marks (tag names, classes, ids, roles), the mean vector of its hashed words and a few
lengths.  A bidirectional LSTM in numpy runs over the whole sequence and labels every block as main text or not.

The network is trained here, on at most ``FIT_PAGES`` pages of at most ``FIT_BYTES`` (chosen by a hash of the id).  Pages with
semantic elements teach: blocks in article or main, outside menus, footers, asides, forms, notices, adverts and comments.
Their blocks are also laid out anew in generated page frames, which carry the same roles by other elements and class
names.  Every page is then labelled from its whole html.

Defined cases: NULL or empty html, and pages without main text, give the empty text; markup may be unclosed or broken (a
head ends where something begins that cannot stand in it, an unseen element without an end tag at the next block, a stray
quote is a character); a page is read once, and a block below very many open elements carries the marks of some of them; an
empty table gives no rows; NULL or repeated ids and NULL urls are kept; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, mix, segment_sum, slices, split_words, table

FIT_PAGES = 240
FIT_BYTES = 1 << 16
MARKS = 1024
WORDS = 2048
WIDTH = 16
STATE = 24
EPOCHS = 14
CELLS = 100_000
EXTRACTED = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"

# Element names of HTML.
UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "head", "title", "textarea", "select", "object"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"div", "section", "article", "main", "body", "html", "ul", "ol", "dl", "table", "nav", "aside", "header", "footer",
         "form", "blockquote"}

IN_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}
ENDS_UNSEEN = SCOPE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "figure", "fieldset", "address"}

PROPER = r"(?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++))?+)*+\s*+/?"
#: Comments, declarations, and tags with their attributes if these are in order (read by ``attributes_end`` if not).
START = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:({PROPER})>)?", re.S)
UP_TO_VALUE = re.compile(r"[^>=]*")
SPACES = re.compile(r"\s*")
UNQUOTED = re.compile(r"[^\s>]*")
#: Open elements whose marks a block carries: the outermost and the innermost ones.
OUTER, INNER = 8, 40
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")
BLOCK_END = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


def mark(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % MARKS


class Tag(NamedTuple):
    """One tag; comments and declarations have no name."""
    start: int
    closing: bool
    name: str
    attributes: str


def attributes_end(page: str, at: int) -> int:
    """Where the ">" of a tag is (or the page ends), read once from its name on.

    As in browsers a quote matters only where a value begins: a stray one is a character like any other, and a quoted value
    without its second quote takes the rest of the page.
    """
    n = len(page)
    while at < n:
        at = UP_TO_VALUE.match(page, at).end()
        if at >= n or page[at] == ">":
            return at
        at = SPACES.match(page, at + 1).end()
        if at < n and page[at] in "\"'":
            end = page.find(page[at], at + 1)
            at = n if end < 0 else end + 1
        else:
            at = UNQUOTED.match(page, at).end()
    return n


def tags(page: str) -> Iterator[tuple[str, Tag | None]]:
    """(text before it, tag) in page order, with None after the last; what raw elements hold is left out."""
    at, n = 0, len(page)
    while at < n:
        found = START.search(page, at)
        if found is None:
            yield page[at:], None
            break
        closing, name, attributes = found.groups()
        before, at = page[at:found.start()], found.end()
        if not name:
            yield before, Tag(found.start(), False, "", "")
            continue
        name = name.lower()
        if attributes is None:
            end = attributes_end(page, at)
            attributes, at = page[at:end], end + 1
        yield before, Tag(found.start(), bool(closing), name, attributes)
        if name in RAW and not closing:
            close = re.compile(rf"</{name}[\s>/]", re.I).search(page, at)
            at = close.start() if close else n


def never_closed(page: str) -> set[int]:
    """Where unseen elements begin that have no end tag of their own; a select ends an open select."""
    waiting: dict[str, list[int]] = {}
    lost: list[int] = []
    for _, tag in tags(page):
        if tag and tag.name in UNSEEN:
            held = waiting.setdefault(tag.name, [])
            if tag.closing:
                if held:
                    held.pop()
            else:
                if tag.name == "select":
                    lost += held
                    held.clear()
                held.append(tag.start)
    return {at for held in (lost, *waiting.values()) for at in held}


class Path:
    """The open elements, with how often each name is open; unseen ones other than head keep where they began."""

    def __init__(self):
        self.stack: list[tuple[str, list[str]]] = []
        self.names: Counter[str] = Counter()
        self.begun: list[int] = []
        self.unseen = 0

    def push(self, name: str, marks: list[str], at: int) -> None:
        self.stack.append((name, marks))
        self.names[name] += 1
        self.unseen += name in UNSEEN
        if name in UNSEEN and name != "head":
            self.begun.append(at)

    def pop(self) -> str:
        name, _ = self.stack.pop()
        self.names[name] -= 1
        self.unseen -= name in UNSEEN
        if name in UNSEEN and name != "head":
            self.begun.pop()
        return name

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def marks(self) -> list[str]:
        """The marks of the open elements (the outermost and innermost of a deep path) and the names of the nearest blocks."""
        deep = len(self.stack) > OUTER + INNER
        some = self.stack[:OUTER] + self.stack[-INNER:] if deep else self.stack
        near = [name for name, _ in some if name not in INLINE][-3:]
        return [m for _, own in some for m in own] + [f"near{i}={name}" for i, name in enumerate(reversed(near))]


def blocks(page: str) -> list[tuple[list[str], str]]:
    """(path marks, text) of each leaf block in page order; character references decoded, white space made one space."""
    out: list[tuple[list[str], str]] = []
    path = Path()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        whole = " ".join(html_lib.unescape("".join(text)).split())
        text.clear()
        if whole:
            out.append((path.marks() + ["linked" if 2 * linked >= len(whole) else "plain"], whole))
        linked = 0

    lost: set[int] | None = None
    for piece, tag in tags(page):
        if path.top() == "head" and piece.strip():  # text ends a head, as does what cannot stand in one
            path.pop()
        if piece and not path.unseen:
            text.append(piece)
            linked += len(piece) if path.names["a"] else 0
        if tag is None:
            break
        name = tag.name
        if not name:
            continue
        block = name not in INLINE
        if block:
            flush()
        if tag.closing:
            if path.names[name]:
                while path.pop() != name:
                    pass
            continue
        if name in ENDS_UNSEEN and path.begun:
            lost = never_closed(page) if lost is None else lost
            while path.begun and path.begun[-1] in lost:  # an unseen element without an end tag holds no blocks
                held = len(path.begun)
                while len(path.begun) == held:
                    path.pop()
        if path.top() == "head" and name not in IN_HEAD:
            path.pop()
        if name in VOID:
            continue
        ends = CLOSES.get(name) or (BLOCK_END if block and name in BLOCK_END else None)
        if ends and any(path.names[e] for e in ends):
            for i in range(len(path.stack) - 1, -1, -1):
                if path.stack[i][0] in ends:
                    while len(path.stack) > i:
                        path.pop()
                    break
                if path.stack[i][0] in SCOPE:
                    break
        own = [name]
        if tag.attributes:
            for key, *values in ATTRIBUTE.findall(tag.attributes):
                own += [f".{w}" for w in PARTS.findall("".join(values).lower())]
            if HIDDEN.search(tag.attributes):
                own.append(".hidden")
        if not tag.attributes.endswith("/") or name not in ("svg", "iframe"):
            path.push(name, own, tag.start)
    flush()
    return out


class Sequences:
    """Pages as arrays: path marks and hashed words by block, lengths by block, blocks by page."""

    def __init__(self, pages: list[list[tuple[list[str], str]]], known: dict[str, int]):
        flat = [b for p in pages for b in p]
        self.ptr = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
        ids = []
        for marks, _ in flat:
            for m in marks:
                if m not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[m] = mark(m)
                ids.append(known[m])
        self.marks = np.asarray(ids, np.int64)
        self.marks_ptr = np.concatenate([[0], np.cumsum([len(m) for m, _ in flat])]).astype(np.int64)
        codes, vocab, self.words_ptr = split_words(pa.array([t for _, t in flat], pa.string()))
        hashed = (mix(hash_words(vocab)) % np.uint64(WORDS)).astype(np.int64)
        self.words = hashed[codes] if len(codes) else np.zeros(0, np.int64)
        chars = np.asarray([len(t) for _, t in flat], np.float32)
        stops = np.asarray([t.count(".") + t.count(",") for _, t in flat], np.float32)
        self.sizes = np.stack([np.log1p(chars) / 6, np.log1p(stops) / 3, np.ones_like(chars)], axis=1)


def new_weights(seed: int = 6) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    inputs = 2 * WIDTH + 3
    w = {"marks": rng.normal(0, 0.1, (MARKS, WIDTH)), "words": rng.normal(0, 0.1, (WORDS, WIDTH)),
         "out": rng.normal(0, 0.1, 2 * STATE), "bias": np.zeros(1)}
    for way in "fb":
        w[f"x{way}"] = rng.normal(0, 0.15, (inputs, 4 * STATE))
        w[f"h{way}"] = rng.normal(0, 0.15, (STATE, 4 * STATE))
        w[f"c{way}"] = np.concatenate([np.zeros(STATE), np.ones(STATE), np.zeros(2 * STATE)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def read_blocks(s: Sequences, w: dict[str, np.ndarray]) -> np.ndarray:
    """(blocks x inputs) vectors."""
    return np.concatenate([
        segment_sum(w["marks"][s.marks], s.marks_ptr),
        segment_sum(w["words"][s.words], s.words_ptr) / np.maximum(np.diff(s.words_ptr), 1)[:, None].astype(np.float32),
        s.sizes], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def places(ptr: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pages x steps) block numbers and whether there is a block, padded at the end."""
    size = np.diff(ptr)[pages]
    steps = np.arange(int(size.max()))
    there = steps[None, :] < size[:, None]
    return np.where(there, ptr[pages][:, None] + steps[None, :], 0), there


def backwards(at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The column of each step when a row is read from its last block to its first."""
    size = there.sum(axis=1, keepdims=True)
    return np.where(there, size - 1 - np.arange(there.shape[1])[None, :], 0)


def lstm(x: np.ndarray, w: dict[str, np.ndarray], way: str, keep: bool = False):
    """Hidden states (pages x steps x STATE) of one direction; padding comes last, so it changes no real step."""
    n, steps, _ = x.shape
    drive = x @ w[f"x{way}"] + w[f"c{way}"]
    h, c = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
    out = np.empty((n, steps, STATE), np.float32)
    trail = []
    for t in range(steps):
        z = drive[:, t] + h @ w[f"h{way}"]
        gate = sigmoid(z[:, :3 * STATE])
        i, f, o = gate[:, :STATE], gate[:, STATE:2 * STATE], gate[:, 2 * STATE:]
        g = np.tanh(z[:, 3 * STATE:])
        before = (h, c)
        c = f * c + i * g
        squash = np.tanh(c)
        h = o * squash
        out[:, t] = h
        if keep:
            trail.append((*before, i, f, o, g, squash))
    return out, trail


def lstm_back(x, w, way, trail, dout):
    """Gradients of one direction: (inputs, x weights, h weights, constants)."""
    n, steps, _ = x.shape
    dh, dc = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
    dz_all = np.empty((n, steps, 4 * STATE), np.float32)
    dwh = np.zeros_like(w[f"h{way}"])
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, g, squash = trail[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - squash * squash)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * squash * o * (1 - o),
                             dc * i * (1 - g * g)], axis=1)
        dz_all[:, t] = dz
        dwh += h0.T @ dz
        dh = dz @ w[f"h{way}"].T
        dc = dc * f
    flat = dz_all.reshape(-1, 4 * STATE)
    return (dz_all @ w[f"x{way}"].T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0))


def main_probability(s: Sequences, w: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of each block to be main text, with the whole page as context."""
    prob = np.zeros(int(s.ptr[-1]), np.float32)
    x = read_blocks(s, w).astype(np.float32)
    size = np.diff(s.ptr)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= CELLS:
            hi += 1
        at, there = places(s.ptr, order[lo:hi])
        turn = backwards(at, there)
        forth, _ = lstm(x[at], w, "f")
        back, _ = lstm(x[np.take_along_axis(at, turn, 1)], w, "b")
        back = np.take_along_axis(back, turn[:, :, None], 1)
        z = np.concatenate([forth, back], axis=2) @ w["out"] + w["bias"]
        prob[at[there]] = sigmoid(z[there])
        lo = hi
    return prob


def train(pages: list[list[tuple[list[str], str]]], labels: list[np.ndarray], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam on the mean cross-entropy of the blocks, through time in both directions."""
    s, y = Sequences(pages, {}), np.concatenate(labels).astype(np.float32)
    w, rng, step = new_weights(), np.random.default_rng(7), 0
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    full = np.flatnonzero(np.diff(s.ptr))
    mark_owner = np.repeat(np.arange(len(y)), np.diff(s.marks_ptr))
    word_owner = np.repeat(np.arange(len(y)), np.diff(s.words_ptr))
    word_part = 1 / np.maximum(np.diff(s.words_ptr), 1).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(full)
        order = order[np.argsort(np.diff(s.ptr)[order] // 8, kind="stable")]
        groups = [order[i:i + 24] for i in range(0, len(order), 24)]
        for g in rng.permutation(len(groups)):
            at, there = places(s.ptr, groups[g])
            turn = backwards(at, there)
            back_at = np.take_along_axis(at, turn, 1)
            if step % 4 == 0:  # block vectors follow the embeddings every fourth step
                x = read_blocks(s, w).astype(np.float32)
            xf, xb = x[at], x[back_at]
            forth, keep_f = lstm(xf, w, "f", True)
            back, keep_b = lstm(xb, w, "b", True)
            both = np.concatenate([forth, np.take_along_axis(back, turn[:, :, None], 1)], axis=2)
            dz = np.where(there, sigmoid(both @ w["out"] + w["bias"]) - y[at], 0).astype(np.float32) / there.sum()
            grads = {"out": (both * dz[:, :, None]).sum(axis=(0, 1)), "bias": np.array([dz.sum()], np.float32)}
            dboth = dz[:, :, None] * w["out"]
            dback = np.where(there[:, :, None], np.take_along_axis(dboth[:, :, STATE:], turn[:, :, None], 1), 0)
            dxf, grads["xf"], grads["hf"], grads["cf"] = lstm_back(xf, w, "f", keep_f, dboth[:, :, :STATE])
            dxb, grads["xb"], grads["hb"], grads["cb"] = lstm_back(xb, w, "b", keep_b, dback)
            dx = np.zeros((len(y), x.shape[1]), np.float32)
            np.add.at(dx, at[there], dxf[there])
            np.add.at(dx, back_at[there], dxb[there])
            touched = np.zeros(len(y), bool)
            touched[at[there]] = True
            for name, ids, owner, part in (("marks", s.marks, mark_owner, None), ("words", s.words, word_owner, word_part)):
                mine = touched[owner]
                lo = 0 if name == "marks" else WIDTH
                rows = dx[owner[mine], lo:lo + WIDTH]
                grads[name] = np.zeros_like(w[name])
                np.add.at(grads[name], ids[mine], rows if part is None else rows * part[owner[mine], None])
            step += 1
            for k, gr in grads.items():
                m, v = state[k]
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                w[k] -= (0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return w


# What teaches: semantic elements and class words of page parts that are not main text.
BESIDE = ("nav", "footer", "aside", "form", "header", ".nav", ".navbar", ".menu", ".footer", ".header", ".sidebar", ".aside",
          ".ad", ".ads", ".advert", ".sponsored", ".promo", ".cookie", ".notice", ".consent", ".banner", ".comment",
          ".comments", ".share", ".social", ".related", ".newsletter", ".breadcrumb", ".widget", ".hidden", ".popup", ".modal")
FRAMES = (  # (part, ways to open it); each way is the marks of the elements around the part's blocks
    ("menu", (["nav", "ul", "li", "a"], ["div", ".menu", "ul", "li", "a"], ["div", ".navbar", "a"], ["header", "nav", "a"],
              ["ul", ".nav", "li", "a"], ["div", ".breadcrumb", "a"])),
    ("top", (["header"], ["div", ".header"], ["div", ".banner"], ["header", ".site", ".header", "p"])),
    ("advert", (["div", ".ad"], ["div", ".ads"], ["aside", ".advert"], ["div", ".sponsored", "p"], ["section", ".promo", "p"])),
    ("notice", (["div", ".cookie", ".notice", "p"], ["div", ".consent"], ["div", ".notice"], ["div", ".popup", "p"],
                ["div", ".modal"])),
    ("side", (["aside", "p"], ["div", ".sidebar", "p"], ["aside", "ul", "li", "a"], ["div", ".widget"],
              ["div", ".related", "ul", "li", "a"], ["div", ".share", "a"], ["div", ".social", "a"])),
    ("form", (["form", "label"], ["form", "p"], ["div", ".newsletter", "form"], ["form", "button"])),
    ("comments", (["div", ".comments", "div", ".comment", "p"], ["section", ".comments", "p"], ["ol", ".comment", "li"],
                  ["div", ".comments", "p"], ["section", ".comment", "article", "p"])),
    ("foot", (["footer"], ["footer", "p"], ["div", ".footer"], ["div", ".footer", "p"], ["footer", "ul", "li", "a"])),
)
MAIN = (["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".post", ".body"], ["section", ".article"],
        ["div", ".entry", ".content"], ["div", ".main"], ["article", ".post"], ["div", ".story"], ["article", "section"])


def taught(page: list[tuple[list[str], str]]) -> np.ndarray | None:
    """Labels of a page's blocks where semantic elements tell them; None where they don't."""
    paths = [set(marks) for marks, _ in page]
    if not any("article" in p or "main" in p for p in paths):
        return None
    return np.asarray([bool({"article", "main"} & p) and not p.intersection(BESIDE) for p in paths])


def laid_out(rng: np.random.Generator, main: list[str], other: list[str]) -> tuple[list[tuple[list[str], str]], np.ndarray]:
    """A generated page: main blocks in one frame, other page parts around and inside it."""
    def block(path: list[str], text: str) -> tuple[list[str], str]:
        marks = ["html", "body", *path]
        near = [m for m in marks if not m.startswith(".") and m not in INLINE][-3:]
        return (marks + [f"near{i}={m}" for i, m in enumerate(reversed(near))]
                + ["linked" if "a" in path else "plain"], text)

    def part(kind: str, ways: tuple, inside: list[str]) -> list[tuple[tuple[list[str], str], bool]]:
        way = ways[rng.integers(len(ways))]
        out = []
        for _ in range(int(rng.integers(1, 7))):
            text = other[rng.integers(len(other))]
            words = text.split()
            if kind in ("menu", "top", "form") or rng.random() < 0.3:
                text = " ".join(words[:int(rng.integers(1, 5))]) or text
            out.append((block([*inside, *way], text), False))
        return out

    frame = MAIN[rng.integers(len(MAIN))]
    body = []
    for i, text in enumerate(main):
        kind = "h1" if i == 0 and rng.random() < 0.8 else str(rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "td"]))
        leaf = {"li": ["ul", "li"], "td": ["table", "tr", "td"], "blockquote": ["blockquote", "p"]}.get(kind, [kind])
        body.append((block([*frame, *leaf, *(["b"] if rng.random() < 0.1 else [])], text), True))
        if rng.random() < 0.06:
            kind, ways = FRAMES[rng.integers(2, len(FRAMES))]
            body += part(kind, ways, frame)
    before = [x for kind, ways in FRAMES[:4] if rng.random() < 0.5 for x in part(kind, ways, [])]
    after = [x for kind, ways in FRAMES[2:] if rng.random() < 0.5 for x in part(kind, ways, [])]
    rows = before + body + after
    return [b for b, _ in rows], np.asarray([y for _, y in rows])


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> dict[str, np.ndarray]:
    """Weights from at most ``fit_pages`` pages of at most ``FIT_BYTES`` and as many pages laid out anew, twice."""
    keyed = pages.where(F.octet_length("html") <= FIT_BYTES).select("html", F.xxhash64("page_id", "html").alias("key"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(fit_pages)  # keys only; then their pages
    rows = keyed.join(F.broadcast(chosen), "key", "left_semi").limit(fit_pages).collect()
    rows = sorted(rows, key=lambda r: (r["key"], r["html"]))
    real, labels, main, other = [], [], [], []
    for r in rows:
        page = blocks(r["html"])
        y = taught(page)
        if y is not None:
            real.append(page)
            labels.append(y)
            main.append([t for (_, t), yes in zip(page, y) if yes])
            other += [t for (_, t), yes in zip(page, y) if not yes]
    rng = np.random.default_rng(5)
    if not other or not any(main):  # nothing teaches: lay out pages of made-up words
        words = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(200)]
        lines = [" ".join(rng.choice(words, int(rng.integers(3, 60)))) + "." for _ in range(300)]
        main, other = [lines[i:i + 6] for i in range(0, 300, 6)], lines
    lines = [t for m in main for t in m]
    for _ in range(2):
        for texts in main:
            if texts:
                more = [lines[i] for i in rng.integers(len(lines), size=int(rng.integers(0, 5)))]
                page, y = laid_out(rng, texts + more, other + lines[:len(other)])
                real.append(page)
                labels.append(y)
    return train(real, labels)


def extract(pages: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """One ``EXTRACTED`` row per page."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                split = [blocks(h or "") for h in part.column("html").to_pylist()]
                s = Sequences(split, known)
                keep = main_probability(s, shared.value) >= 0.5
                texts, kept = [], []
                for page, lo in zip(split, s.ptr[:-1].tolist()):
                    chosen = [t for i, (_, t) in enumerate(page) if keep[lo + i]]
                    texts.append(" ".join(chosen))
                    kept.append(len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(s.ptr)), pa.array(kept, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        "html").mapInArrow(run, EXTRACTED)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
