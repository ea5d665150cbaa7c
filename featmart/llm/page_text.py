"""Main text of web pages: leaf blocks labelled by a bidirectional recurrent network.

A page becomes its sequence of leaf blocks, each with a vector of its tag path and hashed
words. A long short-term memory runs over the sequence from both ends, so every block is
judged in view of the whole page; the blocks judged content are the text.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm import words
from featmart.llm.tables import kept_names, map_batches, numbered, raw

#: Tags that do not end a block.
INLINE = frozenset(
    # Formulas and drawings stand in the line, with their parts.
    "math mi mn mo mrow ms mspace mtext msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover mtable mtr mtd semantics annotation "
    "svg g path rect circle ellipse line polyline polygon text tspan defs use canvas "
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
#: Tags without content, whose whole content is not text, and that end an open one of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title textarea iframe select".split())
#: Hidden tags whose content is no markup, so that without a closing tag it is all the rest.
RAW_TEXT = frozenset("script style title textarea iframe".split())
#: Parts of formulas and drawings, which may close themselves.
FOREIGN = frozenset("math svg canvas".split()) | {t for t in INLINE if t[0] == "m" and t != "mark"} | frozenset(
    "g path rect circle ellipse line polyline polygon text tspan defs use semantics annotation".split()
)
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body blockquote div dl footer form header html main nav ol section table td ul".split())
BLOCK_OPENERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--|<[!?]|</?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_NAMES = re.compile(r"""(?i)[\s"'](class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_WORD = re.compile(r"[a-z]+")


class Node:
    """An open element by its parent, so that blocks share their path."""

    __slots__ = ("parent", "name", "depth", "_sums")

    def __init__(self, parent: Node | None, name: str):
        self.parent, self.name, self.depth, self._sums = parent, name, 1 + (parent.depth if parent else 0), None

    def names(self) -> list[str]:
        out, node = [], self
        while node:
            out.append(node.name)
            node = node.parent
        return out[::-1]

    def sums(self) -> np.ndarray:
        """Signed hashes of all names from the root to here, each node's kept."""
        todo, node = [], self
        while node and node._sums is None:
            todo.append(node)
            node = node.parent
        total = node._sums if node else np.zeros(PATH_SIZE, dtype=np.float32)
        for node in reversed(todo):
            total = node._sums = total + _element(node.name)[0]
        return total


@dataclass
class Block:
    path: Node | None
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: white space collapsed, references decoded, none empty.

    Made for broken pages: unknown closing tags are ignored, unclosed ones end with their
    parent, and an unfinished tag or raw text at the end is dropped.
    """
    out: list[Block] = []
    # (tag, path down to it), and how many of each tag are open.
    stack: list[tuple[str, Node | None]] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    link_parts: list[str] = []
    path: Node | None = None

    def push(tag: str, name: str) -> None:
        above = stack[-1][1] if stack else None
        stack.append((tag, above if tag in INLINE else Node(above, name)))
        open_tags[tag] += 1

    def cut(size: int) -> None:
        while len(stack) > size:
            open_tags[stack.pop()[0]] -= 1

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html_lib.unescape(" ".join(link_parts)).split()))
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
            link_parts.clear()

    def add(text: str) -> None:
        nonlocal path
        if not text:
            return
        if not parts:
            if text.isspace():
                return
            path = stack[-1][1] if stack else None
        parts.append(text)
        if open_tags["a"]:
            link_parts.append(text)

    def end_open(tags: tuple[str, ...]) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                cut(i)
                return
            if stack[i][0] in SCOPES:
                return

    def close(tag: str) -> None:
        if not open_tags[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                cut(i)
                return
            if tag in INLINE and stack[i][0] not in INLINE:
                return

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        start = found.start()
        if page.startswith("<!--", start):
            # The dashes that open a comment may end it: <!--> and <!---> are whole.
            end = page.find("-->", start + 2)
            at = size if end < 0 else end + 3
            continue
        stop = _TAG_END.match(page, found.end())
        if stop:
            at = stop.end()
        else:
            end = page.find(">", found.end())
            if end < 0:
                break
            at = end + 1
        tag = (found[1] or "").lower()
        if not tag:
            continue
        if page[start + 1] == "/":
            if tag not in INLINE:
                flush()
            close(tag)
            continue
        if tag in HIDDEN:
            if page[at - 2] != "/":
                end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
                if end or tag in RAW_TEXT:
                    at = end.end() if end else size
                else:
                    # Never closed: an ordinary element, or it would hide the whole rest.
                    flush()
                    push(tag, _named(tag, page[found.end() : at]))
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID or tag in FOREIGN and page[at - 2] == "/":
            continue
        if tag in BLOCK_OPENERS:
            # A new block ends an open paragraph, and a hidden element that is never closed.
            end_open(("p",))
            while stack and (stack[-1][0] in HIDDEN or stack[-1][0] in FOREIGN):
                cut(len(stack) - 1)
        if tag in SIBLINGS:
            end_open(SIBLINGS[tag])
        push(tag, _named(tag, page[found.end() : at]))
    flush()
    return out


@lru_cache(maxsize=4096)
def _named(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role."""
    names = sorted({w for m in _NAMES.finditer(" " + attributes) for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())})
    return " ".join([tag, *names])


# --- vectors -------------------------------------------------------------------------

PATH_SIZE, LEAF_SIZE, WORD_SIZE, FIGURES = 64, 32, 24, 8
INPUT = PATH_SIZE + LEAF_SIZE + WORD_SIZE + FIGURES


@lru_cache(maxsize=8192)
def _element(element: str) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of an element's names, for the path and for the innermost elements."""
    path, leaf = np.zeros(PATH_SIZE, dtype=np.float32), np.zeros(LEAF_SIZE, dtype=np.float32)
    for name in element.split():
        code = zlib.crc32(name.encode())
        path[code % PATH_SIZE] += 1.0 if code & 0x10000 else -1.0
        leaf[(code >> 8) % LEAF_SIZE] += 1.0 if code & 0x20000 else -1.0
    return path, leaf


def _path_vector(path: Node | None) -> np.ndarray:
    """Signed hashes of the path's names, and of the two innermost elements' own."""
    out = np.zeros(PATH_SIZE + LEAF_SIZE, dtype=np.float32)
    if path:
        out[:PATH_SIZE] = path.sums()
        out[PATH_SIZE:] = _element(path.name)[1]
        if path.parent:
            out[PATH_SIZE:] += _element(path.parent.name)[1] / 2
    return np.clip(out, -2, 2)


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """(blocks, INPUT) of each page."""
    flat = [b for page in pages for b in page]
    if not flat:
        return [np.zeros((0, INPUT), dtype=np.float32) for _ in pages]
    chunk = words.chunk_of([b.text for b in flat])
    found = chunk.runs(words.LETTER_DIGIT)
    bags = np.zeros((len(flat), WORD_SIZE), dtype=np.float32)
    np.add.at(bags, (found.owner, (found.hashes(lower=True) % np.uint64(WORD_SIZE)).astype(np.int64)), 1)
    bags /= np.sqrt(np.maximum(found.per_text, 1))[:, None]
    chars = np.array([len(b.text) for b in flat], dtype=np.float32)
    stops = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") for b in flat], dtype=np.float32)
    figures = np.stack([
        np.log1p(chars) / 5, np.array([b.linked for b in flat]) / chars, np.log1p(found.per_text) / 4, np.minimum(stops, 5) / 5,
        np.array([b.text[-1] in ".!?" for b in flat]), np.array([b.path.depth if b.path else 0 for b in flat]) / 8,
    ], axis=1).astype(np.float32)
    paths = np.stack([_path_vector(b.path) for b in flat])
    out, low = [], 0
    for page in pages:
        high = low + len(page)
        place = np.linspace(0, 1, len(page), dtype=np.float32)[:, None]
        out.append(np.concatenate([paths[low:high], bags[low:high], figures[low:high], place, (place > 0.5)], axis=1).astype(np.float32))
        low = high
    return out


# --- network -------------------------------------------------------------------------

HIDDEN_UNITS = 16
#: Block positions in a batch of pages.
BATCH_CELLS = 1 << 15


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiLstm:
    """Two long short-term memories, one from each end, and a logistic output per step."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN_UNITS
        scale = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"out": scale(2 * h, 1), "bias": np.zeros(1, dtype=np.float32)}
        for side in "fb":
            self.p |= {side + "x": scale(INPUT, 4 * h), side + "h": scale(h, 4 * h), side + "c": np.zeros(4 * h, dtype=np.float32)}
            self.p[side + "c"][h : 2 * h] = 1

    def _run(self, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, units) along x (steps, pages, INPUT)."""
        steps, pages, _ = x.shape
        n = HIDDEN_UNITS
        into = x.reshape(-1, INPUT) @ self.p[side + "x"] + self.p[side + "c"]
        into = into.reshape(steps, pages, -1)
        h = np.zeros((pages, n), dtype=np.float32)
        c = np.zeros((pages, n), dtype=np.float32)
        out = np.zeros((steps, pages, n), dtype=np.float32)
        for t in range(steps):
            z = into[t] + h @ self.p[side + "h"]
            gates = _sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, held = h, c
            c = f * c + i * g
            wide = np.tanh(c)
            h = o * wide
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, g, before, held, wide))
        return out

    def logits(self, x: np.ndarray, length: np.ndarray, keep: tuple[list, list] | None = None):
        """(steps, pages) for pages padded at the end."""
        turn = _turned(len(x), length)
        rows = np.arange(x.shape[1])
        ahead = self._run("f", x, keep[0] if keep else None)
        back = self._run("b", x[turn, rows], keep[1] if keep else None)[turn, rows]
        both = np.concatenate([ahead, back], axis=2)
        return (both @ self.p["out"])[:, :, 0] + self.p["bias"], both, turn

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Content probability of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: -len(pages[i]))
        low = 0
        while low < len(order):
            steps = len(pages[order[low]])
            group = order[low : low + max(1, BATCH_CELLS // steps)]
            group = [i for i in group if 2 * len(pages[i]) >= steps] or group[:1]
            x, length = _padded([pages[i] for i in group])
            chance = _sigmoid(self.logits(x, length)[0])
            for k, i in enumerate(group):
                out[i] = chance[: length[k], k]
            low += len(group)
        return out

    def slopes(self, x: np.ndarray, length: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log-loss over all blocks, by backpropagation through time."""
        keep: tuple[list, list] = ([], [])
        logits, both, turn = self.logits(x, length, keep)
        inside = np.arange(len(x))[:, None] < length
        off = np.where(inside, _sigmoid(logits) - truth, 0).astype(np.float32) / inside.sum()
        n, rows = HIDDEN_UNITS, np.arange(x.shape[1])
        grad = {"out": np.einsum("tpu,tp->u", both, off)[:, None], "bias": np.array([off.sum()])}
        onto = off[:, :, None] * self.p["out"][:, 0]
        for side, inputs, part, states in (("f", x, onto[:, :, :n], keep[0]), ("b", x[turn, rows], onto[:, :, n:][turn, rows], keep[1])):
            dz = np.zeros((*part.shape[:2], 4 * n), dtype=np.float32)
            dh = dc = np.zeros(part.shape[1:], dtype=np.float32)
            up = np.zeros_like(self.p[side + "h"])
            for t in range(len(x) - 1, -1, -1):
                i, f, o, g, before, held, wide = states[t]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - wide**2)
                z = np.concatenate([dc * g * i * (1 - i), dc * held * f * (1 - f), dh * wide * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz[t] = z
                up += before.T @ z
                dh = z @ self.p[side + "h"].T
                dc = dc * f
            flat = dz.reshape(-1, 4 * n)
            grad |= {side + "x": inputs.reshape(-1, INPUT).T @ flat, side + "h": up, side + "c": flat.sum(axis=0)}
        return grad

    def fit(self, pages: list[np.ndarray], truth: list[np.ndarray], rounds: int = 12, batch: int = 32, rate: float = 0.012, seed: int = 6) -> "BiLstm":
        """Adam over shuffled batches of pages; deterministic."""
        rng = np.random.default_rng(seed)
        some = [i for i, p in enumerate(pages) if len(p)]
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        turn = 0
        for _ in range(rounds):
            order = rng.permutation(some)
            for low in range(0, len(order), batch):
                group = order[low : low + batch]
                x, length = _padded([pages[i] for i in group])
                goal = np.zeros(x.shape[:2], dtype=np.float32)
                for k, i in enumerate(group):
                    goal[: length[k], k] = truth[i]
                turn += 1
                for name, slope in self.slopes(x, length, goal).items():
                    mean, square = moments[name]
                    slope = np.clip(slope, -1, 1) + 1e-5 * self.p[name]
                    mean += 0.1 * (slope - mean)
                    square += 0.01 * (slope**2 - square)
                    self.p[name] -= (rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
        return self


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in pages])
    x = np.zeros((length.max(), len(pages), INPUT), dtype=np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
    return x, length


def _turned(steps: int, length: np.ndarray) -> np.ndarray:
    """For each page, its steps in reverse, padding left in place."""
    at = np.arange(steps)[:, None]
    return np.where(at < length, length - 1 - at, at)


# --- training ------------------------------------------------------------------------

#: Pages of the built-in labelled table, pages sampled from the table at hand, and the
#: longest (bytes) among these.
BUILT_IN, SAMPLED, SAMPLE_BYTES = 400, 100, 40_000

#: Fixed values of the built-in table: names that page authors give to the parts.
MAIN = ['<article>', '<article class="post">', '<main>', '<div class="content">', '<div id="article-body">', '<div class="entry-content">',
        '<section class="story">', '<div class="post-text">', '<div role="main">', '<main id="main-content">', '<div>']
PARTS = {
    "menu": ['<nav>', '<ul class="menu">', '<div id="navigation">', '<nav class="breadcrumbs">', '<div class="navbar">', '<ul class="nav-links">'],
    "header": ['<header>', '<div id="header">', '<div class="site-header">', '<div class="banner">', '<header class="top">'],
    "footer": ['<footer>', '<div id="footer">', '<div class="copyright">', '<footer class="site-footer">'],
    "sidebar": ['<aside>', '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<aside class="related">', '<div class="related-posts">'],
    "notice": ['<div class="cookie-notice">', '<div class="notice">', '<div id="cookie-banner">', '<div class="alert">', '<div class="consent">', '<div class="popup">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="sponsored">', '<aside class="advertisement">', '<div class="promo">'],
    "form": ['<form>', '<form class="newsletter">', '<form id="search">', '<div class="subscribe">', '<form action="/login">'],
    "comments": ['<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="comment-list">', '<section id="reader-comments">', '<div class="responses">'],
}


def labelled_pages(count: int = BUILT_IN, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """The built-in labelled table: pages made from rules, with the truth for each block.

    Parts come in random order around, and some inside, the article; tags are dropped and
    names left out at random.
    """
    rng = np.random.default_rng(seed)
    pieces = "an er th ion re ou le des que con ar der en st ing at or es ti la".split()
    pick = lambda values: values[int(rng.integers(len(values)))]

    def sentence(low: int, high: int) -> str:
        text = " ".join("".join(pick(pieces) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high))))
        return text.capitalize() + pick([".", ".", ".", "", "?", "!"])

    def closing(tag: str) -> str:
        return f"</{re.match('<([a-z0-9]+)', tag)[1]}>"

    def part(kind: str) -> tuple[str, list[bool]]:
        tag = pick(PARTS[kind])
        rows: list[str] = []
        for _ in range(int(rng.integers(1, 7 if kind in ("menu", "comments", "sidebar") else 3))):
            if kind == "menu":
                rows.append(f'<li><a href="/x">{sentence(1, 3)}</a></li>')
            elif kind == "form":
                rows.append(f"<label>{sentence(1, 4)}</label><input name=q><br><button>{sentence(1, 2)}</button>")
            elif kind == "comments":
                rows.append(f'<div class="{pick(["comment", "reply", "c"])}"><b>{sentence(1, 3)}</b><p>{sentence(3, 40)}</p></div>')
            elif kind == "sidebar":
                rows.append(pick([f"<h3>{sentence(1, 4)}</h3>", f'<p><a href="/y">{sentence(2, 9)}</a></p>', f"<p>{sentence(5, 30)}</p>"]))
            else:
                rows.append(pick([f"<p>{sentence(2, 20)}</p>", sentence(2, 20), f'<a href="/z">{sentence(1, 4)}</a> &middot; {sentence(1, 6)}']))
        body = tag + "".join(rows) + closing(tag)
        return body, [False] * len(blocks(body))

    def article() -> tuple[str, list[bool]]:
        tag = pick(MAIN)
        rows, truth = [], []
        if rng.random() < 0.8:
            rows.append(f"<{(h := pick(['h1', 'h1', 'h2']))}>{sentence(2, 10)}</{h}>")
            truth.append(True)
        for _ in range(int(rng.integers(1, 14))):
            body = pick([
                f"<p>{sentence(3, 60)} {sentence(3, 60)}</p>", f"<p>{sentence(3, 90)}", f"<p><b>{sentence(2, 20)}<br><p>{sentence(1, 30)}</p>",
                f"<h2>{sentence(1, 6)}</h2>", f"<ul><li>{sentence(2, 12)}</li><li>{sentence(2, 12)}</li></ul>",
                f'<p>{sentence(3, 30)} <a href="/q">{sentence(1, 4)}</a> {sentence(3, 30)}</p>', f"<blockquote>{sentence(4, 30)}</blockquote>", f"<p>{sentence(1, 3)}</p>",
            ])
            rows.append(body)
            truth += [True] * len(blocks(body))
            if rng.random() < 0.06:
                body, more = part(pick(["advert", "notice", "form", "sidebar"]))
                rows.append(body)
                truth += more
        if rng.random() < 0.15:
            body, more = part("comments")
            rows.append(body)
            truth += more
        return tag + "".join(rows) + (closing(tag) if rng.random() < 0.95 else ""), truth

    table = []
    for _ in range(count):
        upper = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.4]
        lower = [k for k in ("comments", "advert", "sidebar", "form", "menu", "notice") if rng.random() < 0.3] + ["footer"] * (rng.random() < 0.8)
        rng.shuffle(upper)
        made = [*map(part, upper), article() if rng.random() < 0.96 else ("", []), *map(part, lower)]
        page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(b for b, _ in made) + "</body></html>"
        truth = [t for _, part_truth in made for t in part_truth]
        if len(blocks(page)) == len(truth):
            table.append((page, truth))
    return table


_OUTSIDE = frozenset("nav header footer aside form".split())
_PART_NAMES = frozenset("ad ads advert advertisement comment comments cookie footer menu nav navbar notice promo sidebar sponsored".split())


def assumed(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that has one clear main element, for want of a hand-made table."""
    paths = [b.path.names() if b.path else [] for b in page]
    inner = [any(e.split()[0] in ("article", "main") for e in p) for p in paths]
    if not any(inner):
        return None
    return np.array([
        inside and not any(e.split()[0] in _OUTSIDE or _PART_NAMES & set(e.split()[1:]) for e in p) for inside, p in zip(inner, paths)
    ], dtype=np.float32)


def train(pages: DataFrame | None, id_col: str = "page_id", text: str = "html") -> BiLstm:
    """Fit on the built-in table and at most SAMPLED pages, those smallest by hash."""
    table = [(blocks(page), np.array(truth, dtype=np.float32)) for page, truth in labelled_pages()]
    if pages is not None:
        hashed = pages.select(raw(text).alias("t"), F.xxhash64(F.col(id_col).cast("string"), raw(text)).alias("h"))
        hashed = hashed.filter(F.octet_length("t").between(1, SAMPLE_BYTES))
        # Hashes are picked first: only the chosen pages' texts move.
        chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLED).collect()]
        sample = hashed.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h")
        for row in sample.collect():
            page = blocks(bytes(row["t"]).decode("utf-8", "replace"))
            truth = assumed(page)
            if truth is not None:
                table.append((page, truth))
    return BiLstm().fit(vectors([p for p, _ in table]), [t for _, t in table])


def main_text(page: list[Block], chance: np.ndarray) -> str:
    return " ".join(b.text for b, c in zip(page, chance) if c > 0.5)


def extract(pages: DataFrame, model: BiLstm, keep: list[str], text: str = "html") -> DataFrame:
    """`keep`, `text`, `n_chars`, `n_blocks`, `n_content`: one row per page.

    The text is that of all content blocks of the whole page, joined by single spaces;
    nothing is cut. A null or empty page has none. Repeated pages give equal rows, an empty
    table an empty one; time and memory grow with a page's length, however deep it is. A kept
    column named as a result comes back with `_in` behind its name.
    """
    source = numbered(pages, keep, _html=raw(F.col(f"`{text}`")))
    kinds = [kind for _, kind in source.dtypes]
    names = [f"_k{i}" for i in range(len(keep))]

    def work(batch):
        parsed = [blocks(t.decode("utf-8", "replace")) for t in batch.column("_html").to_pylist()]
        chances = model.label(vectors(parsed))
        texts = [main_text(page, chance) for page, chance in zip(parsed, chances)]
        return {n: batch.column(n) for n in names} | {
            "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(p) for p in parsed],
            "n_content": [int((c > 0.5).sum()) for c in chances],
        }

    schema = [f"{n} {k}" for n, k in zip(names, kinds)] + ["text string", "n_chars bigint", "n_blocks bigint", "n_content bigint"]
    results = ("text", "n_chars", "n_blocks", "n_content")
    return map_batches(source, ", ".join(schema), work).toDF(*kept_names(keep, results), *results)
