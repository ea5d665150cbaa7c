"""Personal data in texts: fixed patterns, and spans added by a conditional random field
over word shapes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm import crf, words
from featmart.llm.tables import kept_names, map_batches, numbered, raw

#: Kinds in the order in which spans with one start are listed; tag 0 is "none of them".
KINDS = ("email", "ip", "card", "phone")
#: Rows of the built-in labelled table, and its seed.
EXAMPLES, SEED = 1500, 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time: from
    each @ back over its local part, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per
    kind; matches that fail their check are dropped, and their text is used up."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for number, pattern, valid in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
        found += [(m.start(), number, m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return sorted(found)


# --- word shapes ---------------------------------------------------------------------

def _shape_codes() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint8)
    codes[48:58], codes[65:91], codes[97:123], codes[128:] = ord("d"), ord("X"), ord("x"), ord("u")
    return codes


SHAPES = _shape_codes()
HASHED = 1 << 11
DIGIT_EDGES = (0, 1, 2, 3, 4, 6, 8, 9, 11, 12, 15, 16, 19)
LENGTH_EDGES = (1, 2, 3, 5, 8, 12, 16, 24, 40)
MARKS = b"@.+(-:"
#: Feature ids: hashed word and shape of a word and its neighbours, then its own figures.
SIZES = [HASHED] * 6 + [len(DIGIT_EDGES) + 1, len(LENGTH_EDGES) + 1, 1 << len(MARKS), 5, 2]
BASES = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
N_FEATURES = int(sum(SIZES))


def features(chunk: words.Chunk, found: words.Runs) -> np.ndarray:
    """(words, ids)."""
    count = len(found)
    member = np.zeros(256, dtype=bool)
    member[48:58] = True
    digits = chunk.count(member, found.starts, found.ends)
    flags = np.zeros(count, dtype=np.int64)
    dots = np.zeros(count, dtype=np.int64)
    for i, mark in enumerate(MARKS):
        member = np.zeros(256, dtype=bool)
        member[mark] = True
        here = chunk.count(member, found.starts, found.ends)
        flags |= (here > 0).astype(np.int64) << i
        if mark == ord("."):
            dots = np.minimum(here, 4)
    slot = np.uint64(HASHED - 1)
    word = (found.hashes(lower=True) & slot).astype(np.int64)
    shape = (_shape_hashes(chunk, found) & slot).astype(np.int64)
    checked = np.zeros(count, dtype=np.int64)
    for i in np.flatnonzero((digits >= 12) & (digits <= 19)):
        checked[i] = luhn(digits_of(chunk.data[found.starts[i] : found.ends[i]].tobytes().decode("latin-1")))
    same = np.zeros(count + 1, dtype=bool)
    same[1:-1] = found.owner[1:] == found.owner[:-1]

    def before(values):
        return np.where(same[:-1], np.roll(values, 1), 0)

    def after(values):
        return np.where(same[1:], np.roll(values, -1), 0)

    columns = [word, shape, before(word), before(shape), after(word), after(shape),
               np.searchsorted(DIGIT_EDGES, digits), np.searchsorted(LENGTH_EDGES, found.ends - found.starts), flags, dots, checked]
    return np.stack(columns, axis=1) + BASES


def _shape_hashes(chunk: words.Chunk, found: words.Runs) -> np.ndarray:
    """Hashes of words with each run of one character class written once."""
    codes = SHAPES[chunk.data]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = codes[1:] != codes[:-1]
    keep[found.starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return words.Chunk(0, codes[keep], place[chunk.bounds]).hash_spans(place[found.starts], place[found.ends])


# --- training ------------------------------------------------------------------------

#: Fixed values of the built-in labelled table: word pieces, cues, and other numbers' cues.
PIECES = "an er th ion re ou le des que con ar der en st ing at or es ti la".split()
CUES = {
    "email": ["mail", "e-mail:", "write to", "contact", "", ""], "phone": ["call", "phone:", "tel.", "fax", "mobile", "", ""],
    "ip": ["from", "host", "server", "ip", "", ""], "card": ["card", "visa", "paid with", "", ""],
}
OTHERS = ["version {a}.{b}.{c}", "{a}.{b} percent", "order {long}", "{y}-{m:02d}-{d:02d}", "at {h}:{m:02d}", "{a},{z} euros", "page {a}",
          "{long}", 'token = "{hex}"', "licence {a}.0", "{a} ({b})", "{y}", "chapter {a}.{b}", "{z}-{z}", "no. {z}", "user@", "at the dot", "@{w}"]


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The built-in labelled table: (text, [(start, kind number, end)]), made from rules.

    Texts of invented words hold personal data in the fixed forms and in others (written-
    out mail addresses, telephone numbers without a plus, card numbers set with dots), or
    numbers of other kinds.
    """
    rng = np.random.default_rng(seed)
    pick = lambda values: values[int(rng.integers(len(values)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))

    def word() -> str:
        text = "".join(pick(PIECES) for _ in range(int(rng.integers(1, 4))))
        return pick([text, text, text, text.title(), text.upper(), text + "###", text + "!!"]) + pick(["", "", "", "", ",", "."])

    def plain() -> str:
        return "".join(pick(PIECES) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        body = number(pick([12, 15, 15, 15, 18]))
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        gap = pick(["", "", "", " ", "-", "."])
        return gap.join(body[i : i + 4] for i in range(0, len(body), 4)) if gap else body

    def private(kind: str) -> str:
        if kind == "email":
            name, host, end = plain() + pick(["", f".{number(2)}", "_" + plain()]), plain(), pick(["com", "org", "net", "de"])
            return pick([f"{name}@{host}.example.{end}", f"{name}@{host}.{end}", f"{name} at {host} dot {end}",
                         f"{name} (at) {host} (dot) {end}", f"{name} [at] {host} [dot] {end}"])
        if kind == "ip":
            return ".".join(str(int(n)) for n in rng.integers(0, 256, 4))
        if kind == "card":
            return card()
        return pick([f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(7)}", f"+{number(11)}",
                     f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}"])

    table = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 5))):
            text += " ".join(word() for _ in range(int(rng.integers(1, 7)))) + " "
            choice = pick([*KINDS, "other", "other", "none"])
            if choice == "other":
                long = number(int(rng.integers(5, 18)))
                long = long if len(long) < 12 or not luhn(long) else long[:-1] + str((int(long[-1]) + 1) % 10)
                text += pick(OTHERS).format(
                    a=int(rng.integers(1, 20)), b=int(rng.integers(0, 30)), c=int(rng.integers(0, 30)), y=int(rng.integers(1900, 2030)),
                    m=int(rng.integers(1, 13)), d=int(rng.integers(1, 29)), h=int(rng.integers(0, 24)), z=number(3), long=long,
                    hex="".join(f"{b:02x}" for b in rng.bytes(20)), w=plain(),
                )
            elif choice != "none":
                cue = pick(CUES[choice])
                text += cue + (" " if cue else "")
                value = private(choice)
                spans.append((len(text), KINDS.index(choice), len(text) + len(value)))
                text += value + pick(["", "", "", ".", ",", "###"])
            text += " "
        table.append((text, spans))
    return table


def train(table: list[tuple[str, list[tuple[int, int, int]]]]) -> crf.Crf:
    """Fit on a labelled table small enough for the driver: (text, [(start, kind, end)])."""
    body = [t.encode() for t, _ in table]
    chunk = words.chunk_of(body)
    found = chunk.runs(words.NOT_SPACE)
    tags = np.zeros(len(found), dtype=np.int64)
    for i, (text, spans) in enumerate(table):
        for start, kind, end in spans:
            low, high = (chunk.bounds[i] + len(text[:p].encode()) for p in (start, end))
            part = slice(found.first[i], found.first[i + 1])
            tags[part][(found.starts[part] < high) & (found.ends[part] > low)] = 1 + kind
    return crf.fit(features(chunk, found), tags, found.first, N_FEATURES, 1 + len(KINDS), rounds=60, ridge=1e-4)


@lru_cache(maxsize=1)
def built_in() -> crf.Crf:
    return train(examples())


# --- spans ---------------------------------------------------------------------------

_EDGE = ".,;:!?\"'<>[]{}|#$%&*="
_AT, _DOT = re.compile(r"(?i)[\s(\[]at[\s)\]]"), re.compile(r"(?i)[\s(\[]dot[\s)\]]")


def plausible(kind: int, text: str) -> bool:
    """The exact check behind an added span."""
    if kind == 0:
        return bool(_AT.search(text) and _DOT.search(text)) or next(emails(text), None) is not None
    if kind == 1:
        return text.count(".") == 3 and all(p.isascii() and p.isdigit() for p in text.split(".")) and is_ip(text)
    if kind == 2:
        return is_card(text) and not re.search(r"[^0-9 .\-]", text)
    return is_phone(text) and not re.search(r"[^0-9 ().+\-]", text)


#: Words that one value may have at most: a card's 19 digits.
MOST_WORDS = 19
#: Digits that are a whole number already, so that a new one may begin.
WHOLE = 9


def _digits(text: str) -> int:
    return sum(c.isascii() and c.isdigit() for c in text)


def _parts(kind: int, values: list[str]) -> list[tuple[int, int]]:
    """Neighbouring words of one kind, cut where one item must end and the next begin: after
    closing punctuation, before a new number's + or (, before an address's own `at`."""
    cuts, at_seen, digits = [0], False, 0
    for i, value in enumerate(values):
        new = i > cuts[-1] and values[i - 1][-1] in ",;:!?"
        if kind in (2, 3) and i > cuts[-1] and value[0] in "+(" and digits >= WHOLE:
            new = True
        if kind == 0 and i + 1 < len(values) and i > cuts[-1] and at_seen and values[i + 1].strip("()[]").lower() == "at":
            new = True
        if new:
            cuts.append(i)
            at_seen, digits = False, 0
        at_seen |= kind == 0 and value.strip("()[]").lower() == "at"
        digits += _digits(value) if kind in (2, 3) else 0
    return list(zip(cuts, [*cuts[1:], len(values)]))


def _items(kind: int, values: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of the plausible items among words of one part."""

    def good(i: int, j: int) -> bool:
        body = " ".join(values[i:j]).strip(_EDGE)
        return bool(body) and plausible(kind, body)

    bare = [v.strip("()[]").lower() for v in values]
    if kind == 0 and "at" in bare[1:]:
        # A spelled address: the word before `at`, the one after, and a word for each `dot`.
        i = bare.index("at", 1)
        end = i + 2
        while end + 1 < len(values) and bare[end] == "dot":
            end += 2
        if good(i - 1, end):
            yield i - 1, end
            return
    if len(values) <= MOST_WORDS and good(0, len(values)):
        yield 0, len(values)
        return
    i = 0
    while i < len(values):
        reach = range(i + 1, min(len(values), i + MOST_WORDS) + 1)
        # Numbers written one after the other: a phone number ends as soon as it may.
        end = next((j for j in (reach if kind == 3 else reversed(reach)) if good(i, j)), None)
        if end:
            yield i, end
        i = end or i + 1


def added_spans(
    chunk: words.Chunk, model: crf.Crf, fixed: dict[int, list[tuple[int, int, int]]] | None = None
) -> dict[int, list[tuple[int, int, int]]]:
    """{text: [(start, kind, end)]} of the field's spans in code points, after the check.

    Words that overlap a span of `fixed` are left out, and cut a run of words in two.
    """
    found = chunk.runs(words.NOT_SPACE)
    tags = model.decode(model.scores(features(chunk, found)), found.first)
    marked = tags > 0
    if not marked.any():
        return {}
    # Code points before each byte: continuation bytes count for none.
    points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    base = points[chunk.bounds]
    free = ~marked
    for text, spans in (fixed or {}).items():
        low, high = found.first[text], found.first[text + 1]
        if not marked[low:high].any():
            continue
        spans = sorted(spans)
        starts = np.array([s for s, _, _ in spans])
        reach = np.maximum.accumulate([e for _, _, e in spans])
        before = np.searchsorted(starts, points[found.ends[low:high]] - base[text])
        covered = (before > 0) & (reach[np.maximum(before - 1, 0)] > points[found.starts[low:high]] - base[text])
        marked[low:high] &= ~covered
        free[low:high] &= ~covered
    joined = np.zeros(len(tags), dtype=bool)
    joined[1:] = (tags[1:] == tags[:-1]) & (found.owner[1:] == found.owner[:-1]) & marked[1:] & marked[:-1]
    starts = np.flatnonzero(marked & ~joined)
    ends = np.flatnonzero(marked & ~np.append(joined[1:], False)) + 1
    out: dict[int, list] = {}
    for a, b in zip(starts, ends):
        text, kind = int(found.owner[a]), int(tags[a]) - 1
        if kind == 0 and a > found.first[text] and free[a - 1] and chunk.data[found.starts[a] : found.ends[a]].tobytes().strip(b"()[]").lower() == b"at":
            a -= 1  # the name before a spelled `at`
        values = [chunk.data[found.starts[i] : found.ends[i]].tobytes().decode("utf-8", "replace") for i in range(a, b)]
        for first, last in _parts(kind, values):
            for i, j in _items(kind, values[first:last]):
                low, high = found.starts[a + first + i], found.ends[a + first + j - 1]
                value = chunk.data[low:high].tobytes().decode("utf-8", "replace")
                body = value.strip(_EDGE)
                if body and plausible(kind, body):
                    start = int(points[low] - base[text]) + len(value) - len(value.lstrip(_EDGE))
                    out.setdefault(text, []).append((start, kind, start + len(body)))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find(docs: DataFrame, keep: list[str], text: str = "text", model: crf.Crf | None = None) -> DataFrame:
    """`keep`, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per text.

    Counts and hash are those of the fixed patterns. `spans` lists these and the field's,
    found in the words that no fixed span overlaps. A null text is empty and has none.
    Offsets are code points, ends exclusive. Repeated rows are searched alike, an empty table
    gives an empty one, and a long text takes time in proportion to its length. A kept column
    named as a result comes back with `_in` behind its name.
    """
    model = model or built_in()
    source = numbered(docs, keep, _text=raw(F.col(f"`{text}`")))
    kinds = dict(source.dtypes)
    own = [f"_k{i}" for i in range(len(keep))]
    names = [f"n_{k}" for k in KINDS]

    def work(batch):
        out: dict[str, list] = {n: [] for n in (*names, "base_sha256", "spans", "n_added")}
        for chunk in words.chunks(batch.column("_text")):
            has_digit = chunk.count(_PROBE, chunk.bounds[:-1], chunk.bounds[1:])
            fixed = {
                i: base_spans(chunk.data[chunk.bounds[i] : chunk.bounds[i + 1]].tobytes().decode("utf-8", "replace"))
                for i in np.flatnonzero(has_digit).tolist()
            }
            more = added_spans(chunk, model, {i: s for i, s in fixed.items() if s})
            for i in range(chunk.texts):
                base, added = fixed.get(i, []), more.get(i, [])
                for number, name in enumerate(names):
                    out[name].append(sum(kind == number for _, kind, _ in base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(base + added))
                out["n_added"].append(len(added))
        return {c: batch.column(c) for c in own} | out

    schema = [f"{c} {kinds[c]}" for c in own] + [f"{n} bigint" for n in names]
    results = (*names, "base_sha256", "spans", "n_added")
    schema += ["base_sha256 string", "spans string", "n_added bigint"]
    return map_batches(source, ", ".join(schema), work).toDF(*kept_names(keep, results), *results)


#: Bytes without which no fixed pattern can match.
_PROBE = np.zeros(256, dtype=bool)
_PROBE[list(b"@0123456789")] = True
