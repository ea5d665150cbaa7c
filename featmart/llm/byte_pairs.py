"""Byte-level BPE in built-in functions: ranked merges folded over the bytes of words.

A vocabulary gives byte strings their ranks, which are also their ids. Each match of the
pattern is encoded by itself: it starts as its bytes, and the neighbours whose join has the
lowest rank merge until none has one. What pairs merge into, in the order of ranks, is a
literal of the plan: texts picked by the pair's checksum. The encodings of the
corpus's most frequent words are another; all other words are folded where they stand, so
that words are never shuffled.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.llm.tables import kept_names, prepare

#: Frequent words whose encoding is looked up, and the texts in which they are counted, about.
#: Both decide the work, never a result: all other words are encoded where they stand.
FREQUENT, SAMPLED = 1 << 18, 1 << 15
#: Character of id 0: none of the characters below.
FIRST = 0x100
#: What stands between word and code in the texts of `Codes`, and before the ids of a match that
#: has no more merges.
BEFORE_CODE, DONE = "\1", "!"
#: Bits between the two places of a key in a literal map.
SHIFT = 12
#: Characters up to which a match's pairs are cut out one by one; longer ones go through a pattern.
SHORT = 64
#: Characters of a plan's description: literal maps would fill it.
PLAN_TEXT = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 byte string and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(key): int(rank) for key, rank in (line.split() for line in lines if line.strip())}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once: lambdas do not share subexpressions.

    A fold over nothing: unlike an array of the value, it is neither built nor copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, use)


class Lookup:
    """A literal map of the plan from pairs of characters to a character: an array of texts, each
    a value and its pair, picked by the pair's checksum, and an array of small maps for the pairs
    whose place is taken.

    `self.slots` and `self.rest` are to be bound by `let` once a row, so that tasks get one copy.
    """

    def __init__(self, entries: Iterable[tuple[str, str]]):
        entries = list(entries)
        slots: list[str | None] = [None] * (1 << (4 * len(entries)).bit_length())
        self.mask = len(slots) - 1
        taken = []
        for pair, value in entries:
            place = zlib.crc32(pair.encode())
            if slots[place & self.mask] is None:
                slots[place & self.mask] = value + pair
            else:
                taken.append((place, pair, value + pair))
        rest: list[dict[str, str]] = [{} for _ in range(1 << len(taken).bit_length())]
        self.rest_mask = len(rest) - 1
        for place, pair, found in taken:
            rest[place >> SHIFT & self.rest_mask][pair] = found
        # Read from text once, when the plan is made: constants are folded.
        self.slots = F.from_json(F.lit(json.dumps(slots)), "array<string>")
        self.rest = F.from_json(F.lit(json.dumps(rest)), "array<map<string,string>>")

    def find(self, slots: Column, rest: Column) -> Callable[[Column], Column]:
        """The function from a pair to its value and the pair in one text, or null, over the
        bound arrays. Found texts have the order of their values."""

        def other(pair: Column) -> Column:
            place = F.shiftright(F.crc32(pair.cast("binary")), SHIFT).bitwiseAND(F.lit(self.rest_mask))
            return F.try_element_at(F.get(rest, place), pair)

        def value(pair: Column) -> Column:
            slot = F.get(slots, F.crc32(pair.cast("binary")).bitwiseAND(F.lit(self.mask)))
            # An empty place has no other pair in the maps.
            return let(slot, lambda e: F.when(F.endswith(e, pair), e).when(e.isNotNull(), other(pair)))

        return value


class Codes:
    """A larger literal map, from word to its ids as decimal text, with the words' hashes by
    Spark: an array of strings, each of one word. A word has two places; where both are taken
    by words before it, it is left out."""

    def __init__(self, entries: Iterable[tuple[str, int, str]], limit: int):
        self.mask = (1 << limit.bit_length()) - 1
        slots: list[str | None] = [None] * (self.mask + 1)
        for word, place, code in entries:
            for at in (place & self.mask, (place & 0xFFFFFFFF) >> SHIFT & self.mask):
                if slots[at] is None:
                    slots[at] = f"{word}{BEFORE_CODE}{code}"
                    break
        self.slots = F.from_json(F.lit(json.dumps(slots)), "array<string>")

    def find(self, slots: Column) -> Callable[[Column], Column]:
        """The function from word to code, or null, over the bound slots."""

        def value(word: Column) -> Column:
            def at(place: Column) -> Column:
                slot = F.get(slots, place.bitwiseAND(F.lit(self.mask)))
                return let(slot, lambda entry: F.when(F.startswith(entry, F.concat(word, F.lit(BEFORE_CODE))), entry))

            found = F.coalesce(at(F.hash(word)), at(F.shiftrightunsigned(F.hash(word), SHIFT)))
            return F.substring_index(found, BEFORE_CODE, -1)

        return value


def characters(text: Column) -> Column:
    """The characters of a text, in order."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def splits(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]]:
    """For each entry of two bytes or more, the two parts whose merge makes it from bytes.

    Every entry must be reached by merges of ranks up to its own. Then, once all merges below
    an entry's rank are done, its bytes are in these two parts wherever they are whole parts:
    no other pair of parts makes it, and no merge brings forth a pair of a lower rank. So all
    pairs of the lowest rank may merge at once, from the left.
    """
    out = {}
    for entry, rank in ranks.items():
        parts = [entry[i : i + 1] for i in range(len(entry))]
        while len(parts) > 1:
            found, at = min((ranks.get(parts[i] + parts[i + 1], rank + 1), i) for i in range(len(parts) - 1))
            if found > rank:
                raise ValueError(f"merges do not reach {entry!r}")
            if len(parts) == 2:
                out[entry] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return out


def character(rank: int) -> str:
    """The character that stands for an id; characters have the order of the ids."""
    return chr(FIRST + rank)


@dataclass
class Vocabulary:
    """Ranks of byte strings and the pattern, as the plan uses them.

    A match is folded as a string of one character an id, from the characters of its bytes
    on: a merge replaces a pair of characters by one.
    """

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self):
        total = len(self.ranks)
        if sorted(self.ranks.values()) != list(range(total)) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("ranks must be 0 to n - 1, with an entry for every byte")
        if total > 0xD800 - FIRST:
            raise ValueError("ranks go beyond the characters of two bytes")
        pairs = {
            character(self.ranks[left]) + character(self.ranks[right]): character(self.ranks[entry])
            for entry, (left, right) in splits(self.ranks).items()
        }
        self.merged = Lookup(pairs.items())
        self.bytes = "".join(chr(b) for b in range(256)), "".join(character(self.ranks[bytes([b])]) for b in range(256))
        by_rank = sorted(self.ranks, key=self.ranks.__getitem__)
        self.pieces = F.from_json(F.lit(json.dumps([key.hex() for key in by_rank])), "array<string>")
        #: Ids as little-endian unsigned 32-bit integers.
        self.packed = F.from_json(F.lit(json.dumps([i.to_bytes(4, "little").hex() for i in range(total)])), "array<string>")

    def fold(self, word: Column, merged: Callable[[Column], Column]) -> Column:
        """The ids of one match as decimal text, comma-joined; `merged` finds what a pair becomes."""

        def step(ids: Column) -> Column:
            # Every two neighbours, overlaps included.
            each = F.transform(F.sequence(F.lit(1), F.length(ids) - 1), lambda i: let(ids.substr(i, F.lit(2)), merged))
            long = F.transform(F.regexp_extract_all(ids, F.lit("(?s)(?=(..))"), F.lit(1)), merged)
            found = F.when(F.length(ids) > SHORT, long).when(F.length(ids) > 1, each)

            def replaced(low: Column) -> Column:
                shorter = F.replace(ids, low.substr(2, 2), low.substr(1, 1))
                return F.coalesce(shorter, F.concat(F.lit(DONE), ids))

            return F.when(F.startswith(ids, F.lit(DONE)), ids).otherwise(let(F.array_min(found), replaced))

        def merges(start: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.length(start)), start, lambda ids, _: step(ids), decimals)

        def decimals(done: Column) -> Column:
            ids = characters(done.substr(F.lit(2), F.length(done)))
            return F.array_join(F.transform(ids, lambda c: (F.ascii(c) - F.lit(FIRST)).cast("string")), ",")

        return let(F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), *self.bytes), merges)

    def codes(self, words: Column, often: Codes | None = None) -> Column:
        """The ids of each of an array of matches as decimal text, comma-joined; those of
        `often` are looked up."""

        def with_merges(merged: Callable[[Column], Column]) -> Column:
            if often is None:
                return F.transform(words, lambda word: self.fold(word, merged))

            def with_known(slots: Column) -> Column:
                find = often.find(slots)
                return F.transform(words, lambda word: F.coalesce(find(word), self.fold(word, merged)))

            return let(often.slots, with_known)

        return let(self.merged.slots, lambda slots: let(self.merged.rest, lambda rest: with_merges(self.merged.find(slots, rest))))

    def ids(self, codes: Column) -> Column:
        """All ids of a text's matches in order."""
        none = F.array().cast("array<int>")
        return let(codes, lambda codes: F.when(F.size(codes) == 0, none).otherwise(F.split(F.array_join(codes, ","), ",").cast("array<int>")))

    def words(self, text: Column) -> Column:
        """Matches of the pattern."""
        return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(self.pattern), F.lit(0))

    def pack(self, ids: Column) -> Column:
        """Ids as the bytes of little-endian unsigned 32-bit integers."""
        return F.unhex(let(self.packed, lambda packed: F.array_join(F.transform(ids, lambda i: F.get(packed, i)), "")))

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids' entries, end to end."""
        return F.unhex(let(self.pieces, lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))


def java_pattern(spark: SparkSession, pattern: str) -> str:
    r"""The pattern for Java's matcher, with the characters of tiktoken's classes.

    There \s is Unicode's white space, and its letters and numbers may be of a later Unicode
    version than Java's: those that Java does not know yet are added to the classes.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ranks = {bytes([b]): b for b in range(256)}
    known = {}
    for name in ("L", "N"):
        probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{name}}}", mergeable_ranks=ranks, special_tokens={})
        known[name] = bytes(probe.encode_ordinary(every)).decode()
    row = spark.range(1).select(*[F.regexp_replace(F.lit(v), rf"\p{{{k}}}+", "").alias(k) for k, v in known.items()]).first()
    for name in known:
        points = sorted(map(ord, row[name]))
        starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
        ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
        new = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends))
        # One range is tested before the many; inside a class the same text is a union, so
        # one form serves both places.
        gate = rf"[\x{{{min(points):X}}}-\x{{10FFFF}}&&[{new}]]" if points else ""
        pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}{gate}]" if new else rf"\p{{{name}}}")
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Vocabulary:
    """A vocabulary from its rank file, for a pattern that Java's matcher reads."""
    return Vocabulary(read_ranks(path), pattern)


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """The rank file at `path` with tiktoken's pattern."""
    prepare(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    return load(path, _java_pattern(spark, pattern))


_patterns: dict[str, str] = {}


def _java_pattern(spark: SparkSession, pattern: str) -> str:
    if pattern not in _patterns:
        _patterns[pattern] = java_pattern(spark, pattern)
    return _patterns[pattern]


def frequent(docs: DataFrame, known: Vocabulary, text: str, limit: int) -> Codes:
    """Encodings of the most frequent words of a sample of texts, at most `limit` (ties by
    the word)."""
    step = max(1, -(-docs.count() // SAMPLED))
    sample = docs.select(F.col(f"`{text}`").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    words = sample.select(F.explode(known.words(F.col("text"))).alias("word"))
    top = words.groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(limit)
    coded = top.select("word", F.hash("word").alias("place"), F.get(known.codes(F.array("word")), F.lit(0)).alias("code"))
    return Codes((tuple(r) for r in coded.toLocalIterator() if BEFORE_CODE not in r["word"]), limit)


def encode(
    docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", limit: int = FREQUENT
) -> DataFrame:
    """The columns `keep`, and `ids`: each text's ids as the tiktoken library gives them
    without special tokens.

    A null text is empty and has no ids. Repeated rows and ids stay as they are; an empty
    table gives an empty one. A step merges all pairs of one rank, so a very long word takes
    as many steps as it uses ranks. A kept column named `ids` comes back as `ids_in`.
    """
    known = vocabulary(docs.sparkSession, path, pattern)
    often = frequent(docs, known, text, limit)
    ids = known.ids(known.codes(known.words(F.col(f"`{text}`")), often))
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept_names(keep, ["ids"]))], ids.alias("ids"))


def decode(coded: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns `keep`, `n_tokens`, `packed` (the ids as little-endian unsigned 32-bit
    integers) and `decoded`, the bytes they stand for. Null ids count as none. A kept column
    named as a result comes back with `_in` behind its name."""
    names = kept_names(keep, ("n_tokens", "packed", "decoded"))
    known = vocabulary(coded.sparkSession, path, pattern)
    column = F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))
    return coded.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.size(column).cast("long").alias("n_tokens"),
        known.pack(column).alias("packed"), known.decode(column).alias("decoded"),
    )
