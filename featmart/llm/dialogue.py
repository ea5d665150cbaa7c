"""Conversation structure: faults of each turn, and the cheapest edits that make it regular.

Roles in order must read `(s?(ua)+)?` by their initials. A turn is kept (0), given the other
role (1) or deleted (2); an empty turn is inserted (5); a truncated turn that stays adds 5;
blank and repeated turns must go. Of the cheapest edits those whose initials D, I, K, R come
first in ASCII are taken.

The cost of the turns from some point on depends on one of four states, so it is a vector of
four numbers. They are computed backwards, and only those at checkpoints are held: every
root of n turns inside a block, and at the ends of blocks. Walking forward, the vectors of one
interval are computed again from its checkpoint, and each step takes the first letter that
loses nothing. Between blocks of a long conversation travel only the block's 4 x 4 costs
backwards and its state forwards, so that blocks are computed apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.llm.tables import written

#: States: nothing yet, after a system turn, after a user's, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the one turn that may be inserted, or that any turn may become.
NEXT = (USER, USER, ASSISTANT, USER)
#: What a turn's initial leads to, where it may be kept.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
#: Vector after the last turn: an empty or answered conversation may end.
END = (0, 2 * INSERT, INSERT, 0)
#: Turns and bytes of a block; one longer turn is a block of its own.
BLOCK_TURNS, BLOCK_BYTES = 4096, 1 << 20

#: Turn codes: 0 must be deleted; else 1 + 2 * (place of the initial in `INITIALS`) + truncated.
INITIALS = "sua"


def code_of(initial: str, required: bool, truncated: bool) -> int:
    if required:
        return 0
    place = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (place if place >= 0 else len(INITIALS)) + truncated


def _moves(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the ways to take a turn: letter, cost and next state, in ASCII order."""
    place, truncated = divmod(code - 1, 2)
    extra = TRUNCATED * truncated
    out = []
    for state in range(4):
        ways = [("D", DELETE, state)]
        if code:
            if place < len(INITIALS) and state in KEPT[INITIALS[place]]:
                ways.append(("K", extra, KEPT[INITIALS[place]][state]))
            ways.append(("R", REROLE + extra, NEXT[state]))
        out.append(ways)
    return out


MOVES = [_moves(code) for code in range(1 + 2 * (len(INITIALS) + 1))]

Vector = tuple[int, int, int, int]


def back(code: int, after: Vector) -> Vector:
    """Cost from before a turn, inserts included, given the costs after it."""
    plain = [min(cost + after[to] for _, cost, to in ways) for ways in MOVES[code]]
    user, assistant = min(plain[USER], INSERT + plain[ASSISTANT]), min(plain[ASSISTANT], INSERT + plain[USER])
    return min(plain[START], INSERT + user), min(plain[SYSTEM], INSERT + user), user, assistant


def before(codes: bytes, after: Vector) -> Vector:
    for code in reversed(codes):
        after = back(code, after)
    return after


def crossing(codes: bytes) -> list[Vector]:
    """Costs before the turns, one vector for each state after them."""
    return [before(codes, tuple(0 if s == t else FAR for s in range(4))) for t in range(4)]


def joined(cross: list[Vector], after: Vector) -> Vector:
    """Costs before a block of these crossing costs, from those after it."""
    return tuple(min(min(cross[t][s] + after[t] for t in range(4)), FAR) for s in range(4))


def walk(codes: bytes, after: Vector, state: int, last: bool) -> tuple[str, int]:
    """Letters from `state` before the turns on, and the state behind them.

    Inserts before the block's end stay with the turn that follows, so those after the last
    turn are written only where the conversation ends.
    """
    size = max(1, isqrt(len(codes)))
    marks = list(range(0, len(codes), size))
    held = {len(codes): after}
    vector = after
    for low in reversed(marks):
        vector = held[low] = before(codes[low : low + size], vector)
    letters = []
    for low in marks:
        high = min(low + size, len(codes))
        vectors = [held[high]]
        for code in reversed(codes[low:high]):
            vectors.append(back(code, vectors[-1]))
        for code in codes[low:high]:
            here, there = vectors.pop(), vectors[-1]
            while True:
                letter, cost, to = MOVES[code][state][0]
                if cost + there[to] == here[state]:
                    break
                if INSERT + here[NEXT[state]] == here[state]:
                    letters.append("I")
                    state = NEXT[state]
                    continue
                letter, cost, to = next(w for w in MOVES[code][state][1:] if w[1] + there[w[2]] == here[state])
                break
            letters.append(letter)
            state = to
    while last and state not in (START, ASSISTANT):
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def cost_of(letters: str, codes: bytes) -> int:
    """Cost of edits over the turns they were found for."""
    total, turns = 0, iter(codes)
    for letter in letters:
        if letter == "I":
            total += INSERT
            continue
        code = next(turns)
        if letter == "D":
            total += DELETE
        else:
            total += REROLE * (letter == "R") + TRUNCATED * ((code - 1) % 2)
    return total


def edited(letters: str, state: int, roles: list[str], texts: list[str]) -> list[dict[str, str]]:
    """The turns that the edits leave."""
    out, turns = [], iter(zip(roles, texts))
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[role[:1]][state]
        else:
            state = NEXT[state]
            role = "user" if state == USER else "assistant"
        out.append({"role": role, "text": text})
    return out


_STATS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
_BLOCK = (
    "part int, seq bigint, single boolean, codes binary, roles array<string>, texts array<string>, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, low bigint, high bigint, "
    "first_turn bigint, last_turn bigint, first_initial string, last_initial string"
)
_PIECE = (
    "part int, seq bigint, single boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, "
    "low bigint, high bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, "
    "cost bigint, audit string, turns array<struct<role: string, text: string>>"
)


class _Block:
    """Turns of one conversation in order, until they are enough."""

    def __init__(self, conv, part: int, seq: int, whole: bool):
        self.row = {"conv": conv, "part": part, "seq": seq, "single": whole, "codes": bytearray(), "roles": [], "texts": []}
        self.row |= dict.fromkeys(_STATS, 0) | dict.fromkeys(("low", "high", "first_turn", "last_turn", "first_initial", "last_initial"))
        self.bytes = 0

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        row = self.row
        if fault:
            row[fault] += 1
        initial = role[:1]
        if row["codes"]:
            row["illegal"] += row["last_initial"] + initial not in LEGAL
        else:
            row["first_initial"], row["first_turn"] = initial, turn
        if turn is not None:
            row["n_turns"] += row["high"] != turn
            row["low"] = turn if row["low"] is None else row["low"]
            row["high"] = turn
        row["last_initial"], row["last_turn"] = initial, turn
        row["codes"].append(code_of(initial, fault in ("blank", "duplicate"), fault == "truncated"))
        row["roles"].append(role)
        row["texts"].append(text)
        self.bytes += len(text)

    @property
    def full(self) -> bool:
        return len(self.row["codes"]) >= BLOCK_TURNS or self.bytes >= BLOCK_BYTES


def _mapped(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[dict]], rows: int = 64) -> DataFrame:
    """`work` over each partition's rows in order, as dictionaries."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    layout = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in work(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, schema=layout)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=layout)

    return df.mapInArrow(run, kind)


def _pack(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of sorted turns. A conversation of one block that neither begins nor ends its
    partition is known to be whole."""
    part, seq = TaskContext.get().partitionId(), 0
    block, previous, first = None, None, True
    for row in rows:
        key = (row["conv"], row["turn"], row["h1"], row["h2"])
        if previous is None or previous[0] != key[0]:
            if block:
                yield block.row
                first, seq = False, seq + 1
            block = _Block(row["conv"], part, seq, not first)
            previous = None
        elif block.full:
            block.row["single"] = False
            yield block.row
            seq += 1
            block = _Block(row["conv"], part, seq, False)
        fault = "blank" if row["blank"] else "duplicate" if row["later"] or key == previous else "truncated" if row["truncated"] else None
        block.add(row["turn"], row["role"], row["text"], fault)
        previous = key
    if block:
        block.row["single"] = False
        yield block.row


def _blocks(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The conversations' turns in order, packed and written."""
    base = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
    ).withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(7), "role", "text")})
    # Contents of several turns, with the first; equal turns of one number meet in the sort.
    again = (
        base.groupBy("conv", "h1", "h2")
        .agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"), F.max("turn").alias("most"))
        .filter((F.col("none") & F.col("least").isNotNull()) | (F.col("least") < F.col("most")))
        .select(F.col("conv").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "none", "least")
    )
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    later = F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("least")))
    rows = base.join(written(again, "repeated-turns"), same, "left").select(
        "conv", "turn", "role", "text", "h1", "h2", F.coalesce(later, F.lit(False)).alias("later"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    order = ["conv", "turn", "h1", "h2"]
    kind = dict(rows.dtypes)["conv"]
    return written(_mapped(rows.repartitionByRange(*order).sortWithinPartitions(*order), f"conv {kind}, {_BLOCK}", _pack), "turn-blocks")


def _in_order(df: DataFrame, backwards: bool = False) -> DataFrame:
    order = [F.col(c).desc() if backwards else F.col(c).asc() for c in ("part", "seq")]
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _chained(rows: Iterator[dict], start, step: Callable) -> Iterator[dict]:
    """Carry a value along each conversation's blocks, as `step` changes it."""
    conv, value, first = None, start, True
    for row in rows:
        if first or row["conv"] != conv:
            conv, value, first = row["conv"], start, False
        out, value = step(row, value)
        yield out


def _ends(blocks: DataFrame) -> DataFrame:
    """For each block the costs after it, whether it is the last, and its first state."""

    def cross(rows):
        for row in rows:
            yield row | {"cross": [list(v) for v in crossing(bytes(row["codes"]))]}

    def after(row, value):
        out = {c: row[c] for c in ("conv", "part", "seq")} | {"after": list(value or END), "last": value is None}
        return out, joined(row["cross"], value or END)

    def leads(rows):
        for row in rows:
            ends = [walk(bytes(row["codes"]), tuple(row["after"]), s, False)[1] for s in range(4)]
            yield {c: row[c] for c in ("conv", "part", "seq")} | {"ends": ends}

    def state(row, value):
        return {"part": row["part"], "seq": row["seq"], "state": value}, row["ends"][value]

    kind = dict(blocks.dtypes)["conv"]
    codes = blocks.select("conv", "part", "seq", "codes")
    crossed = _mapped(codes, f"conv {kind}, part int, seq bigint, codes binary, cross array<array<bigint>>", cross).drop("codes")
    ends = written(
        _mapped(
            _in_order(crossed, True), f"conv {kind}, part int, seq bigint, after array<bigint>, last boolean",
            lambda rows: _chained(rows, None, after),
        ),
        "block-ends",
    ).drop("conv")
    led = _mapped(codes.join(ends, ["part", "seq"]), f"conv {kind}, part int, seq bigint, ends array<int>", leads)
    states = _mapped(_in_order(led), "part int, seq bigint, state int", lambda rows: _chained(rows, START, state))
    return ends.join(written(states, "block-states"), ["part", "seq"])


def _pieces(blocks: DataFrame) -> DataFrame:
    def solve(rows):
        for row in rows:
            codes = bytes(row["codes"])
            after, last, state = tuple(row.get("after") or END), row.get("last", True), row.get("state", START)
            letters, _ = walk(codes, after, state, last)
            kept = {c: row[c] for c in row if c not in ("codes", "roles", "texts", "after", "last", "state")}
            yield kept | {
                "cost": cost_of(letters, codes), "audit": letters,
                "turns": edited(letters, state, row["roles"], row["texts"]),
            }

    return _mapped(blocks, f"conv {dict(blocks.dtypes)['conv']}, {_PIECE}", solve)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired conversations in pieces: `conv`, the piece's place (`part`, `seq`), whether it
    is the whole conversation (`single`), counts of its faults, `cost`, `audit` (the edits'
    initials) and `turns` (role and text of what is left).

    Turns go by number, nulls first; equal numbers by a hash of role and text, so that equal
    rows are neighbours. Null roles and texts are one space; a null conversation is one of
    its own. A turn whose role and text came earlier is repeated. Other columns are not read;
    an empty table gives an empty one. A conversation may hold any share of all rows: rows
    are sorted over many tasks, and its blocks are computed apart.
    """
    blocks = _blocks(turns, conv, turn, role, text)
    whole = _pieces(blocks.filter("single"))
    split = blocks.filter("NOT single")
    parted = _pieces(split.join(_ends(split), ["part", "seq"]).select(*blocks.columns, "after", "last", "state"))
    # As constants, so that a filter on them leaves one side out of the plan.
    return whole.withColumn("single", F.lit(True)).unionByName(parted.withColumn("single", F.lit(False)))


def _joined_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def summary(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: `conv`, `gaps` (missing turn numbers), `blank`,
    `duplicate`, `truncated`, `illegal`, `cost`, `audit` and `repaired_sha256`, the digest of
    `role:text` of all turns left, joined by newlines.

    A conversation's pieces are read in order, one at a time, by one task: a digest takes its
    bytes one after the other. Whole conversations are not moved.
    """
    missing = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0))
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    whole = pieces.filter("single").select(
        "conv", missing.alias("gaps"), *names, "audit", F.sha2(_joined_text(F.col("turns")).cast("binary"), 256).alias("repaired_sha256")
    )

    def joined_rows(rows):
        conv, total, digest, size, audit, last = None, None, None, 0, [], None

        def result():
            gaps = 0 if total["high"] is None else total["high"] - total["low"] + 1 - total["n_turns"]
            return {"conv": conv, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | {n: total[n] for n in names}

        for row in rows:
            if total is None or row["conv"] != conv:
                if total is not None:
                    yield result()
                conv, digest, size, audit, last = row["conv"], hashlib.sha256(), 0, [], None
                total = dict.fromkeys((*names, "n_turns"), 0) | {"low": None, "high": None}
            for name in (*names, "n_turns"):
                total[name] += row[name]
            if last is not None:
                total["illegal"] += last["last_initial"] + row["first_initial"] not in LEGAL
                total["n_turns"] -= last["last_turn"] is not None and last["last_turn"] == row["first_turn"]
            total["low"] = row["low"] if total["low"] is None else total["low"]
            total["high"] = row["high"] if row["high"] is not None else total["high"]
            if row["turns"]:
                digest.update((("\n" if size else "") + row["body"]).encode())
                size += 1
            audit.append(row["audit"])
            last = {"last_initial": row["last_initial"], "last_turn": row["last_turn"]}
        if total is not None:
            yield result()

    kind = dict(pieces.dtypes)["conv"]
    schema = f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    rest = pieces.filter("NOT single").withColumn("body", _joined_text(F.col("turns"))).withColumn("turns", F.size("turns"))
    return whole.unionByName(_mapped(_in_order(rest), schema, joined_rows))
