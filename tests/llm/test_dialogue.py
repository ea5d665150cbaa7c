"""Conversation repair against exhaustive search and plain code."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from featmart.llm import dialogue
from featmart.llm.queries import PLANS
from featmart.llm.tables import table

WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Uniform-cost search over (cost, letters): the first full and regular one wins."""
    marks = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, roles, turns = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, letters, turns
        tail = (at, "" if not roles else "s" if roles == "s" else "." + roles[-1])
        if tail in done:
            continue
        done.add(tail)
        ways = [(5, "I", at, "u", ("user", "")), (5, "I", at, "a", ("assistant", ""))]
        if at < len(rows):
            _, role, text = rows[at]
            ways.append((2, "D", at + 1, "", None))
            if marks[at] not in ("blank", "duplicate"):
                more = 5 * (marks[at] == "truncated")
                ways.append((more, "K", at + 1, role[:1] or "?", (role, text)))
                ways += [(1 + more, "R", at + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for price, letter, to, initial, turn in ways:
            new = roles + initial
            if re.fullmatch(r"(s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + price, letters + letter, to, new, turns + ((turn,) if turn else ())))
    raise AssertionError


def plain(rows):
    """The result columns for one conversation's turns in order."""
    marks = faults(rows)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, turns = cheapest(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, letters, digest)


def damage(rows):
    """(conv, turn, role, text) rows after the query's damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0])) for c, v in out.items()}


def random_turns(rng, size):
    roles = ["user", "assistant", "system", "tool", "", "ux"]
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", "odd ", "a. b"]
    turn, out = 0, []
    for _ in range(size):
        turn += int(rng.integers(1, 3))
        out.append((turn, roles[min(int(rng.integers(0, 9)) % 6, 5)], f"{texts[int(rng.integers(0, len(texts)))]}"))
    return out


def got_of(spark, conversations):
    rows = [(c, *t) for c, turns in conversations.items() for t in turns]
    np.random.default_rng(0).shuffle(rows)
    rows = [(None if c is None else int(c), None if t is None else int(t), r, x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    return {r.conv: tuple(r)[1:] for r in dialogue.summary(dialogue.repair(df)).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("turns", [4096, 3])
def test_random_conversations(spark, monkeypatch, turns):
    """Blocks of three turns make every longer conversation travel in pieces."""
    monkeypatch.setattr(dialogue, "BLOCK_TURNS", turns)
    rng = np.random.default_rng(6)
    conversations = {i: random_turns(rng, int(rng.integers(1, 14))) for i in range(120)}
    conversations[None] = random_turns(rng, 9)
    conversations[500] = random_turns(rng, 150)
    conversations[501] = [(None, "user", "Hi."), (None, "user", "Hi."), (4, "user", "Hi."), (4, "assistant", "So.")]
    assert got_of(spark, conversations) == {c: plain(t) for c, t in conversations.items()}


def test_one_conversation_of_most_rows(spark):
    rng = np.random.default_rng(2)
    conversations = {7: random_turns(rng, 30_000)} | {i: random_turns(rng, 5) for i in range(20, 40)}
    got = got_of(spark, conversations)
    codes, rows = [], conversations[7]
    marks = faults(rows)
    for (_, role, _), mark in zip(rows, marks):
        codes.append(dialogue.code_of(role[:1], mark in ("blank", "duplicate"), mark == "truncated"))
    letters, _ = dialogue.walk(bytes(codes), dialogue.END, dialogue.START, True)
    turns = dialogue.edited(letters, dialogue.START, [r for _, r, _ in rows], [t for _, _, t in rows])
    assert got[7][-2:] == (letters, hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest())
    assert got[7][5] == dialogue.before(bytes(codes), dialogue.END)[dialogue.START]
    assert {c: got[c] for c in range(20, 40)} == {c: plain(conversations[c]) for c in range(20, 40)}


def test_query_over_conversations(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in PLANS["op11_conversation_repair"](spark, sf).collect()}
    assert got == {c: plain(t) for c, t in damage(rows).items()}


def test_odd_tables(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string, part int, cost string"
    rows = [(1, 0, None, None, 1, "x"), (1, None, "user", "Hi.", 2, "y"), (None, None, None, None, 3, None), (2, 0, "user", "Hi " * 200_000, 4, ""),
            (3, 0, "user", "a.", 0, ""), (3, 0, "user", "a.", 0, "")]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv: (r.audit, r.cost, r.duplicate) for r in dialogue.summary(dialogue.repair(df)).collect()}
    # One user turn costs less to delete than to answer.
    assert got == {1: ("DD", 4, 0), None: ("D", 2, 0), 2: ("D", 2, 0), 3: ("DD", 4, 1)}
    assert dialogue.summary(dialogue.repair(df.filter("false"))).count() == 0
    # The query over a table with nulls, and with a conversation that loses all its turns.
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(drop, 0, "user", "Hi.", 0, ""), *rows], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: tuple(r)[1:] for r in PLANS["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert out[drop] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(out) == {drop, 1, 2, 3, None}
