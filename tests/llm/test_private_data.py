"""Fixed patterns against the plain regular expressions, and the field's spans."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featmart.llm import private_data as pd_
from featmart.llm import queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    only = lambda t: re.sub("[^0-9]", "", t)
    spans = [("email", m) for m in EMAIL.finditer(text)]
    spans += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", m) for m in CARD.finditer(text) if 12 <= len(only(m[0])) <= 19 and plain_luhn(only(m[0]))]
    spans += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(only(m[0])) <= 15]
    order = ("email", "ip", "card", "phone")
    return sorted((m.start(), order.index(k), m.end()) for k, m in spans)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("aZ09125.@-+ ()%_é語"))))
def test_fixed_patterns(text):
    assert pd_.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", [
    "a@b@c.de x@y.z..w a.@-.- 1.2.3.4.5 256.1.1.1 007.08.9.255 4111 1111 1111 1111 4111-1111-1111-1112 +1 (212) 555-0100 +12 +123456789012345678",
    "5555555555554444 4111111111111111", "+1 23 +4567890123 4", "a@b.c@d.e", "+4111 1111 1111 1111", "é@b.c ü.x@y.de.",
])
def test_fixed_patterns_on_chosen_texts(text):
    assert pd_.base_spans(text) == plain(text)


def test_long_texts_take_linear_time():
    text = "a" * 1_000_000 + " x@y " + "1" * 500_000 + ".2.3 +" + "(" * 300_000 + "@" * 300_000
    assert pd_.base_spans(text) == []


def test_field_finds_other_forms_of_held_out_texts():
    table = pd_.examples(300, seed=123)
    model = pd_.built_in()
    chunk = pd_.words.chunk_of([t for t, _ in table])
    found = pd_.added_spans(chunk, model)
    truth = {(i, *s) for i, (_, spans) in enumerate(table) for s in spans}
    got = {(i, *s) for i, spans in found.items() for s in spans}
    assert len(truth & got) > 0.95 * len(truth) and len(truth & got) > 0.95 * len(got)
    cut = sum(len(spans) > len(pd_.base_spans(t)) for t, spans in table)
    assert cut > 20  # the fixed patterns alone miss some


def test_query_over_documents_and_odd_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(1000, None), (1001, ""), (None, "a@b.c"), (1002, "é語 mail ann at host dot com"), (1003, "x " * 200_000 + "+1 (212) 555-0100"), (1, "dup 1.2.3.4")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumnRenamed("text", "spans")
    got = pd_.find(rows, ["doc_id"], "spans").collect()
    texts = {}
    for key, text in [tuple(r) for r in rows.collect()]:
        texts.setdefault(key, []).append(text or "")
    assert len(got) == sum(map(len, texts.values()))
    for row in got:
        options = []
        for text in texts[row.doc_id]:
            base = plain(text)
            options.append((hashlib.sha256(pd_.listed(base).encode()).hexdigest(), [sum(k == n for _, k, _ in base) for n in range(4)], set(pd_.listed(base).split(",")) - {""}))
        mine = [o for o in options if o[0] == row.base_sha256]
        assert mine and [row.n_email, row.n_ip, row.n_card, row.n_phone] == mine[0][1]
        assert mine[0][2] <= set(row.spans.split(","))
    assert next(r for r in got if r.doc_id == 1002).spans == "email:8:27"
    assert sum(r.n_added for r in got if r.doc_id is not None and r.doc_id < 1000) <= 2
    assert len(queries.PLANS["op3_private_data"](spark, sf).collect()) == docs.count()


@pytest.mark.parametrize("text, want", [
    ("call 555-123-4567, 555-123-4568 now", ["555-123-4567", "555-123-4568"]),
    ("(555) 123-4567 (555) 123-4568", ["(555) 123-4567", "(555) 123-4568"]),
    ("anna at foo dot com bob at bar dot org", ["anna at foo dot com", "bob at bar dot org"]),
    ("write to anna at foo dot com and bob at bar dot co dot uk", ["anna at foo dot com", "bob at bar dot co dot uk"]),
])
def test_neighbours_of_one_kind_stay_apart(text, want):
    found = pd_.added_spans(pd_.words.chunk_of([text]), pd_.built_in())
    assert [text[s:e] for s, _, e in sorted(found[0])] == want


def test_words_under_a_fixed_span_cut_a_run():
    text = "call 555-123-4567 +1 (212) 555-0100, 555-123-4568 now"
    base = pd_.base_spans(text)
    assert base
    spans = pd_.added_spans(pd_.words.chunk_of([text]), pd_.built_in(), {0: base}).get(0, [])
    assert not any(s < e2 and s2 < e for s, _, e in spans for s2, _, e2 in base)


def test_many_spans_take_linear_time():
    text = " ".join(f"mail user{i} at site dot com or a{i}@b.de or call (555) 123-{i % 10000:04d}" for i in range(4000))
    base, model = pd_.base_spans(text), pd_.built_in()
    start = time.time()
    found = pd_.added_spans(pd_.words.chunk_of([text]), model, {0: base})[0]
    assert time.time() - start < 2 and len(text) > 250_000 and len(found) > 7000


def test_empty_table(spark):
    assert pd_.find(spark.createDataFrame([], "doc_id bigint, text string"), ["doc_id"]).count() == 0
