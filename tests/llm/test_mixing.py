"""Budgets and passes of the mix against plain Python and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from featmart.llm import mixing, queries


def fill(budget, children):
    """{name: share} by handing out what is left until nothing changes (real numbers)."""
    got, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        left = budget - sum(got.values())
        full = {n: c for n, (w, c) in open_.items() if c <= left * w / total + 1e-9}
        if not full:
            got |= {n: left * w / total for n, (w, _) in open_.items()}
            break
        got |= full
        open_ = {n: v for n, v in open_.items() if n not in full}
    return got


WEIGHTS = {"domain": {"a": 5, "b": 1}, "lang": {"en": 3}, "source": {"s1": 2}}
LEAVES = [("a", "en", "s1", 1000), ("a", "en", "s2", 50), ("a", "de", "s1", 400), ("b", "en", "s1", 90_000), ("b", "?", "s3", 0), ("c", "en", "s9", 10)]


@pytest.mark.parametrize("percent", [0, 1, 5, 60, 100, 150])
def test_shortages_go_to_siblings_first(spark, percent):
    leaves = spark.createDataFrame(LEAVES, "domain string, lang string, source string, tokens bigint")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, WEIGHTS, percent, 2).collect()}
    total = sum(n for *_, n in LEAVES)
    want = {(): min(total * percent // 100, 2 * total)}
    for depth, level in enumerate(mixing.LEVELS):
        deeper = {}
        for path, budget in want.items():
            names = {leaf[depth] for leaf in LEAVES if leaf[:depth] == path}
            children = {n: (WEIGHTS[level].get(n, 1), 2 * sum(x[3] for x in LEAVES if x[: depth + 1] == (*path, n))) for n in names}
            deeper |= {(*path, n): v for n, v in fill(budget, children).items()}
        want = deeper
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 4 for k in want), (got, want)
    assert all(got[(*leaf[:3],)] <= 2 * leaf[3] for leaf in LEAVES)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, epoch int").repartition(3)


ODD = [(i, "w " * (i % 13), ["en", "de", None][i % 3], f"src{i % 4}", 1) for i in range(300)]
ODD += [(7, "w w", "en", "src3", 1), (None, "x y z", "en", "src0", 1), (None, "x y", "en", "src0", 1), (900, None, "en", None, 1),
        (901, "", "en", "src1", 1), (902, "long " * 100_000, "fr", "src1", 1)]


@pytest.mark.parametrize("percent,epochs,digits", [(60, 2, 4), (130, 3, 1), (5, 1, 2), (0, 1, 4)])
def test_mixture_equals_sql(spark, monkeypatch, percent, epochs, digits):
    monkeypatch.setattr(mixing, "SLICE_DIGITS", digits)
    weights = {"domain": {"web": 3}, "lang": {"en": 2, "fr": 1}}
    got = mixing.mixture(frame(spark, ODD), F.expr(queries.DOMAIN_SQL), weights, percent, epochs, 5)
    db = duckdb.connect()
    documents = frame(spark, ODD).toPandas()  # noqa: F841
    want = db.sql(mixing.mixture_sql(queries.DOMAIN_SQL, weights, percent, epochs, 5))
    assert got.columns == want.columns
    rows = got.collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)
    assert all(0 < r.take_tokens <= r.n_tokens for r in rows)


def test_stage_takes_the_same_documents_whole(spark):
    docs = frame(spark, ODD)
    args = (F.expr(queries.DOMAIN_SQL), {"lang": {"en": 2}}, 50, 2, 5)
    kept = mixing.mix(docs, *args)
    assert kept.columns == docs.columns
    taken = mixing.mixture(docs, *args).collect()
    want = sorted(t for r in taken for t in (x for x in ODD if x[0] == r.doc_id and (x[2] or "?") == r.lang and (x[3] or "?") == r.source and x[1] and x[1].split()) for t in [str(t)])
    assert sorted(str(tuple(r)) for r in kept.collect()) == want


def test_empty_table(spark):
    docs = frame(spark, ODD).filter("false")
    args = (F.expr(queries.DOMAIN_SQL), {}, 50, 1, 5)
    assert mixing.mixture(docs, *args).count() == 0 and mixing.mix(docs, *args).count() == 0
