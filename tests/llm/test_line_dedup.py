"""Widespread lines against plain Python."""

import pytest

from featmart.llm import line_dedup

BLANK = " \t\n\x0b\f\r"


def plain(rows, sites):
    seen = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(BLANK):
                seen.setdefault(line.strip(BLANK), set()).add(site or "?")
    gone = {line for line, where in seen.items() if len(where) >= sites}
    out = []
    for key, text, _ in rows:
        lines = (text or "").split("\n")
        stay = None if text is None else "\n".join(x for x in lines if x.strip(BLANK) not in gone)
        out.append((key, stay, sum(bool(x.strip(BLANK)) for x in lines), sum(x.strip(BLANK) in gone for x in lines)))
    return sorted(out, key=str)


def run(spark, rows, sites):
    docs = spark.createDataFrame([(k, t, s, 9) for k, t, s in rows], "doc_id bigint, text string, source string, n_lines int").repartition(4)
    got = line_dedup.remove_boilerplate(docs, sites)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "n_lines_in", "n_lines", "n_removed"])
    return sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)


@pytest.mark.parametrize("sites", [2, 5, 40])
def test_equal_to_plain(spark, sites):
    rows = [(i, f"own line {i}\nshared by {i % 5}\n  everywhere \n\n twice", f"s{i % 60}") for i in range(240)]
    rows += [(1, None, "s1"), (2, "", "s2"), (None, "everywhere", None), (None, "everywhere", None), (3, " \t\r\n", "s3"),
             (4, "everywhere\r\n" + "deep line\n" * 20_000 + "shared by 1", "s4"), (5, "é  語", "s5")]
    assert run(spark, rows, sites) == plain(rows, sites)


def test_empty_table(spark):
    assert run(spark, [], 5) == []
