"""Rule figures and line labels against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from featmart.llm import crf, line_quality, queries, words
from featmart.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_figures(text):
    text = text or ""
    found = WORD.findall(text)
    grams = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    hit = {j for i in range(len(found) - 7) if grams[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        copies += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), copies, len(hit)


ODD = [None, "", " ", "\n\n", "a", "a\nb\na\n\n a\n a", "é  ü # | <x>", "one two three four five six seven eight " * 4,
       "no end\r\nno end\r\n", "x " * 50_000, "\n".join(f"line {i % 7} of the page goes on." for i in range(300))]


def plain_viterbi(scores, moves):
    best, back = scores[0].astype(float), []
    for row in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    tags = [int(best.argmax())]
    for step in back[::-1]:
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


def path_score(tags, scores, moves):
    return scores[np.arange(len(tags)), tags].sum() + moves[tags[:-1], tags[1:]].sum()


@pytest.mark.parametrize("spread", [0.5, 3, 20])
def test_decoding_is_the_best_path(spread):
    rng = np.random.default_rng(4)
    moves = rng.normal(size=(4, 4))
    sizes = [0, 1, 1, 2, 5, 0, 40, 300, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = (rng.normal(size=(first[-1], 4)) * spread).astype(np.float32)
    tags = crf.Crf(np.zeros((1, 4)), moves).decode(scores, first)
    for low, high in zip(first[:-1], first[1:]):
        if low < high:
            want = plain_viterbi(scores[low:high], moves)
            assert np.isclose(path_score(tags[low:high], scores[low:high], moves), path_score(np.array(want), scores[low:high], moves))


def test_fit_learns_a_chain():
    rng = np.random.default_rng(5)
    tags = np.repeat(rng.integers(0, 2, 300), 5)
    features = np.where(rng.random(len(tags)) < 0.75, tags, 1 - tags)[:, None]
    first = np.arange(0, len(tags) + 1, 50)
    model = crf.fit(features, tags, first, 2, 2)
    found = model.decode(model.scores(features), first)
    assert (found == tags).mean() > (features[:, 0] == tags).mean() + 0.05


def test_figures_of_documents_and_odd_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (0, rows[0][1])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, kept int")
    got = line_quality.judge(docs, None, ["doc_id"]).drop("kept", "content_words").collect()
    want = []
    for key, text in rows:
        figures = plain_figures(text)
        want.append((key, *figures, figures[0] < 20 or 100 * figures[4] > 30 * figures[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_keeps_good_and_drops_junk(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.PLANS["op9_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_stage_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "good words here " * 3, 2), (2, None, 3), (3, " ".join(f"w{i}" for i in range(30)), 4)],
                                 "doc_id bigint, text string, n_words int")
    kept = line_quality.keep_good(docs, None)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    assert line_quality.keep_good(docs.filter("false"), None).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert line_quality.train(docs, labels) is None


def test_words_stop_at_texts():
    texts = ["ab", "cd ef", "", "gh"]
    found = words.chunk_of(texts).runs(words.NOT_SPACE)
    assert found.per_text.tolist() == [1, 2, 0, 1]


def test_the_fit_reads_its_sample_in_chunks(spark, sf, monkeypatch):
    """The driver never holds the words of the whole sample; the model is that of one chunk."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen, own = [], line_quality.Lines
    monkeypatch.setattr(line_quality, "Lines", lambda chunk: seen.append(len(chunk.data)) or own(chunk))
    whole = line_quality.train(docs, labels)
    size, seen[:] = sum(seen), []
    monkeypatch.setattr(words, "CHUNK_BYTES", 20_000)
    parts = line_quality.train(docs, labels)
    assert sum(seen) == size and max(seen) <= 20_000 and len(seen) > 5
    assert np.array_equal(whole.weights, parts.weights) and np.array_equal(whole.moves, parts.moves)
