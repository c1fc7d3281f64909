"""Context sums against plain counting, the network's calibration, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from odd_texts import ODD_TEXTS

import tallybook.llm.quality as module
from tallybook.llm.arrays import text_slices
from tallybook.llm.quality import fit, score, temperature, train, word_vectors
from tallybook.llm.queries import op4_quality


def test_context_sums_equal_plain_counting(documents):
    texts = ["a b c a", "ERTION!! b", "", None, "12 a,b", "a b c a"]
    vectors = word_vectors(documents(texts))
    places, signs = module._random_vectors()
    table = np.zeros((module.BUCKETS, module.SIZE))
    for text in texts:
        tokens, _ = module._tokens(next(text_slices(pa.array([text]))))
        for i, a in enumerate(tokens):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(tokens):
                    np.add.at(table[a], places[tokens[j]], signs[tokens[j]])
    length = np.linalg.norm(table, axis=1, keepdims=True)
    np.testing.assert_allclose(vectors, table / np.where(length > 0, length, 1), atol=1e-6)


def test_tokens_are_runs_of_one_kind():
    def cut(text):
        texts = next(text_slices(pa.array([text])))
        return module._tokens(texts)[0]

    assert len(cut("abc12!! x")) == 4
    assert list(cut("abc12!! x")) == [cut(t)[0] for t in ("abc", "12", "!!", "x")]
    assert cut("ABC")[0] != cut("abc")[0]
    assert len(cut("")) == len(cut(" \n")) == 0


def test_features_do_not_depend_on_slices(documents):
    vectors = word_vectors(documents(["some words here", "and 1 more!!"]))
    texts = ["some words", "", "more more more", " ", "1!! here"]
    whole = module._features(next(text_slices(pa.array(texts))), vectors)
    parts = [module._features(next(text_slices(pa.array([t]))), vectors) for t in texts]
    np.testing.assert_allclose(whole, np.concatenate(parts), atol=1e-9)
    assert not whole[1].any() and not whole[3].any()


def test_network_learns_and_is_calibrated():
    random_ = np.random.default_rng(3)
    rows = random_.normal(size=(3000, 6))
    truth = 1 / (1 + np.exp(-3 * rows[:, 0] * rows[:, 1] - 1))
    labels = (random_.random(3000) < truth).astype(float)
    network = fit(rows[:2000], labels[:2000])
    scores = network.scores(rows[2000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        chosen = (scores >= low) & (scores < low + 0.25)
        assert abs(scores[chosen].mean() - labels[2000:][chosen].mean()) < 0.12
    assert np.corrcoef(scores, truth[2000:])[0, 1] > 0.8


def test_temperature():
    random_ = np.random.default_rng(4)
    logits = random_.normal(size=20_000) * 2
    labels = (random_.random(20_000) < 1 / (1 + np.exp(-logits))).astype(int)
    assert temperature(logits * 3, labels) == pytest.approx(3, rel=0.1)
    assert temperature(logits, np.ones(20_000)) == 1.0


def test_odd_texts_and_repeats(spark, documents):
    frame = documents(ODD_TEXTS + ["good words here"] * 20).selectExpr("*", "'x' AS score", "1 AS quality")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(35)] + [(3, 0), (4, 7), (5, None), (999, 1)], "doc_id bigint, quality int"
    )
    vectors = word_vectors(frame)
    found = {r.doc_id: r.score for r in score(frame, vectors, train(frame, labels, vectors)).collect()}
    assert len(found) == 35 and all(0 <= s <= 1 for s in found.values())
    assert found[0] == found[1] == found[2] and found[10] == found[11]


def test_nothing_labelled_and_empty(spark, documents):
    docs, labels = documents(["a b"]), spark.createDataFrame([], "doc_id bigint, quality int")
    vectors = word_vectors(docs)
    assert train(docs, labels, vectors) is None
    assert [r.score for r in score(docs, vectors, None).collect()] == [0.5]
    assert score(documents([]), word_vectors(documents([])), None).collect() == []


def test_query_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op4_quality(spark, path).collect()}
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.5) for r in rows.values())
    labels = spark.read.parquet(f"{path}/labels.parquet").collect()
    unseen = [(rows[r.doc_id], r.quality) for r in labels if rows[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in unseen) > 0.95 * len(unseen)
