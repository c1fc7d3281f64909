"""The chain's sums against plain recursions, and accuracy on documents it has not seen."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd_texts import ODD_TEXTS

import tallybook.llm.langid as module
from tallybook.llm.arrays import text_slices
from tallybook.llm.langid import Model, held_out, predict, train, word_languages
from tallybook.llm.queries import op5_langid

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["ión", "ñe", "lla", "os"]}


def said(rnd, lang, n):
    return " ".join(
        "".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4))) for _ in range(n)
    )


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(i, said(rnd, lang, rnd.randint(3, 80)), lang) for i in range(300) for lang in SYLLABLES]
    rows = [(k, text, lang) for k, (_, text, lang) in enumerate(rows)] + [(9000, "x", None)]
    return train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=400)


def test_posteriors_equal_plain_sums(monkeypatch):
    monkeypatch.setattr(module, "_BLOCK", 4)
    random_ = np.random.default_rng(2)
    model = Model(["a", "b", "c"], None, random_.normal(size=(3, 3)), random_.normal(size=3))
    emissions = random_.normal(size=(13, 3)) * 3
    first = np.zeros(13, bool)
    first[[0, 5, 6, 11]] = True
    found = module._posteriors(emissions, first, model)
    for begin, after in ((0, 5), (5, 6), (6, 11), (11, 13)):
        sums = np.zeros((after - begin, 3))
        for path in itertools.product(range(3), repeat=after - begin):
            score = model.start[path[0]] + sum(emissions[begin + i, k] for i, k in enumerate(path))
            score += sum(model.transitions[a, b] for a, b in zip(path, path[1:]))
            for i, k in enumerate(path):
                sums[i, k] += np.exp(score)
        np.testing.assert_allclose(found[begin:after], sums / sums.sum(1, keepdims=True), rtol=1e-6)
    same, pairs, starts = module._expectations(emissions, first, model)
    np.testing.assert_allclose(same, found, rtol=1e-6)
    assert pairs.sum() == pytest.approx(9) and starts.sum() == pytest.approx(4)


def test_emissions_do_not_depend_on_neighbours_or_slices(model):
    rnd = random.Random(3)
    texts = [said(rnd, lang, 30) for lang in SYLLABLES for _ in range(5)] + ["", "É", "a-b"]
    joined = next(text_slices(pa.array(texts), 1 << 30))
    starts, ends = module._words(joined.data, joined.offsets)
    whole = module._emissions(joined.data, starts, ends, model.weights)
    parts = []
    for text in texts:
        one = next(text_slices(pa.array([text])))
        parts.append(module._emissions(one.data, *module._words(one.data, one.offsets), model.weights))
    np.testing.assert_allclose(whole, np.concatenate(parts), atol=1e-5)


def test_code_switched_words(model):
    rnd = random.Random(4)
    runs = [(lang, said(rnd, lang, 12)) for lang in ("aa", "bb", "cc", "aa")]
    texts = next(text_slices(pa.array([" ".join(text for _, text in runs)])))
    _, _, found = word_languages(texts, model)
    truth = np.repeat([model.languages.index(lang) for lang, _ in runs], 12)
    assert (found.argmax(1) == truth).mean() > 0.95


def test_documents(spark, model, documents):
    rnd = random.Random(5)
    texts = [said(rnd, lang, n) for lang in SYLLABLES for n in (1, 5, 400)]
    frame = documents(texts + ODD_TEXTS).selectExpr("*", "1 AS score", "2 AS _doc")
    rows = {r.doc_id: r for r in predict(frame, model).collect()}
    for i in range(9):
        assert rows[i].lang_pred == list(SYLLABLES)[i // 3] and rows[i].score > 0.5
    for i, text in enumerate(ODD_TEXTS, 9):
        letters = any(c.isalpha() for c in text or "")
        assert (rows[i].lang_pred == "und") == (not letters)
        assert 0 <= rows[i].score <= 1 and (letters or rows[i].score == 0)
    assert {r.lang_pred for r in predict(documents(["— „“", "。"]), model).collect()} == {"und"}


def test_nothing_learnt(spark, documents):
    none = train(documents([("x", None, None, "s", 1)], "text string, lang string, doc_id bigint, source string, n_chars bigint"))
    assert none.languages == []
    assert [(r.lang_pred, r.score) for r in predict(documents(["abc"]), none).collect()] == [("und", 0.0)]
    assert predict(documents([]), none).collect() == []


def test_query_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op5_langid(spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) > 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(held_out(), "zz").otherwise(F.col("lang")))
    one, two = (train(d.where(~held_out())) for d in (docs, other))
    assert one.languages == two.languages
    np.testing.assert_array_equal(one.weights, two.weights)


def test_working_memory_is_a_small_multiple_of_a_slice():
    rnd = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rnd.integers(0, 26, rnd.integers(2, 9))) for _ in range(500)]
    texts = pa.array([" ".join(rnd.choice(words, 400)) for _ in range(2500)])
    n = 4
    weights = rnd.random((1 << module.FEATURE_BITS, n), np.float32)
    model = Model(list("abcd"), weights, rnd.random((n, n)), rnd.random(n))
    module._column(texts.slice(0, 1), model)
    tracemalloc.start()
    best, scores = module._column(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 5_000_000 and peak < 100 * 2**20
    alone = [module._column(texts.slice(i, 1), model) for i in range(0, 2500, 250)]
    assert [int(b[0]) for b, _ in alone] == best[::250].tolist()
    assert np.allclose([s[0] for _, s in alone], scores[::250])
