"""Ranked search against a plain search of every document."""

import math
import random
import re
from collections import Counter

import pytest
from odd_texts import DOCUMENTS, ODD_TEXTS
from pyspark.sql import functions as F

from tallybook.llm import ranking
from tallybook.llm.queries import op11_ranked_search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return Counter(TERM.findall(lower))


def search(docs, items, best=10):
    counted = [(doc_id, terms(text)) for doc_id, text in docs]
    counted = [(doc_id, t, sum(t.values())) for doc_id, t in counted if t]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    df = Counter(term for _, t, _ in counted for term in t)
    found = []
    for item_id, text in items:
        scores = []
        for doc_id, t, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                * (1_000_000_000 * t[term] // (1000 * t[term] + 8 * m))
                for term in terms(text) if term in t
            )
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for place, (score, _, _, doc_id) in enumerate(sorted(scores)[:best], 1):
            found.append((item_id, place, doc_id, -score))
    return sorted(found, key=repr)


def corpus(seed, n_docs, n_items):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["É", "ß", "Zz9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, weights, k=n))
    docs = [(i, text(rnd.randint(1, 60))) for i in range(n_docs)]
    docs += [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [(docs[0][0], docs[1][1]), docs[2], docs[2], (None, docs[3][1]), (None, text(5))]
    items = [(i % 40, text(rnd.randint(1, 30))) for i in range(n_items)]
    items += [(900, None), (901, ""), (902, "unknownword"), (None, docs[4][1]), (903, "X" * 3000)]
    return docs, items


def tables(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
        spark.createDataFrame(items, ITEMS).repartition(2),
    )


def ranked(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("options", [
    {}, dict(block_docs=7, bundle_items=3), dict(best=1, block_docs=20), dict(best=500),
    dict(dictionary_terms=40, block_docs=50),
])
def test_equals_a_search_of_every_document(spark, tmp_path, options):
    docs, items = corpus(3, 300, 25)
    frame, wanted = tables(spark, docs, items)
    # More than one dictionary reads the documents more than once.
    frame.write.parquet(f"{tmp_path}/docs")
    found = ranking.rank(spark.read.parquet(f"{tmp_path}/docs"), wanted, **options)
    assert ranked(found) == search(docs, items, options.get("best", 10))


def test_many_items_are_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 10)
    docs, items = corpus(4, 100, 30)
    frame, wanted = tables(spark, docs, items)
    assert ranked(ranking.rank(frame, wanted, bundle_items=5)) == search(docs, items)


def test_equal_documents_go_by_id(spark):
    docs = [(i * 7 % 50, "same words here") for i in range(50)] + [(100, "other")] * 3
    frame, wanted = tables(spark, docs, [(1, "same here"), (2, "other words")])
    assert ranked(ranking.rank(frame, wanted)) == search(docs, [(1, "same here"), (2, "other words")])


def test_nothing_to_search(spark):
    docs, items = corpus(5, 10, 3)
    frame, wanted = tables(spark, docs, items)
    for some, few in ((frame.limit(0), wanted), (frame, wanted.limit(0)),
                      (frame.where("doc_id >= 5000 AND trim(text) = ''"), wanted)):
        assert ranking.rank(some, few).collect() == []


def test_long_texts_are_counted_in_slices():
    rnd = random.Random(6)
    text = " ".join(rnd.choice(["ab", "Cd", "é", "x" * 50]) for _ in range(200_000))
    assert len(text) > 2 * ranking._CHUNK
    assert ranking.count_terms(text.encode()) == {k.encode(): v for k, v in terms(text).items()}
    assert ranking.count_terms(b"y" * 3_000_000) == {b"y" * 3_000_000: 1}


def test_query_with_clashing_columns(spark, tmp_path):
    docs, items = corpus(8, 120, 12)
    frame, wanted = tables(spark, docs, items)
    for name, table in (("documents", frame), ("benchmark", wanted)):
        table.selectExpr("*", "1 AS block", "2 AS score", "3 AS rank", "'t' AS term", "4 AS _item").write.parquet(
            f"{tmp_path}/{name}.parquet"
        )
    assert ranked(op11_ranked_search(spark, str(tmp_path))) == search(docs, items)
