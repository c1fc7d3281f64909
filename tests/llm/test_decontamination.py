"""Hit words and items against a scan of every window of every item."""

import hashlib
import random
import re

import pytest
from odd_texts import ODD_TEXTS

import tallybook.llm.decontamination as module
from tallybook.llm.decontamination import benchmark_hits
from tallybook.llm.queries import op6_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scan(docs, items):
    windows = {}
    for item_id, text in items:
        said = words(text)
        size = min(10, len(said))
        for i in range(len(said) - size + 1 if size else 0):
            windows.setdefault(tuple(said[i : i + size]), set()).add(item_id)
    answer = []
    for doc_id, text in docs:
        said, hit, found = words(text), set(), set()
        for size in range(1, 11):
            for i in range(len(said) - size + 1):
                ids = windows.get(tuple(said[i : i + size]))
                if ids:
                    hit.update(range(i, i + size))
                    found |= ids
        answer.append((doc_id, len(said), len(hit), sorted(found)))
    return sorted(answer, key=repr)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(8)
    vocabulary = ["a", "b", "É", "c1", "漢", "The"]
    text = lambda n: rnd.choice([" ", ", ", "--"]).join(rnd.choices(vocabulary, k=n))
    items = [(i, text(rnd.choice([0, 1, 3, 7, 9, 10, 11, 14, 30]))) for i in range(40)]
    items = [(i, t) for i, t in items if len(words(t)) not in (1, 3)] + [
        (100, None), (101, "..."), (102, items[30][1]), (102, items[30][1]), (103, "xx yy zz"),
    ]
    docs = []
    for i in range(250):
        parts = [text(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            said = words(rnd.choice(items)[1])
            begin = rnd.randint(0, max(0, len(said) - 8))
            parts += [" ".join(said[begin : begin + rnd.randint(8, 14)]).upper(), text(rnd.randint(0, 3))]
        docs.append((i, " ".join(parts)))
    docs += list(enumerate(ODD_TEXTS, 1000)) + [(None, items[20][1]), (3, "xx. YY zz"), (3, "xx. YY zz")]
    return docs, items


def answers(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("broadcast_rows", [0, module.BROADCAST_ROWS])
def test_equals_scan(spark, tables, broadcast_rows, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast_rows)
    docs, items = tables
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, n_hit int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, prints int")
    assert answers(benchmark_hits(d.repartition(4), b)) == scan(docs, items)


def test_every_shared_window_is_found(spark):
    rnd = random.Random(0)
    said = [f"w{rnd.randrange(40)}" for _ in range(60)]
    docs = [(i, f"x{i} " + " ".join(said[i : i + 10]) + f" y{i}") for i in range(51)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(1, " ".join(said))], "item_id bigint, text string")
    assert {(r.n_hit, tuple(r["items"])) for r in benchmark_hits(d, b).collect()} == {(10, (1,))}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, item_id bigint, text string")
    some = spark.createDataFrame([(1, 1, "a b")], "doc_id bigint, item_id bigint, text string")
    assert answers(benchmark_hits(none, some)) == []
    assert answers(benchmark_hits(some, none)) == [(1, 2, 0, [])]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = op6_decontamination(spark, path).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    assert len(rows) == len(docs)
    found = {r.doc_id: r for r in rows}
    for doc_id, n, hit, ids in scan(docs, items):
        row = found[doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert tuple(row) == (doc_id, n, hit, len(ids), digest, hit > 0)
    assert any(r.contaminated for r in rows)
