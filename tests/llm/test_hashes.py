"""Words and runs of words stay apart, whatever they are made of."""

import random

import numpy as np

from tallybook.llm import decontamination, ngram_join
from tallybook.llm.arrays import word_hashes

# Two words that sums of powers of any odd base, modulo a power of two, cannot tell apart.
ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def hashes(words, seed=0):
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
    starts = np.append(np.int64(0), ends)[: len(words)]
    return word_hashes(data, starts, ends, seed).tolist()


def test_hashes_go_by_content():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abAé\x00", k=rnd.randint(1, 40))) for _ in range(5000)]
    words += [ONE, OTHER, "a" * 8, "a" * 9, "a" * 16, "a" * 1_000_000, "b" + "a" * 999_999]
    lower = [w.translate({65: 97}) for w in words]
    for seed in (0, 1):
        found = hashes(words, seed)
        assert found == [hashes([w], seed)[0] for w in words]
        assert len(set(found)) == len(set(lower))
        assert hashes(lower, seed) == found
    assert not set(hashes(words, 0)) & set(hashes(words, 1))
    assert hashes([]) == []


def test_crafted_words_are_two_documents(spark, documents):
    docs = documents([ONE, OTHER, ONE, f"x {ONE} y z", f"x {OTHER} y z"])
    found = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 3, 90).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_crafted_words_are_no_window(spark, documents):
    rest = " ".join(f"w{i}" for i in range(9))
    items = spark.createDataFrame([(1, f"{ONE} {rest}"), (2, ONE)], "item_id bigint, text string")
    docs = documents([f"{ONE} {rest}", f"{OTHER} {rest}", OTHER, f"{rest} {ONE}"])
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.benchmark_hits(docs, items).collect()}
    assert found == {0: (10, [1, 2]), 1: (0, []), 2: (0, []), 3: (1, [2])}
