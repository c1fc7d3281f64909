"""The pipeline stage by stage against plain versions of each decision, and as a whole."""

import random

import pyarrow as pa
import pytest
from odd_texts import DOCUMENTS, ODD_TEXTS
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from test_decontamination import scan
from test_ngram_join import all_pairs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    syllables = {"en": ["the", "ing", "ou"], "de": ["sch", "ung", "eit"], "fr": ["eau", "elle", "é"]}
    word = lambda lang: "".join(rnd.choices(syllables[lang], k=rnd.randint(1, 3)))
    said = lambda lang, n: " ".join(word(lang) + str(rnd.randrange(50)) * (rnd.random() < 0.1) for _ in range(n))
    items = [(i, said("en", 14)) for i in range(5)]
    rows = []
    for i in range(240):
        lang = rnd.choice(list(syllables))
        text = said(lang, rnd.randint(30, 120))
        if i % 11 == 0:
            text += " " + items[i % 5][1]
        if i % 7 == 0 and rows:
            text, lang = rows[i // 2][1] + " more", rows[i // 2][2]
        rows.append((i, text, lang, f"src{min(i % 9, 4)}", len(text)))
    rows += [(1000 + i, t, None, None, 0) for i, t in enumerate(ODD_TEXTS)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=repr)


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]

    spoken = stages["language_id"](spark, docs, path)
    assert spoken.columns == docs.columns
    kept = rows_of(spoken)
    assert set(kept) <= set(rows)
    assert {r[0] for r in rows if r[0] < 1000} <= {r[0] for r in kept}
    letters = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert {r[0] for r in kept} <= letters

    apart = stages["near_duplicates"](spark, spoken, path)
    component = {d: c for d, _, c in all_pairs([r[:2] for r in kept], 5, 80)}
    expected = [r for r in kept if component[r[0]] == r[0]]
    assert rows_of(apart) == expected and len(expected) < len(kept)

    clean = stages["decontamination"](spark, apart, path)
    hit = {d for d, _, n, _ in scan([r[:2] for r in expected], items) if n}
    expected = [r for r in expected if r[0] not in hit]
    assert rows_of(clean) == expected and hit

    mixed = stages["mixing"](spark, clean, path)
    assert mixed.columns == docs.columns
    drawn = rows_of(mixed)
    assert set(drawn) <= set(expected) and 0 < len(drawn) < len(expected)

    sharded = stages["sharding"](spark, mixed, path)
    assert rows_of(sharded) == drawn
    sizes = {r.shard: r["count"] for r in sharded.groupBy("shard").count().collect()}
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1

    whole = contract.queries()["pipeline"](spark, path)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, sharded.collect()), key=repr)


def test_clashing_columns_stay(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr(
        "*", "'a' AS score", "1 AS topic", "2.5D AS tokens", "'b' AS lang_pred", "false AS sampled",
        "3 AS n", "4 AS component_id", "'c' AS probability",
    ).where(F.col("doc_id") < 60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.exceptAll(docs).count() == 0 < out.count()


def test_empty_documents(spark, folder, tmp_path):
    empty = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).collect() == []


def test_null_and_repeated_ids(spark, folder):
    path, _, items = folder
    said = lambda word: " ".join(f"{word}{i % 17}{i}" for i in range(40))
    rows = [
        (None, said("copy"), "en", "s", 1), (5, said("copy"), "en", "s", 1),
        (None, said("clean"), "en", "s", 2), (None, said("other"), "de", "s", 3),
        (2, said("twice"), "en", "s", 4), (2, said("twice"), "en", "s", 4),
        (7, said("same id"), "en", "s", 5), (7, f"before {items[0][1]} after", "en", "s", 6),
        (None, f"more {items[1][1]} words", "en", "s", 7), (None, None, "en", "s", 8),
        (None, None, "en", "s", 8),
    ]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    apart = rows_of(stages["near_duplicates"](spark, docs, path))
    assert apart == sorted(rows[1:5] + rows[6:], key=repr)
    clean = rows_of(stages["decontamination"](spark, docs, path))
    assert clean == sorted(rows[:7] + rows[9:], key=repr)
    sharded = stages["sharding"](spark, docs, path)
    assert rows_of(sharded) == sorted(rows, key=repr)
    slots = sorted((r.shard, r.slot) for r in sharded.collect())
    assert len(set(slots)) == len(rows) and max(slot for _, slot in slots) == 0
    spoken = rows_of(stages["language_id"](spark, docs, path))
    assert set(spoken) <= set(rows) and not any(r[1] is None for r in spoken)


@pytest.mark.parametrize(
    "stage, operator",
    [
        ("language_id", "langid.train"),
        ("near_duplicates", "ngram_join.similar_documents"),
        ("decontamination", "decontamination.benchmark_hits"),
    ],
)
def test_batches_of_texts_are_bounded_by_bytes(spark, folder, monkeypatch, stage, operator):
    path, _, _ = folder
    long = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 5000).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    class Begun(Exception):
        pass

    def begun(*_, **__):
        sizes = [r["size"] for r in long.mapInArrow(size, "size bigint").collect()]
        assert sum(sizes) > 400 * 25_000 and max(sizes) < 1.1 * corpus_pipeline.BATCH_BYTES
        raise Begun

    monkeypatch.setattr(f"tallybook.llm.{operator}", begun)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    with pytest.raises(Begun):
        dict(corpus_pipeline.STAGES)[stage](spark, docs, path)
