"""Groups of equal texts, over several stream batches and with digests that collide."""

import hashlib
import random
import re

import pytest
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from tallybook.llm.exact_dedup import exact_duplicates, sha256
from tallybook.llm.queries import op2_exact_dedup


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    answer = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        answer += [(i, keep, len(ids)) for i in ids]
    return sorted(answer, key=repr)


def answers(frame):
    return sorted(((r.doc_id, r.keep_id, r.copies) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    texts = ["a  b", "a b", "a\nb", "a b ", "hot text"] + [f"text {i}" for i in range(40)]
    rows = [(i, rnd.choice(texts)) for i in range(300)]
    rows += [(300 + i, "hot text") for i in range(900)]
    rows += list(enumerate(ODD_TEXTS, 2000)) + [(None, None), (None, "a b"), (5, rows[5][1])]
    return rows


def written(spark, tmp_path, rows, files):
    schema = "doc_id bigint, text string, copies int, digest string"
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    frame.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path / "documents.parquet")


@pytest.mark.parametrize(
    "digest", [sha256, lambda text: F.substring(F.sha2(text, 256), 1, 1)], ids=["sha", "weak"]
)
@pytest.mark.parametrize("files_per_batch", [2, 1000])
def test_equals_plain_python(spark, tmp_path, rows, digest, files_per_batch):
    path = written(spark, tmp_path, rows, 5)
    assert answers(exact_duplicates(spark, path, digest, files_per_batch)) == expected(rows)


def test_query(spark, tmp_path):
    rows = [(3, "b  c"), (1, "b c"), (2, None), (7, "")]
    written(spark, tmp_path, rows, 2)
    found = {r.doc_id: r for r in op2_exact_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in found.items()} == {
        1: (1, 2, True), 3: (1, 2, False), 2: (2, 2, True), 7: (2, 2, False),
    }
    assert found[3].text_sha256 == hashlib.sha256(b"b c").hexdigest()
    assert found[7].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark, tmp_path):
    path = written(spark, tmp_path, [], 1)
    assert exact_duplicates(spark, path).collect() == []


def test_state_keys_live_in_rocksdb(spark, tmp_path, monkeypatch):
    places = []
    import tallybook.llm.exact_dedup as module

    real = module.shared_path
    monkeypatch.setattr(module, "shared_path", lambda s, label: places.append(real(s, label)) or places[-1])
    exact_duplicates(spark, written(spark, tmp_path, [(1, "a"), (2, "a")], 2)).collect()
    state = next(p for p in places if "/state-" in p and "updates" not in p)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{state}/state")
    kinds = {r.path.rpartition(".")[2] for r in files.select("path").collect()}
    assert "changelog" in kinds
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith(
        "HDFSBackedStateStoreProvider"
    )
