"""The tree against a plain one over lists."""

import hashlib
import random
import zlib

import pytest
from odd_texts import DOCUMENTS, ODD_TEXTS
from pyspark.sql import functions as F

from tallybook.llm import merkle
from tallybook.llm.queries import op12_merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def plain_path(levels, place, fanout):
    path = []
    for level in levels[:-1]:
        family = place // fanout * fanout
        own = place - family
        nodes = level[family : family + fanout]
        path.append(("".join(nodes[:own]), "".join(nodes[own + 1 :])))
        place //= fanout
    return path


def plain_tree(rows, fanout=2):
    """Per row (group, order, leaf) its leaf, subroot, root and path."""
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    levels = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        levels[name] = plain_levels([r[2] for r in groups[name]], fanout)
    top = plain_levels([levels[name][-1][0] for name in names], fanout) if names else []
    found = []
    for at, name in enumerate(names):
        above = plain_path(top, at, fanout)
        for place, row in enumerate(groups[name]):
            path = plain_path(levels[name], place, fanout) + above
            found.append((*row, levels[name][-1][0], top[-1][0], path))
    return found


def tree(spark, rows, fanout=2):
    frame = spark.createDataFrame(rows, "lang string, doc_id bigint, leaf string").repartition(3)
    found = merkle.manifest(frame, "leaf", "lang", "doc_id", ["lang", "doc_id"], fanout)
    return [
        (r.lang, r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof])
        for r in found.collect()
    ]


@pytest.mark.parametrize("fanout, sizes", [
    (2, {"a": 700, "b": 1, None: 3, "": 2, "é": 257}),
    (2, {None: 1}), (2, {"a": 2}), (3, {"a": 100, "b": 28, "c": 27}), (7, {"a": 50}), (2, {}),
])
def test_equals_the_plain_tree(spark, fanout, sizes):
    rows = [(lang, i * 3 % 1000, sha(f"{lang}{i}")) for lang, n in sizes.items() for i in range(n)]
    found = tree(spark, rows, fanout)
    assert sorted(found, key=repr) == sorted(plain_tree(rows, fanout), key=repr)


def test_repeated_rows_and_null_ids_are_leaves(spark):
    rows = [("a", None, sha("x"))] * 2 + [("a", 5, sha("y"))] * 300 + [("a", 5, sha("x"))]
    rows += [(f"g{i}", i, sha(str(i))) for i in range(40)]
    assert sorted(tree(spark, rows), key=repr) == sorted(plain_tree(rows), key=repr)


def test_a_hot_group_is_dealt_out_in_blocks(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, sha(str(i))) for i in range(3000)]
    found = tree(spark, rows)
    assert sorted(found, key=repr) == sorted(plain_tree(rows), key=repr)
    for lang, doc_id, leaf, _, root, path in random.Random(1).sample(found, 50):
        for before, after in path:
            leaf = sha(before + leaf + after)
        assert leaf == root


def test_other_columns_do_not_matter(spark):
    frame = spark.range(9).selectExpr(
        "id AS doc_id", "'a' AS lang", "sha2(string(id), 256) AS leaf", "1 AS _node", "2 AS _at",
        "'x' AS root", "'y' AS proof", "3 AS _group",
    )
    found = merkle.manifest(frame, "leaf", "lang", "doc_id", ["doc_id"])
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    assert found.select("root").distinct().count() == 1 and found.count() == 9
    with pytest.raises(ValueError):
        merkle.manifest(frame, "leaf", "lang", "doc_id", [], fanout=1)


def test_query_on_odd_documents(spark, tmp_path):
    rnd = random.Random(2)
    texts = [*ODD_TEXTS, *["repeated"] * 3, *[f"text {i}" for i in range(80)]]
    rows = [
        (rnd.choice([i, i, None, 3]), text, rnd.choice(["en", "de", None, ""]),
         rnd.choice(["s", None]), rnd.choice([None, i]))
        for i, text in enumerate(texts)
    ]
    rows += rows[:2]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))

    shown = {}
    for doc_id, text, lang, source, n_chars in rows:
        real = leaf(doc_id, text, lang, source, n_chars)
        changed = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        shown[real] = leaf(doc_id, text, lang, source, n_chars + 1) if changed else real
    expected = []
    for lang, doc_id, real, subroot, root, path in plain_tree([(r[2], r[0], leaf(*r)) for r in rows]):
        folded = shown[real]
        for before, after in path:
            folded = sha(before + folded + after)
        proof = sha("".join(before + after for before, after in path))
        expected.append((doc_id, real, subroot, root, proof, folded, folded == root))
    found = op12_merkle(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert {r[-1] for r in expected} == {True, False}
    empty = spark.createDataFrame([], DOCUMENTS)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_merkle(spark, f"{tmp_path}/none").collect() == []
