"""Exact shard sizes, gapless slots, and the law of the matrix."""

import zlib
from collections import Counter

import numpy as np
import pytest
from odd_texts import ODD_TEXTS

from tallybook.llm.queries import shard_manifest
from tallybook.llm.sharding import (
    communication_matrix,
    hypergeometric,
    shard_sizes,
    shuffle_into_shards,
)


def placed(frame):
    rows = frame.collect()
    slots = {}
    for row in rows:
        slots.setdefault(row.shard, []).append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, {shard: len(s) for shard, s in slots.items()}


@pytest.mark.parametrize("block_rows", [7, 4096])
@pytest.mark.parametrize("total", [0, 1, 5, 40, 333])
def test_sizes_and_slots_are_exact(spark, total, block_rows):
    rows = spark.range(total).withColumnRenamed("id", "doc_id")
    found, sizes = placed(shuffle_into_shards(rows, 8, block_rows=block_rows))
    assert sorted(row.doc_id for row in found) == list(range(total))
    assert [sizes.get(s, 0) for s in range(8)] == shard_sizes(total, 8)


def test_seed_decides(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")

    def run(frame, seed):
        dealt = shuffle_into_shards(frame, 4, seed=seed, block_rows=50)
        return {r.doc_id: (r.shard, r.slot) for r in dealt.collect()}

    assert run(rows, 1) == run(rows.repartition(5), 1) != run(rows, 2)


def test_every_row_goes_anywhere(spark):
    rows = spark.range(120).withColumnRenamed("id", "doc_id")
    counts = np.zeros((4, 4))
    for seed in range(8):
        for r in shuffle_into_shards(rows, 4, seed=seed, block_rows=16).collect():
            counts[r.doc_id // 30, r.shard] += 1
    assert counts.sum() == 960 and (np.abs(counts - 60) < 35).all()


def test_odd_rows(documents):
    frame = documents(ODD_TEXTS + [(None, None, None, None, None)] * 3)
    frame = frame.selectExpr("*", "7 AS shard", "'x' AS slot", "1 AS size")
    found, sizes = placed(shard_manifest(frame))
    assert len(found) == len(ODD_TEXTS) + 3 and max(sizes.values()) == 1
    expected = Counter(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
        for t in [*ODD_TEXTS, None, None, None]
    )
    assert Counter((r["size"], r.text_crc32) for r in found) == expected
    kept = shuffle_into_shards(frame, 3).drop("shard", "slot").columns
    assert kept == [c for c in frame.columns if c not in ("shard", "slot")]


def test_matrix_has_its_margins():
    rows, columns = [5, 0, 17, 8], [10, 10, 10]
    for seed in range(20):
        matrix = communication_matrix(rows, columns, seed)
        assert matrix.min() >= 0
        assert matrix.sum(1).tolist() == rows and matrix.sum(0).tolist() == columns


def test_hypergeometric_law():
    random = np.random.default_rng(5)
    drawn = Counter(hypergeometric(random, 4, 6, 3) for _ in range(6000))
    for k, share in enumerate((20 / 120, 60 / 120, 36 / 120, 4 / 120)):
        assert abs(drawn[k] / 6000 - share) < 0.03
    huge = [hypergeometric(random, 10**11, 39 * 10**11, 10**8) for _ in range(200)]
    assert abs(np.mean(huge) - 2.5e6) < 1000 and 1000 < np.std(huge) < 2200
    assert hypergeometric(random, 0, 5, 3) == 0 and hypergeometric(random, 5, 0, 3) == 3
