import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import rows
from entailis.llm.queries import PERMUTATION_KEY, SHARDS, op1_sharding
from entailis.llm.sharding import FeistelPermutation, shard_rows


@given(st.integers(1, 3000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    p = FeistelPermutation(n, key)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert p.inverse(out).tolist() == list(range(n))


def test_locate_and_back():
    p = FeistelPermutation(1001, 7)
    shard, slot = p.locate(np.arange(1001), 40)
    assert p.row_at(shard, slot, 40).tolist() == list(range(1001))


def plain_permutation(x, n, key, rounds=4):
    """A balanced Feistel network on half words, walked along its cycle until it is inside the table; without arrays."""
    word = 2**64

    def scramble(v):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ (v >> shift)) * factor % word
        return v ^ (v >> 31)

    half = 1
    while 4**half < n:
        half += 1
    while True:
        left, right = divmod(x, 2**half)
        for r in range(1, rounds + 1):
            own = scramble((key + r * 0x9E3779B97F4A7C15) % word)
            left, right = right, left ^ (scramble((right + own) % word) % 2**half)
        x = left * 2**half + right
        if x < n:
            return x


@given(st.integers(1, 500), st.integers(0, 2**63))
@settings(max_examples=30, deadline=None)
def test_against_plain_integers(n, key):
    assert FeistelPermutation(n, key).forward(np.arange(n)).tolist() == [plain_permutation(i, n, key) for i in range(n)]


def test_query(spark, data):
    out = op1_sharding(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    counts = out.groupby("shard").size()
    assert set(counts.index) == set(range(SHARDS)) and counts.max() - counts.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # Brute force: rows in order of their keys, permuted one by one by plain integers.
    texts = [(int(i), (t or "").encode()) for i, t in zip(docs.doc_id, docs.text)]
    order = sorted((i, zlib.crc32(t), len(t) + 16) for i, t in texts)
    expected = []
    for row, (i, crc, size) in enumerate(order):
        place = plain_permutation(row, len(order), PERMUTATION_KEY)
        expected.append((i, size, crc, "rows", place % SHARDS, place // SHARDS))
    got = [(int(r.doc_id), int(r["size"]), int(r.text_crc32), r.law, int(r.shard), int(r.slot)) for _, r in out.iterrows()]
    assert sorted(got) == sorted(expected) and out.grown_shard.isna().all()


def test_same_result_for_any_partitioning(spark):
    df = spark.range(500).selectExpr("id * 7 % 501 as k", "id as v")
    a, b = (rows(shard_rows(df.repartition(n), ["k"], 7, 1)) for n in (1, 9))
    assert a == b


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (1, "x"), (1, None)], "k long, shard_name string")
    out = shard_rows(df, ["k"], 3, 1)
    assert sorted(r.row_number for r in out.collect()) == [0, 1, 2, 3] and [r.k for r in out.orderBy("row_number").collect()] == [None, 1, 1, 1]
    assert shard_rows(df.limit(0), ["k"], 3, 1).count() == 0
    with pytest.raises(ValueError, match="positive"):
        shard_rows(df, ["k"], 0, 1)
