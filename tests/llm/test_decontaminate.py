import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from entailis.llm import decontaminate as D
from entailis.llm.queries import OP8_SQL, op8_decontaminate
from oracle import connect, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=13):
    patterns = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for p, own in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= own
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def plain(found):
    return [(n, [k for a, b in s for k in range(a, b)], i) for n, s, i in found]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    same(op8_decontaminate(spark, folder), connect(folder), OP8_SQL)


def test_null_item_ids(spark, tmp_path):
    bench = [(None, "one two three"), (None, "four five"), (7, "four five"), (8, None)]
    docs = [(1, "a one two three b"), (2, "four five"), (3, "one two three four five"), (4, "clean")]
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).toPandas().astype({"item_id": "Int64"}).to_parquet(tmp_path / "benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    got = op8_decontaminate(spark, str(tmp_path))
    same(got, connect(tmp_path), OP8_SQL)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got.collect()} == {1: (3, 1), 2: (2, 2), 3: (5, 2), 4: (0, 0)}
    table = spark.createDataFrame(bench, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (1 << 20, 4):
        found = df.select("doc_id", D.contamination(df, table, block_bytes=size).alias("x")).collect()
        assert {r.doc_id: (r.x["items"], r.x["unnamed"]) for r in found} == {1: ([], True), 2: (["7"], True), 3: (["7"], True), 4: ([], False)}


def test_against_brute_force():
    rng = random.Random(2)
    alphabet = ["a", "B", "c", "é", "7"]
    for _ in range(60):
        window = rng.choice([1, 2, 3, 5])
        text = lambda n: " ".join(rng.choices(alphabet, k=rng.randint(0, n)))  # noqa: B023, E731
        items = [(str(k % 4), rng.choice([text(8), None, "", "zz"])) for k in range(6)]
        texts = [rng.choice([text(40), None, "", "...", "x y", text(6)]) for _ in range(8)]
        texts += texts[:2]
        for n in (1, 3):  # blocks
            blocks = [D.Phrases(items[k::n], window) for k in range(n)]
            assert plain(D.Shard(texts).scan(blocks)) == brute(texts, items, window)


def test_words():
    t = "Don't STOP—me's 3x\x00É\x7f_a"
    assert [w.decode() for w in D.words(t)] == words(t)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_suffix_array(xs):
    text = np.array([x + 1 for x in xs] + [0])
    assert D.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@given(st.lists(st.integers(0, 6), min_size=1, max_size=200))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(xs):
    w, seq = D.WaveletMatrix(np.array(xs), 3), np.array(xs)
    at = np.arange(len(xs))
    symbol, rank = w.access(at)
    assert symbol.tolist() == xs and rank.tolist() == [xs[:i].count(xs[i]) for i in at]
    for s in range(7):
        assert w.rank(np.full(len(xs) + 1, s), np.arange(len(xs) + 1)).tolist() == [int((seq[:i] == s).sum()) for i in range(len(xs) + 1)]


def test_index_locates_all_occurrences():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (5, 60, 1, 200, 33)])
    index = D.FMIndex(text, 3)
    for m in (1, 2, 4, 6):
        p = rng.integers(1, 4, m)
        low, high = index.search(p[None, :], np.array([m]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]


def test_blocks_of_the_benchmark(spark, docs):
    items = spark.createDataFrame([(k, f"w{k} x y z w{k}") for k in range(20)] + [(None, "x y"), (30, None)], "item_id long, text string")
    df = docs((1, "w1 x y z w1 w2 x y z w2"), (2, None), (3, "y z"), (1, "w1 x y z w1"), (None, "w3 x y z w3")).withColumnRenamed("source", "items")
    one, many = (sorted((str(r.doc_id), r.x.n_words, [tuple(s) for s in r.x.spans], list(r.x["items"])) for r in df.select("doc_id", D.contamination(df, items, block_bytes=b).alias("x")).collect()) for b in (1 << 20, 40))
    assert one == many and one[0] == ("1", 5, [(0, 5)], ["1"])
    assert df.limit(0).select(D.contamination(df, items)).count() == 0
    assert [r[0].n_words for r in df.limit(1).select(D.contamination(df, items.limit(0))).collect()] == [10]


def test_long_repeated_text():
    t = "a b " * 5000
    n, s, i = D.Shard([t]).scan([D.Phrases([("1", "a b a")], 13)])[0]
    assert (n, s, i) == (10_000, [(0, 9_999)], ["1"])


def test_the_whole_shard_is_indexed():
    shard = D.Shard(["one two three", "", None, "four one five", "one two three"])
    assert shard.index.n == 3 + 3 + 2 and set(shard.ids) == {b"one", b"two", b"three", b"four", b"five"}
    assert D.Shard([None, ""]).scan([D.Phrases([("1", "a")])]) == [(0, [], []), (0, [], [])]
