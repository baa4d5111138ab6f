import random
import re

import numpy as np
import pytest

from entailis.llm import neardup as N
from entailis.llm.queries import OP9_SQL, op9_neardup
from oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            linked = sets[i] and sets[j] and docs[i][0] is not None and docs[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
            if linked:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (k, _) in enumerate(docs):
        c = None if k is None else min(docs[j][0] for j in range(n) if group[j] == group[i])
        out.append((k, len(sets[i]), c, c == k if k is not None else True))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as n", "1 as regs", "2 as node")
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=repr)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    same(op9_neardup(spark, folder), connect(folder), OP9_SQL)


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_chains_and_boilerplate(spark):
    rng = random.Random(4)
    texts = near_copies(rng, 60, 120, 6) + near_copies(rng, 10, 40, 3)
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(30)]  # a common passage, but no near copies
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):  # each is near its neighbours only
        texts.append(" ".join(chain[k * 8 : k * 8 + 100] + [f"c{100 + i}" for i in range(k * 8)]))
    rng.shuffle(texts)
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    assert run(spark, docs) == brute(docs)


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    docs = [(0, " ".join(base))]
    for k in range(8, 22):  # prefixes with 100 - k shingles: linked from 75 on
        docs.append((k, " ".join(base[: 104 - 2 * k])))
    assert run(spark, docs) == brute(docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "One  two\nthree four"), (8, "one two three four five"), (None, "one"), (None, "one"), (9, "one"), (9, "one"), (10, "É é"), (11, "é É"), (12, "x " * 30_000), (13, "x " * 29_000), (14, " x")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_one_key_of_several_texts(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 99)}" for _ in range(30)) for x in "abc")
    docs = [(5, a), (5, b), (3, a), (4, b), (6, c), (6, c), (7, c + " more"), (5, c)]
    first = min((a, b, c), key=lambda t: N._digest(N.shingles(t)))
    ties = {a: 3, b: 4, c: 5}  # the smallest key of the text that stands for 5
    expected = []
    for k, t in docs:
        of = first if k == 5 else a if k == 3 else b if k == 4 else c
        component = ties[of] if of == first else {a: 3, b: 4, c: 6}[of]
        expected.append((k, len(shingle_set(t)), component, component == k))
    assert run(spark, docs) == run(spark, docs[::-1]) == sorted(expected, key=repr)


def test_strays_in_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(N, "BROADCAST_CLASSES", -1)
    rng = random.Random(12)
    texts = near_copies(rng, 60, 80, 4)
    middle = texts[0].split()
    texts += [" ".join(middle[:60] + [f"s{k}_{i}" for i in range(20)]) for k in range(6)]  # share bands now and then
    docs = list(enumerate(texts))
    assert run(spark, docs) == brute(docs)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "SKETCH_BLOCK", 3)
    monkeypatch.setattr(N, "EDGES_A_TASK", 5)
    rng = random.Random(9)
    docs = list(enumerate(near_copies(rng, 50, 60, 9)))
    assert run(spark, docs) == brute(docs)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    errors = []
    for j in (0.5, 0.75, 0.9):
        for _ in range(20):
            n = 400
            both = int(2 * n * j / (1 + j))
            x = np.unique(rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64))
            a, b = x[:n], x[n - both :]
            ra, rb = N.registers(a), N.registers(b)
            assert (np.maximum(ra, rb) == N.registers(np.unique(np.concatenate([a, b])))).all()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            greater, equal = np.array([(ra > rb).sum()]), np.array([(ra == rb).sum()])
            errors.append(float(N.joint_similarity(greater, N.REGISTERS - greater - equal, equal, np.array([float(len(a))]), np.array([float(len(b))]))[0]) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(7, i) for i in range(20)]], ids=["few", "chain", "star"])
def test_components(spark, edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in N.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
