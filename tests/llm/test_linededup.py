from pyspark.sql import functions as F

from oracle import rows
from entailis.llm import linededup
from entailis.llm.queries import OP5_SQL, op5_linededup
from oracle import connect, same


def brute(docs, least):
    """docs: (key, text, site) -> [(key, n_lines, n_removed, text)]"""
    sites, first = {}, {}
    for k, t, s in docs:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip():
                sites.setdefault(line, set()).update([s] if s is not None else [])
                order = (k is None, k or 0, p)
                first[line] = min(first.get(line, order), order)
    out = []
    for k, t, _ in docs:
        lines = t.split("\n") if t is not None else []
        kept = [x for p, x in enumerate(lines) if not (x.strip() and len(sites[x]) >= least and first[x] != (k is None, k or 0, p))]
        out.append((k, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, docs, least):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_gone", F.lit("x"))
    out = linededup.dedup_lines(df, least)
    assert out.columns == ["doc_id", "text", "source", "n_gone", "n_lines", "n_removed"]
    return rows(out.select("doc_id", "n_lines", "n_removed", "text"))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    same(op5_linededup(spark, folder), connect(folder), OP5_SQL)


def test_small(spark):
    docs = [(i, f"common\nown {i}\n\n  \ncommon\n{'rare' if i < 2 else 'x'}", f"s{i % 7}") for i in range(12)]
    docs += [(50, None, "s1"), (51, "", "s1"), (52, "common", None), (None, "common\nnull key", "s2"), (53, "\n\n", "s3"), (0, docs[0][1], "s0")]
    for least in (2, 3, 7, 8):
        assert run(spark, docs, least) == brute(docs, least), least


def test_copies_keep_one(spark):
    docs = [(i, "first line\nsecond line", f"s{i}") for i in range(20)]
    got = run(spark, docs, 10)
    assert got[0] == (0, 2, 0, "first line\nsecond line")
    assert sum(t == "" for *_, t in got) == 19


def test_near_the_threshold(spark):
    docs = [(100 * n + i, f"line {n}", f"site {i}") for n in (30, 38, 39, 40, 41, 42, 50) for i in range(n)]
    assert run(spark, docs, 40) == brute(docs, 40)


def test_long_and_empty(spark):
    long = "\n".join(f"l{i % 50}" for i in range(20_000))
    docs = [(i, long, f"s{i}") for i in range(3)]
    assert run(spark, docs, 3) == brute(docs, 3)
    assert run(spark, [], 2) == []


def test_long_lines_from_fewer_sites(spark):
    long, mid = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    docs = [(i, f"{long}\n{mid}\nown {i}", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = rows(linededup.dedup_lines(df, 10, long_sites=3).select("doc_id", "n_removed", "text"))
    assert got == [(0, 0, docs[0][1]), (1, 1, f"{mid}\nown 1"), (2, 1, f"{mid}\nown 2")]
    assert not any(n for _, n in rows(linededup.dedup_lines(df, 10, long_sites=4).select("doc_id", "n_removed")))
    assert not any(n for _, n in rows(linededup.dedup_lines(df, 10).select("doc_id", "n_removed")))


def test_plan_is_native(spark, documents):
    plan = linededup.dedup_lines(documents)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
