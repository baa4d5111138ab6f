import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from entailis.llm import langid
from entailis.llm.queries import TOKENIZER

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each, as lists of rows."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokens"]
    assert all(set(s[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for s in stages[:5])
    assert all(r.n_chars == len(r.text) for s in stages[2:5] for r in s if r.n_chars is not None)


def test_language_stage_keeps_clean_documents(spark, stages):
    before, after = stages[0], stages[1]
    model = langid.train(langid.training_rows(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if (x := model.mixture(r.text))[0] and x[1] >= corpus_pipeline.LEAST_FIT}
    assert len(after) >= 0.99 * len(before)


def test_line_stage_against_plain_version(stages):
    from test_linededup import brute

    from entailis.llm.linededup import MIN_SITES

    expected = {k: t for k, _, _, t in brute([(r.doc_id, r.text, r.source) for r in stages[1]], MIN_SITES)}
    assert {r.doc_id: r.text for r in stages[2]} == expected


def test_near_dedup_stage_against_plain_version(stages):
    from test_neardup import shingle_set

    rows = sorted(stages[2], key=lambda r: r.doc_id)
    sets, post, group = {r.doc_id: shingle_set(r.text) for r in rows}, {}, {r.doc_id: r.doc_id for r in rows}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for r in rows:
        shared = {}
        for s in sets[r.doc_id]:
            for o in post.setdefault(s, []):
                shared[o] = shared.get(o, 0) + 1
            post[s].append(r.doc_id)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(sets[o]) + len(sets[r.doc_id]) - n):
                a, b = sorted((find(o), find(r.doc_id)))
                group[b] = a
    assert {r.doc_id for r in stages[3]} == {k for k in group if find(k) == k}


def test_decontamination_stage_against_plain_version(spark, stages):
    from test_decontaminate import words

    windows = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        windows.setdefault(min(13, len(w)), set()).update(tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12)))
    kept = set()
    for r in stages[3]:
        w = words(r.text)
        hit = {p for m, ps in windows.items() if m for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in ps for p in range(k, k + m)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(r.doc_id)
    assert {r.doc_id for r in stages[4]} == kept
    texts = {r.doc_id: r.text for r in stages[3]}
    assert all(r.text == texts[r.doc_id] for r in stages[4])


def test_token_stage(stages):
    tok = Tokenizer.from_file(TOKENIZER)
    texts = {r.doc_id: r.text for r in stages[4]}
    assert {r.doc_id for r in stages[5]} == set(texts)
    for r in stages[5]:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_its_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(stages[5])


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the and of the", "en", None, 14), (3, "the and of the", "en", None, 14), (None, "the and of the", "en", "b", 14), (4, "123", None, "c", 3), (5, "the and " * 9000, "en", "c", 72000)]
    for given in (rows, rows[:1], []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
            if name == "near_dedup":
                assert {r.doc_id for r in docs.collect()} == ({3, None, 5} if given is rows else set())
