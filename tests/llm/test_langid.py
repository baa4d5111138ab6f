import math

import numpy as np

from entailis.llm import langid
from entailis.llm.queries import op6_langid


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op6_langid(spark, folder).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (langid.crc_fold(r.doc_id) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99


def test_mixtures_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    texts = {k: [r.text for r in docs.where(f"lang = '{k}' and length(text) > 2000").orderBy("doc_id").limit(12).collect()] for k in ("fr", "de")}
    for a, b in zip(texts["fr"], texts["de"], strict=True):
        found = dict(model.infer(a[:1500] + "\n" + b[:1500]))
        assert set(found) == {"fr", "de"} and abs(found["fr"] - 0.5) < 0.2
    assert [k for k, _ in model.infer(texts["fr"][0])] == ["fr"]


def plain_mixture(model, text):
    """Mixture inference letter by letter, with dictionaries: sets of the leading languages, each fitted by expectation-maximisation."""
    words = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in words:
        words = words.replace("  ", " ")
    counts = {}
    for i in range(len(words) - 2):
        b = int(langid.trigrams(words[i : i + 3].strip() if words[i] == " " or words[i + 2] == " " else words[i : i + 3])[{(True, False): 0, (False, True): -1, (True, True): 0, (False, False): 1}[words[i] == " ", words[i + 2] == " "]]) if words[i + 1] != " " else None
        b = between(words[i], words[i + 2]) if b is None else b
        counts[b] = counts.get(b, 0) + 1
    total = sum(counts.values())

    def fit(of):
        share = {k: 1 / len(of) for k in of}
        for _ in range(langid.ITERATIONS):
            new = dict.fromkeys(of, 0.0)
            for b, n in counts.items():
                whole = sum(share[k] * model.p[b, k] for k in of)
                for k in of:
                    new[k] += n * share[k] * model.p[b, k] / whole / total
            done = max(abs(new[k] - share[k]) for k in of) < 1e-4
            share = new
            if done:
                break
        return share, sum(n * math.log(sum(share[k] * model.p[b, k] for k in of)) for b, n in counts.items())

    everyone = range(len(model.langs))
    share, _ = fit(everyone)
    first = max(everyone, key=lambda k: (sum(n * math.log(model.p[b, k]) for b, n in counts.items()), -k))
    order = [first] + sorted((k for k in everyone if k != first and share[k] >= langid.LEAST_SHARE), key=lambda k: (-share[k], k))
    best, score = fit(order[:1])
    for m in range(2, len(order) + 1):
        own, likely = fit(order[:m])
        likely -= langid.PENALTY / 2 * (m - 1) * math.log(total + 1)
        if likely <= score:
            break
        best, score = own, likely
    return {model.langs[k]: s for k, s in best.items()}


def between(a, c):
    """The bucket of the trigram of two words' ends."""
    return int(langid.trigrams(f"{a} {c}")[1])


def test_against_a_plain_mixture(documents):
    model = langid.train(documents)
    rows = [r.text for r in documents.where("length(text) between 40 and 400").orderBy("doc_id").limit(12).collect()]
    for text in rows + [rows[k] + " " + rows[k + 1] for k in range(0, 10, 2)]:
        found, plain = dict(model.infer(text)), plain_mixture(model, text)
        assert found.keys() == plain.keys() and all(abs(found[k] - plain[k]) < 1e-6 for k in plain)


def test_several_languages_are_likely_and_others_are_not(documents):
    model = langid.train(documents)
    pure = {k: [t for (t,) in documents.where(f"lang = '{k}' and length(text) > 1500").orderBy("doc_id").select("text").collect() if [x for x, _ in model.infer(t)] == [k]] for k in ("en", "fr", "de")}
    found, well = model.mixture("\n".join(" ".join(t)[:5000] for t in pure.values()))
    assert {k for k, _ in found} == {"en", "fr", "de"} and found[0][1] < 0.5 and well > 0.8
    assert all(model.mixture(t)[1] < 0.2 for t in ("xqzvk wkjq zzxq qqwx vvkq jjxz", "字字 漢語 文章", "Привет мир, это текст"))
    assert model.mixture(None) == ([], 0.0)


def test_likelihood_rises(spark, documents):
    model = langid.train(documents)
    p, n = model.p[:200], np.arange(1.0, 201.0)
    share = np.full(p.shape[1], 1 / p.shape[1])
    last = -np.inf
    for _ in range(10):
        now = n @ np.log(p @ share)
        assert now >= last - 1e-9
        last = now
        share = share * ((n / (p @ share)) @ p) / n.sum()
    assert np.isclose(share.sum(), 1)


def test_odd_texts(spark, docs, documents):
    model = langid.train(documents)
    df = docs((1, None), (2, ""), (3, "123 !! \n"), (4, "the and of " * 4), (4, "the and of " * 4), (None, "a"), (6, "字" * 20_000), (7, "THE AND OF THE")).withColumnRenamed("source", "langs")
    got = {r.doc_id: r.x for r in df.select("doc_id", langid.language(df, model).alias("x")).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3))
    assert got[4].lang_pred == got[7].lang_pred == "en" and got[None].lang_pred != "und" and got[6].lang_pred != "und"
    assert df.limit(0).select(langid.language(df, model)).count() == 0


def test_nothing_to_learn_from(spark, docs):
    df = docs((1, "words", None), (2, None, "en"))
    model = langid.train(df)
    assert model.langs == [] and df.select(langid.language(df, model).lang_pred).distinct().collect()[0][0] == "und"


def test_folds(spark, docs):
    df = docs(*((i, "x") for i in range(50)), (None, "x"))
    assert {r[0]: r[1] for r in df.select("doc_id", langid.held_out()).collect()} == {i: langid.crc_fold(i) == 1 for i in range(50)} | {None: False}
    assert langid.training_rows(df).count() == sum(langid.crc_fold(i) != 1 for i in range(50))
