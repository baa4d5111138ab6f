"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed letter trigrams.  A document is a
mixture: expectation-maximisation estimates the languages' proportions from the
likelihoods of its trigrams.  Sets of the leading 1, 2, ... languages are fitted,
and the set with the highest penalised likelihood (half of PENALTY times the
logarithm of the number of trigrams for each further language) is the document's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import prepare

BUCKETS_LOG2 = 16
#: About so many documents of each language are sampled for training.
TRAIN_DOCS = 2000
#: Pseudo-observations of each trigram, of the pooled distribution.
SMOOTHING = 0.5
ITERATIONS = 25
#: Trigrams of a text overlap, and words repeat, so an observation counts for less than an independent one.
PENALTY = 24.0
#: Languages below this share of the full mixture are not tried.
LEAST_SHARE = 0.02
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a whole text, lower-cased, words padded by one space; empty without letters."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter | np.r_[True, letter[:-1]]
    c = np.where(letter, cp, 32)[keep].astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)) ^ (c[2:] * np.uint64(0xD6E8FEB86659FD93))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


class MixtureModel:
    """Trigram distributions of the learned languages."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        pooled = counts.sum(0) + 1.0
        pooled = pooled / pooled.sum() * len(pooled) * SMOOTHING
        smoothed = counts + pooled
        self.p = (smoothed / smoothed.sum(1, keepdims=True)).T.astype(np.float64).copy()  # bucket x language
        #: Mean log likelihood of a trigram in each language, of random ones and of its own.
        self.random, self.typical = np.log(self.p).mean(0), (self.p * np.log(self.p)).sum(0)

    @staticmethod
    def _fit(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """(proportions, log likelihood) of a mixture of the columns of p, for counts n."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        for _ in range(ITERATIONS):
            new = share * ((n / (p @ share)) @ p) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> list[tuple[str, float]]:
        """The document's languages with their proportions, largest first; empty for null and for texts without letters."""
        return self.mixture(text)[0]

    def mixture(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """(languages with proportions as of infer, how well they explain the text: 0 as random trigrams, 1 as their own on the average)."""
        grams = trigrams(text) if text and self.langs else ()
        if not len(grams):
            return [], 0.0
        counts = np.bincount(grams, minlength=1 << BUCKETS_LOG2)
        seen = np.flatnonzero(counts)
        p, n = self.p[seen], counts[seen].astype(np.float64)
        share, _ = self._fit(p, n)
        singles = n @ np.log(p)
        order = [int(np.argmax(singles))]
        order += [int(i) for i in np.argsort(-share, kind="stable") if i != order[0] and share[i] >= LEAST_SHARE]
        best, best_score, likely = (order[:1], np.ones(1)), float(singles[order[0]]), float(singles[order[0]])
        for m in range(2, len(order) + 1):
            own, fit = self._fit(p[:, order[:m]], n)
            score = fit - PENALTY / 2 * (m - 1) * np.log(n.sum() + 1)
            if score <= best_score:
                break
            best, best_score, likely = (order[:m], own), score, fit
        found = sorted(((self.langs[i], float(s)) for i, s in zip(*best, strict=True)), key=lambda x: (-x[1], x[0]))
        low, high = (float(x[best[0]] @ best[1]) for x in (self.random, self.typical))
        return found, float((likely / n.sum() - low) / max(high - low, 1e-9))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> MixtureModel:
    """Fit the distributions to about ``per_language`` whole documents of each language.

    The sample is chosen by a hash of the text, so it does not depend on
    partitioning, and of equal texts it takes one.  Rows with a null text or language do not count.  One count
    for each language, and at most 2^BUCKETS_LOG2 sums for each, come to the driver.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(totals)
    counts = np.zeros((len(langs), 1 << BUCKETS_LOG2))
    if not langs:
        return MixtureModel([], counts)
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, F.lit(per_language / totals[k])).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch["text"], batch["lang"], strict=True):
                held = own.setdefault(k, np.zeros(1 << BUCKETS_LOG2, np.int64))
                held += np.bincount(trigrams(t), minlength=len(held))
        for k, held in own.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"lang": k, "bucket": at, "n": held[at]})

    sums = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    at = {k: i for i, k in enumerate(langs)}
    who = np.array([at[k] for k in sums["lang"].to_pylist()], np.int64)
    counts[who, sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return MixtureModel(langs, counts)


def language(docs: DataFrame, model: MixtureModel, text: str = "text") -> Column:
    """A column struct(lang_pred, score, langs, shares, fit) for the whole texts of docs.

    lang_pred: the language of the largest proportion, ``und`` if the text is
    null or has no letter; score: that proportion, 0 for ``und``; fit: how
    well the whole mixture explains the text, about 0 where it does no better
    than for random letters, about 1 for ordinary texts, 0 for ``und``.  Ties go to the first language in order.  The model is as large as its languages, not the data.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, langs array<string>, shares array<double>, fit double")
    def infer(texts: pd.Series) -> pd.DataFrame:
        both = [shared.value.mixture(t) for t in texts]
        found = [x for x, _ in both]
        return pd.DataFrame({
            "lang_pred": [x[0][0] if x else UNDETERMINED for x in found],
            "score": [min(1.0, x[0][1]) if x else 0.0 for x in found],
            "langs": [[k for k, _ in x] for x in found],
            "shares": [[s for _, s in x] for x in found],
            "fit": [g for _, g in both],
        })

    return infer(F.col(text).cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents that are not held out; rows without an id are neither."""
    return docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang")


def crc_fold(doc_id: int) -> int:
    """The fold of an id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3
