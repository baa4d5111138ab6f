"""The training-data pipeline: five stages over documents, each an operator of entailis.llm.

Every stage reads what its predecessor wrote as Parquet.  All but the last
return the columns of documents; the last returns token digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailis.llm import decontaminate, langid, linededup, neardup, queries
from entailis.llm.common import remove, shared_dir, table

#: A document stays if its mixture of languages explains it so well, where 0 is like random letters and 1 like ordinary texts.
LEAST_FIT = 0.25


def free_name(docs: DataFrame) -> str:
    """A name that no column has."""
    name = "found"
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no mixture of the learned languages explains; texts in several languages stay.

    Where no labelled row teaches a language, only documents without letters go.
    Null texts have no letters.  Extra columns stay, whatever their names.
    """
    model = langid.train(langid.training_rows(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = free_name(docs)
    found = docs.withColumn(name, langid.language(docs, model))
    return found.where((F.col(f"{name}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{name}.fit") >= LEAST_FIT)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated cross-site lines out of the texts; every document stays."""
    done = linededup.dedup_lines(docs)
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.select(*(size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    copies = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; others stay as they are, null texts and extra columns of any name among them."""
    name = free_name(docs)
    found = docs.withColumn(name, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))
    bad = decontaminate.is_contaminated(F.col(f"{name}.n_words"), decontaminate.n_hit(name))
    return found.where(~bad).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each text that is left; null texts have no tokens, other columns are not read."""
    return queries.token_digests(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: Language identification, registers and merges have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder and read again; only the last one's rows are left there."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
