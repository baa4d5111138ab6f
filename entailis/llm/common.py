"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailis.plans.shared import checkpoint, release, remove, shared_dir, ship_package

__all__ = ["LOWER_ASCII", "UPPER", "ascii_lower", "checkpoint", "prepare", "release", "remove", "shared_dir", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_ASCII = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Before Python runs on executors: its code goes there, and Arrow batches hold at most this many rows.

    Smaller batches keep long texts from adding up in a Python worker.
    """
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())
