"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, shared_dir

__all__ = ["WORD", "discard", "let", "load", "materialise", "only", "shared_dir", "small_batches", "word_count"]

#: Rows that go to a Python worker at once: texts can be long.
BATCH_ROWS = 1000

#: A word: a maximal run of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; from now on its session sends Python workers at most BATCH_ROWS rows at once (Spark's default of 10,000 texts is held several times over). A lower setting stays."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row (a lambda variable instead of a repeated expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, null text: 0. Each word becomes one mark; no list of words is built."""
    marks = F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names: extra columns and clashing names of the input stay out of an operator's way."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])
