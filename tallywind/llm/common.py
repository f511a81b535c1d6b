"""Shared helpers: table access and the expressions several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.session import materialize, prepare, ship_by_value

WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "table", "store", "prepare", "ship_by_value", "unit_hash", "letters", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: a Parquet table in the folder ``spark.checkpoint.dir`` names, read back."""
    return materialize(df, f"llm-{label}")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on key and seed alone (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def letters(text: Column) -> Column:
    """Share of letters and blanks among the characters; 0 for an empty text."""
    n = F.length(text)
    kept = F.length(F.regexp_replace(text, r"[^\p{L} \n]+", ""))
    return F.when(n > 0, kept / n).otherwise(F.lit(0.0))
