"""Word-bank lookups (B1-B4).

The bank is joined on equality. It is broadcast only after its row count is
checked against ``max_broadcast``; a larger bank is left to the planner (shuffle
hash / sort-merge join, AQE may still switch at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import broadcast

from tamis.sources.wordbank import by_type  # noqa: F401  (B4 lives with the loader)


def _sized(bank: DataFrame, max_broadcast: int) -> DataFrame:
    n = bank.limit(max_broadcast + 1).count()
    return broadcast(bank) if n <= max_broadcast else bank


def _side(bank: DataFrame, col: str, max_broadcast: int) -> DataFrame:
    return _sized(bank.select(F.col("word").alias(col), "type", "severity", "action"), max_broadcast)


def lookup(df: DataFrame, col: str, bank: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """B1: every row of ``df`` with the bank record of ``df[col]`` (NULLs when unlisted)."""
    return df.join(_side(bank, col, max_broadcast), col, "left")


def is_listed(df: DataFrame, col: str, bank: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    return df.join(_side(bank, col, max_broadcast).select(col), col, "left_semi")


def not_listed(df: DataFrame, col: str, bank: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    return df.join(_side(bank, col, max_broadcast).select(col), col, "left_anti")


def words(bank: DataFrame) -> DataFrame:
    """B2: all keywords (no defined order, as in the reference)."""
    return bank.select("word", "type", "severity", "action")


def bank_size(bank: DataFrame) -> DataFrame:
    """B3: one row, the number of distinct words."""
    return bank.agg(F.countDistinct("word").alias("n_words"))


size = bank_size  # B3 under the inventory's name
