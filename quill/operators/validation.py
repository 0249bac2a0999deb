"""Data-quality rules: a row for each rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, tuple[str, Column | str]], strict: bool = False) -> DataFrame:
    """key, code, level of each broken rule. rules maps a code to its level (error or warning) and the condition that breaks it.

    All rules are looked at in one pass. With strict, warnings are errors.
    """
    found = [
        F.when(F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit("error" if strict else level).alias("level")))
        for code, (level, c) in rules.items()
    ]
    return df.select(key, F.inline(F.array_compact(F.array(*found))))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has: what a unique constraint would refuse."""
    return df.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def forbidden(text: Column, words: list[str], negations: list[str], within: int = 16) -> Column:
    """Whether a word stands there that no negation precedes within so many characters."""
    return text.rlike(f"(?<!(?:{'|'.join(negations)}).{{0,{within}}})(?:{'|'.join(words)})")
