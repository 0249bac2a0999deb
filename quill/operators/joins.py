"""Joins that no built-in expresses alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_one(left: DataFrame, right: DataFrame, ref: str, keys: Sequence[str], newest: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Each left row with the one right row that ref names: by the first of keys that matches, and there the newest.

    The right side is brought down to a row a key before it meets the left, so the left, however large, is neither
    multiplied nor ranked. take are the right columns to keep; left rows without a match get nulls.
    """
    out = left
    for n, key in enumerate(keys):
        best = right.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{n}")).agg(F.max_by(F.struct(*take), F.struct(*newest)).alias(f"__v{n}"))
        out = out.join(best, F.col(ref) == F.col(f"__k{n}"), "left")
    picked = F.coalesce(*(F.col(f"__v{n}") for n in range(len(keys))))
    return out.select(*left.columns, *(picked[c].alias(c) for c in take))


def first_match(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], take: Sequence[str], order: str) -> DataFrame:
    """Each left row with the right row that the first matching pair of columns finds; among equals the smallest by order. rule is that pair's number, from 0."""
    out = left
    for n, (_, key) in enumerate(pairs):
        best = right.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{n}")).agg(F.min_by(F.struct(*take), order).alias(f"__v{n}"))
        out = out.join(best, F.col(pairs[n][0]) == F.col(f"__k{n}"), "left")
    found = [F.col(f"__v{n}") for n in range(len(pairs))]
    rule = F.coalesce(*(F.when(v.isNotNull(), n) for n, v in enumerate(found)))
    return out.select(*left.columns, rule.alias("rule"), *(F.coalesce(*found)[c].alias(c) for c in take))


def dangling(references: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """References that no target has; null references aren't dangling."""
    return references.filter(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def neighbours(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges (source, target) one step from a node: down follows them, up goes against them."""
    down, up = F.col("source") == node, F.col("target") == node
    return edges.filter({"down": down, "up": up}.get(direction, down | up))


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. df should be aggregated first, so that a group is small."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page under a total order; Spark keeps only limit + offset rows of each task."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str, replace: dict[str, Column]) -> DataFrame:
    """old with new's rows by key: missing rows are inserted, and of matching ones the columns named take the given values.

    Values may use old's columns as o.<name> and new's as n.<name>.
    """
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    values = []
    for c in old.columns:
        both = replace.get(c, F.col(f"o.{c}"))
        mine = F.when(F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull(), both)
        values.append(mine.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    action = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "kept").otherwise("matched")
    return joined.select(*values, action.alias("action"))
