"""Duplicate groups and the order-dependent choice of canonical documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_groups(items: DataFrame, key: str = "key", item: str = "item") -> DataFrame:
    """Groups of two items or more that share a key; keys with the same set of items are one group.

    A group's identity is its sorted list of items, so a key that very many items share costs one list; such keys should be
    left out before (a key is meant to name one document).
    """
    groups = items.select(key, item).distinct().groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")).filter(F.size("items") > 1)
    return groups.groupBy("items").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is first by order, without a window: rows are summed up before the shuffle."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def greedy(items: DataFrame) -> DataFrame:
    """item, canonical, reason: the order-dependent choice within each block.

    items has block, item, seq, keys (array of text), score and url. In order of seq, an item joins the first canonical
    entry that shares a key with it, and the entry's keys grow by its own; the one with the higher score, then the smaller
    url, then the earlier, stands for the entry. An item that bridges two entries joins the first only, so the result isn't
    that of connected components. A block is bounded by what a run collects (hundreds of candidates), and one task folds it.
    """

    def fold(_, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: list[dict] = []
        where: dict[str, int] = {}
        out: dict[int, list] = {}
        for r in pd.concat(list(rows)).sort_values(["seq", "item"]).itertuples():
            keys = list(dict.fromkeys(r.keys))
            at = min((where[k] for k in keys if k in where), default=None)
            if at is None:
                at, reason = len(entries), "canonical"
                entries.append({"best": r, "items": []})
            else:
                reason = next(k for k in keys if where.get(k) == at).split(":", 1)[0]
                best = entries[at]["best"]
                if r.score > best.score or (r.score == best.score and r.url < best.url):
                    entries[at]["best"] = r
            entries[at]["items"].append((r.item, reason))
            for k in keys:
                where[k] = min(at, where.get(k, at))
        for e in entries:
            for item, reason in e["items"]:
                out.setdefault(item, [item, e["best"].item, "canonical" if item == e["best"].item and len(e["items"]) == 1 else reason])
        yield pd.DataFrame(list(out.values()), columns=["item", "canonical", "reason"])

    return items.groupBy("block").applyInPandas(lambda key, rows: next(fold(key, iter([rows]))), "item long, canonical long, reason string")
