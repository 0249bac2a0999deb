"""Bands, labels and tolerant readers of loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of bands, and caps of scores by evidence.
BANDS = ((85, "high"), (70, "good"), (50, "fair"))
LEVELS = ((80, "strong"), (60, "medium"))
CAPS = {"strong": 100, "medium": 74, "weak": 64, "none": 70}
# End of fixed values.


def banded(score: Column, bands=BANDS, rest: str = "low") -> Column:
    out = F.when(score.isNull(), F.lit(None))
    for least, name in bands:
        out = out.when(score >= least, name)
    return out.otherwise(rest)


def clamped(x: Column, least: int = 0, most: int = 100) -> Column:
    return F.round(F.least(F.greatest(x, F.lit(least)), F.lit(most)))


def truthy(c: Column) -> Column:
    """true, 1, yes and their like; null if it's neither true nor false."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def number(c: Column) -> Column:
    return F.try_to_number(F.regexp_replace(c, "[,\\s]", ""), F.lit("S999999999999.999999")).cast("double")


def duration(ms: Column) -> Column:
    """A duration for people: milliseconds, seconds, minutes and seconds, hours and minutes."""
    s = F.floor(ms / 1000)
    return (
        F.when(ms.isNull(), "-")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))
    )


def labelled(c: Column, names: dict[str, str]) -> Column:
    """A name from a dictionary, else the value in title case with blanks for underscores."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))
