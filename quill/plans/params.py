"""Parameters of the behaviour reports: blanks become nothing, limits are clamped, ranges are checked."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from quill.sources.tables import AS_OF

GRANULARITIES = ("hour", "day", "week", "month")


def clamp(value: int | None, default: int, least: int, most: int) -> int:
    return max(least, min(most, default if value is None else value))


def blank(value: str | None) -> str | None:
    return (value or "").strip() or None


def listed(values) -> list[str] | None:
    """Values that aren't empty; no list at all if none is left."""
    return [v for v in values or [] if v] or None


@dataclass(frozen=True)
class Filters:
    """What the reports can be narrowed down to; as_of stands for the present, start and end default to its last 30 days."""

    as_of: str = AS_OF
    start: str | None = None
    end: str | None = None
    search: str | None = None
    event_types: list[str] | None = field(default=None)
    module_ids: list[str] | None = field(default=None)
    policy_ref: str | None = None
    user_id: int | None = None
    session_id: str | None = None
    source: str | None = None
    granularity: str = "day"
    limit: int | None = None
    offset: int | None = None

    def normal(self, limit: int = 50, most: int = 200) -> Filters:
        end = blank(self.end) or self.as_of
        start = blank(self.start) or str(datetime.fromisoformat(end) - timedelta(days=30))
        if datetime.fromisoformat(start) >= datetime.fromisoformat(end):
            raise ValueError("the range's start isn't before its end")
        unit = (blank(self.granularity) or "day").lower()
        return Filters(
            self.as_of, start, end, blank(self.search), listed(self.event_types), listed(self.module_ids), blank(self.policy_ref), self.user_id,
            blank(self.session_id), blank(self.source), unit if unit in GRANULARITIES else "day", clamp(self.limit, limit, 1, most), max(0, self.offset or 0),
        )


def relative(window: str, as_of: str = AS_OF, start: str | None = None, end: str | None = None) -> Filters:
    """Filters of a named window: 24h (by hour), 7d, 30d, 90d, or custom dates, whose end day counts in full."""
    now = datetime.fromisoformat(as_of)
    if window == "custom":
        after = datetime.fromisoformat(end) + timedelta(days=1) if end else now
        return Filters(as_of, start or str(after - timedelta(days=30)), str(after), limit=50)
    back = {"24h": 1, "7d": 7, "90d": 90}.get(window, 30)
    return Filters(as_of, str(now - timedelta(days=back)), as_of, granularity="hour" if window == "24h" else "day", limit=50)
