"""Search parameters: validation, canonical key, search texts, topic variants."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source names, the order ``auto`` tries them in, and the fallback.
SOURCES = ("auto", "snscrape", "twscrape", "x_api", "news_rss")
AUTO_ORDER = ("x_api", "twscrape", "snscrape")
FALLBACK_SOURCE = "news_rss"
RECENT_SOURCE = "x_api"
RECENT_DAYS = 7


def _iso(day: date | None) -> str:
    return "" if day is None else day.isoformat()


@dataclass(frozen=True)
class SearchParams:
    """What to look for; these are driver-side settings, not data."""

    keyword: str | None = None
    hashtags: tuple[str, ...] = ()
    start_date: date | None = None
    end_date: date | None = None
    max_results: int = 100

    @property
    def tags(self) -> list[str]:
        """Hashtags with their ``#``, blanks left out."""
        stripped = (tag.strip() for tag in self.hashtags)
        return [tag if tag[0] == "#" else "#" + tag for tag in stripped if tag]

    @property
    def term(self) -> str:
        return (self.keyword or "").strip()

    def validate(self) -> SearchParams:
        if not (self.keyword or self.tags):
            raise ValueError("give a keyword or at least one hashtag")
        if self.max_results < 1:
            raise ValueError("max_results must be positive")
        if self.start_date and self.end_date and self.end_date < self.start_date:
            raise ValueError("start_date must not be after end_date")
        return self

    @property
    def source_query(self) -> str:
        """Canonical key of the search."""
        fields = {
            "keyword": self.term,
            "hashtags": ",".join(self.tags),
            "start": _iso(self.start_date),
            "end": _iso(self.end_date),
            "limit": str(self.max_results),
        }
        return ";".join(f"{name}={value}" for name, value in fields.items())

    def api_text(self) -> str:
        """Search text without date operators."""
        self.validate()
        return " ".join(([self.term] if self.keyword else []) + self.tags)

    def search_text(self) -> str:
        """Search text with ``since:`` and an exclusive ``until:``."""
        text = self.api_text()
        if self.start_date:
            text += f" since:{_iso(self.start_date)}"
        if self.end_date:
            text += f" until:{_iso(self.end_date + timedelta(days=1))}"
        return text

    def topic_variants(self) -> list[str]:
        """Broad to narrow topic texts, each once regardless of case."""
        self.validate()
        topics = [t for t in (tag.lstrip("#").strip() for tag in self.tags) if t]
        words = ([self.term] if self.term else []) + topics
        variants = [" ".join(words)]
        variants += [f"{self.term} {topic}" for topic in topics if self.term]
        variants.append(" ".join(topics))
        if len(words) > 1:
            variants.append(" OR ".join(words))
        squeezed = (" ".join(v.split()) for v in variants + words)
        first = {}
        for variant in squeezed:
            first.setdefault(variant.casefold(), variant)
        first.pop("", None)
        return list(first.values())

    def recent_bounds(self, now: datetime) -> tuple[datetime | None, datetime | None]:
        """Start and exclusive end of the search, for a source that keeps 7 days."""

        def midnight(day: date) -> datetime:
            return datetime.combine(day, time.min, tzinfo=timezone.utc)

        start = midnight(self.start_date) if self.start_date else None
        end = min(midnight(self.end_date + timedelta(days=1)), now) if self.end_date else None
        if start is not None:
            if start < now - timedelta(days=RECENT_DAYS):
                raise ValueError(f"start_date {self.start_date} is older than {RECENT_DAYS} days")
            if start > now:
                raise ValueError("start_date is in the future")
            if end is not None and start >= end:
                raise ValueError("the search window is empty")
        return start, end


def tags_column(hashtags: Column) -> Column:
    """Normalized hashtags of a table of searches."""
    stripped = F.filter(F.transform(hashtags, lambda t: F.btrim(t)), lambda t: t != "")
    return F.transform(
        stripped,
        lambda t: F.when(F.startswith(t, F.lit("#")), t).otherwise(F.concat(F.lit("#"), t)),
    )


def source_query_column(
    keyword: Column, hashtags: Column, start: Column, end: Column, limit: Column
) -> Column:
    """Canonical keys for a table of searches."""

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    return F.concat(
        F.lit("keyword="), F.btrim(text(keyword)),
        F.lit(";hashtags="), F.array_join(tags_column(hashtags), ","),
        F.lit(";start="), text(start),
        F.lit(";end="), text(end),
        F.lit(";limit="), text(limit),
    )


def resolve_source(requested: str, available: tuple[str, ...] = ()) -> tuple[str, str]:
    """Requested and concrete source; ``auto`` takes the first one available."""
    name = requested.lower()
    if name not in SOURCES:
        raise ValueError(f"unsupported source: {name}")
    if name != "auto":
        return name, name
    found = [s for s in AUTO_ORDER if s in available]
    return name, found[0] if found else AUTO_ORDER[-1]
