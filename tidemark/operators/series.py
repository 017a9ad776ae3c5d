"""Built-in measures of a bundle. Null means the bundle doesn't contribute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.events import at, count, reclassified, some

_weight = lambda c: F.when(c, F.col("weight")).otherwise(0)


def page_views() -> Column:
    """Weight, or 0 for a page that was prerendered and never shown."""
    return _weight(~some(at("prerender")) | some(lambda e: (e["checkpoint"] == "navigate") & (e["target"] == "prerendered")))


def visits() -> Column:
    return _weight(F.col("visit"))


def bounces() -> Column:
    """Visits without a click."""
    return _weight(F.col("visit") & ~some(at("click")))


def vital(name: str) -> Column:
    return F.col(f"cwv{name.upper()}").cast("double")


def engagement() -> Column:
    """A click, or more than three blocks or media seen."""
    return _weight(some(at("click")) | (count(lambda e: e["checkpoint"].isin("viewmedia", "viewblock")) > 3))


def _unpaid(*barred: str) -> Column:
    sources = F.transform(F.filter(reclassified(), at("acquisition")), lambda e: e["source"])
    return _weight(F.col("visit") & ~F.coalesce(F.exists(sources, lambda s: F.substring_index(s, ":", 1).rlike("^(" + "|".join(barred) + ")")), F.lit(False)))


def earned() -> Column:
    """Visits with neither a paid nor an owned campaign."""
    return _unpaid("paid", "owned")


def organic() -> Column:
    """Visits without a paid campaign."""
    return _unpaid("paid")


SERIES = {
    "pageViews": page_views, "visits": visits, "bounces": bounces, "engagement": engagement, "earned": earned, "organic": organic,
    **{name: (lambda n=name: vital(n)) for name in ("lcp", "cls", "inp", "ttfb")},
}
