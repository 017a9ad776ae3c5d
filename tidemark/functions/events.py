"""Event arrays: reclassification, filters and distinct values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import acquisition, consent, let

EVENTS = "events"


def some(condition, events: str | Column = EVENTS) -> Column:
    return F.coalesce(F.exists(events, condition), F.lit(False))


def count(condition, events: str | Column = EVENTS) -> Column:
    return F.size(F.filter(events, condition))


def at(checkpoint: str):
    return lambda e: e["checkpoint"] == checkpoint


def _event(checkpoint: Column, source: Column, target: Column) -> Column:
    return F.named_struct(F.lit("checkpoint"), checkpoint, F.lit("source"), source, F.lit("target"), target)


def _same(e: Column) -> Column:
    return _event(e["checkpoint"], e["source"], e["target"])


def _nothing() -> Column:
    return F.lit(None).cast("string")


def with_consent(e: Column) -> Column:
    """A click on a consent dialog becomes a consent event with the vendor's action as its target."""
    named = let(consent(e["source"]), lambda c: F.when(c.isNotNull(), _event(F.lit("consent"), _nothing(), c["target"])).otherwise(_same(e)))
    return F.when(e["checkpoint"] == "click", named).otherwise(_same(e))


def with_acquisition(e: Column) -> Column:
    """Campaign events become acquisition events whose source is the classification, if there is one."""
    origin = F.when(e["checkpoint"] == "utm", e["target"]).otherwise(e["source"])
    utm = (e["checkpoint"] == "utm") & F.lower(e["source"]).isin("utm_source", "utm_medium")
    applies = F.coalesce(utm | e["checkpoint"].isin("paid", "email"), F.lit(False))
    kind = F.when(e["checkpoint"] == "paid", "paid")
    named = let(acquisition(origin, kind), lambda a: F.when(a != "", _event(F.lit("acquisition"), a, _nothing())).otherwise(_same(e)))
    return F.when(applies, named).otherwise(_same(e))


def reclassified(events: str | Column = EVENTS, campaigns: bool = True) -> Column:
    named = F.transform(events, with_consent)
    return F.transform(named, with_acquisition) if campaigns else named


def filled(values: Column) -> Column:
    """Without null and empty strings."""
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def values(checkpoint: str, field: str, events: str | Column = EVENTS) -> Column:
    return filled(F.transform(F.filter(events, at(checkpoint)), lambda e: e[field]))
