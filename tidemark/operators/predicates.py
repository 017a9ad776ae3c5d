"""Filter specs {facet: desired values} as one boolean column."""

from __future__ import annotations

import functools
import logging
import operator
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def _desired(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def some(found: Column, values: Iterable) -> Column:
    return F.coalesce(F.arrays_overlap(found, _desired(values)), F.lit(False))


def every(found: Column, values: Iterable) -> Column:
    return F.size(F.array_except(_desired(values), F.coalesce(found, F.array().cast("array<string>")))) == 0


def none(found: Column, values: Iterable) -> Column:
    """Not every: at least one desired value is missing."""
    return ~every(found, values)


def never(found: Column, values: Iterable) -> Column:
    """Not some: all desired values are missing."""
    return ~some(found, values)


COMBINERS = {"some": some, "every": every, "none": none, "never": never}
#: A facet's own filter is left out of its counts for these combiners.
SKIPS_OWN, SKIPS_NEGATED = ("some", "none"), ("none", "never")


def as_values(values) -> list[str]:
    """A lone value stands for a list of it."""
    values = [values] if isinstance(values, (str, int, float, bool)) else list(values)
    return [str(v) for v in values]


def active(spec: Mapping) -> dict[str, list[str]]:
    """The facets of a spec with desired values."""
    return {k: v for k, v in ((k, as_values(v)) for k, v in spec.items()) if v}


def conditions(spec: Mapping, found: Mapping[str, Column], combiners: Mapping[str, str], strict: bool = False) -> dict[str, Column]:
    """A condition per facet with desired values. An unknown facet matches nothing, or raises if strict."""
    out = {}
    for name, values in active(spec).items():
        if name in found:
            out[name] = COMBINERS[combiners[name]](found[name], values)
        elif strict:
            raise KeyError(f"unknown facet {name}")
        else:
            log.warning("unknown facet %s in a filter: nothing matches", name)
            out[name] = F.lit(False)
    return out


def conjunction(parts: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, parts, F.lit(True))
