"""Short number formats for final output, in Python and as an Arrow function."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["", "k", "m", "b", "t"]


def significant(x: Decimal, digits: int) -> Decimal:
    """At most `digits` significant digits; halves go away from zero."""
    if not x:
        return x
    return x.quantize(Decimal(1).scaleb(x.adjusted() - digits + 1), rounding=ROUND_HALF_UP)


def to_human_readable(number: float | None, precision: int = 2) -> str:
    """Compact, lower case, at most `precision` significant digits; `-` for NaN or null."""
    if number is None or math.isnan(number):
        return "-"
    x = Decimal(repr(number)) if isinstance(number, float) else Decimal(number)
    unit = 0 if not x else min(4, max(0, x.adjusted() // 3))
    y = significant(x.scaleb(-3 * unit), max(1, precision))
    if abs(y) >= 1000 and unit < 4:
        unit, y = unit + 1, y.scaleb(-3)
    text = f"{y:f}"
    whole, _, rest = text.partition(".")
    rest = rest.rstrip("0")
    sign, whole = ("-", whole[1:]) if whole.startswith("-") else ("", whole)
    grouped = f"{int(whole):,}" if len(whole) > 4 else whole  # four digits stand together
    return f"{sign}{grouped}{'.' + rest if rest else ''}{UNITS[unit]}"


def _plain(x: float) -> str:
    """The shortest decimal text of a number."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e21 else repr(float(x))


def _precision(x: float, digits: int) -> str:
    digits = max(1, digits)
    d = Decimal(x)
    if d == 0:
        return "0" + ("." + "0" * (digits - 1) if digits > 1 else "")
    return f"{d.quantize(Decimal(1).scaleb(d.adjusted() - digits + 1), rounding=ROUND_HALF_UP):f}"


def sampling_error(total: float, samples: float) -> float:
    if samples == 0:
        return 0
    weight = total / samples
    return math.floor(1.96 * math.sqrt(weight * weight * samples) + 0.5)


def round_to_confidence_interval(total: float, samples: float | None = None, max_precision: float = math.inf) -> str:
    """A number cut to the digits that both ends of its confidence interval share."""
    error = sampling_error(total, total if samples is None else samples)
    high, low = total + error, total - error
    a, b = (_precision(x, len(_plain(x))) for x in (high, low))
    most = math.inf if math.isnan(max_precision) else max_precision
    common = min(sum(x == y for x, y in zip(a, b)), most)
    return to_human_readable(total, int(max(min(2, most), common)))


def human_readable(c: Column, precision: int = 2) -> Column:
    """to_human_readable on a column of final results."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: to_human_readable(float(v), precision), na_action=None)

    return run(c.cast("double"))


def rounded_to_confidence(total: Column, samples: Column | None = None, max_precision: float = math.inf) -> Column:
    """round_to_confidence_interval on columns of final results."""

    @F.pandas_udf("string")
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else round_to_confidence_interval(a, a if pd.isna(b) else b, max_precision) for a, b in zip(t, n)])

    return run(total.cast("double"), (total if samples is None else samples).cast("double"))


def milliseconds(c: Column) -> Column:
    """Microseconds of final results as milliseconds with two decimals; the exact value of the quotient is rounded, halves up."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{Decimal(float(v) / 1000).quantize(Decimal('0.01'), rounding=ROUND_HALF_UP):f}ms", na_action="ignore")

    return run(c.cast("long"))
