"""Built-in dimensions of a bundle, each a column of array<string> (or a string: no value if null or empty)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.events import at, filled, reclassified, values
from ..functions.rules import referrer
from ..functions.stats import score_vital


def user_agent() -> Column:
    return urls.prefixes(F.split("userAgent", ":", -1), ":")


def url(year: int | None = None) -> Column:
    """The URL with identifiers in its path masked, or the bundle's domain."""
    return F.coalesce(F.nullif(F.col("domain"), F.lit("")), urls.masked(F.col("url"), year))


def plain_url() -> Column:
    return F.coalesce(F.nullif(F.col("domain"), F.lit("")), urls.plain(F.col("url")))


def checkpoint() -> Column:
    return F.array_distinct(F.transform(reclassified(), lambda e: e["checkpoint"]))


def vitals() -> Column:
    """goodLCP, niCLS and so on, over vitals that aren't 0."""
    return F.array_compact(F.array(*[F.when(F.col(f"cwv{n}") != 0, F.concat(score_vital(F.col(f"cwv{n}"), n), F.lit(n))) for n in ("LCP", "CLS", "INP")]))


def lcp_target() -> Column:
    return values("cwv-lcp", "target")


def lcp_source() -> Column:
    return values("cwv-lcp", "source")


def acquisition_source() -> Column:
    """Prefixes of the last acquisition's classification."""
    last = F.try_element_at(F.filter(reclassified(), at("acquisition")), F.lit(-1))["source"]
    return F.coalesce(filled(urls.prefixes(F.split(last, ":", -1), ":")), F.array().cast("array<string>"))


def enter_source() -> Column:
    """Referring URLs; known ones also as type:vendor, type and *:vendor."""
    found = F.filter(F.transform(values("enter", "source"), urls.without_fragment), lambda u: u.isNotNull())

    def named(u: Column) -> Column:
        r = referrer(u)
        return F.when(r.isNull(), F.array(u)).otherwise(F.array(u, F.concat(r["type"], F.lit(":"), r["vendor"]), r["type"], F.concat(F.lit("*:"), r["vendor"])))

    return F.flatten(F.transform(found, named))


def media_target() -> Column:
    """Media URLs without query and fragment; only the path on the page's own host."""
    return F.filter(F.transform(values("viewmedia", "target"), lambda t: urls.media(t, F.col("url"), F.col("host"))), lambda u: u.isNotNull())


def checkpoint_source(name: str) -> Column:
    return F.array_distinct(values(name, "source", reclassified(campaigns=False)))


def checkpoint_target(name: str) -> Column:
    return F.array_distinct(values(name, "target", reclassified(campaigns=False)))


FACETS = {
    "userAgent": user_agent, "url": url, "plainURL": plain_url, "checkpoint": checkpoint, "vitals": vitals, "lcpTarget": lcp_target, "lcpSource": lcp_source,
    "acquisitionSource": acquisition_source, "enterSource": enter_source, "mediaTarget": media_target,
}

# Names that a facet key may have.
KNOWN_CHECKPOINTS = (
    "loadresource cwv cwv2 cwv-lcp cwv-cls cwv-inp cwv-ttfb click top viewmedia viewblock enter error navigate utm reload back_forward missingresource audience experiment "
    "formsubmit 404 convert search unsupported noscript consent paid email login signup language prerender redirect acquisition fill"
).split()
KNOWN_FACETS = "userAgent url type conversions checkpoint trafficsource traffictype entryevent pagetype loadtype contenttype interaction clicktarget exit vitals".split()
KNOWN_SUFFIXES = ("source", "target", "histogram")
_KEY = r"^([A-Za-z]+)(?:\.([A-Za-z]+))?([!~])?$"


def is_known_facet(key: str) -> bool:
    """facet[.suffix][! or ~] of letters, with names from the lists."""
    m = re.match(_KEY, key)
    return bool(m) and not key.endswith("\n") and m[1] in KNOWN_FACETS + KNOWN_CHECKPOINTS and (not m[2] or m[2] in KNOWN_SUFFIXES)


def known_facet(key: Column) -> Column:
    """is_known_facet as a column."""
    suffix = F.regexp_extract(key, _KEY, 2)
    return key.rlike(_KEY) & F.regexp_extract(key, _KEY, 1).isin(KNOWN_FACETS + KNOWN_CHECKPOINTS) & ((suffix == "") | suffix.isin(*KNOWN_SUFFIXES))
