"""URLs as columns: pieces, normal forms, masking of identifiers, prefixes.

Normal forms are those of the URL standard: trimmed, scheme and host in lower case, no port
that the scheme implies, no dot segments, characters percent-encoded part by part. Hosts of
other alphabets stay as they are (no Punycode).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import let

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


# what is in normal form as it stands
NORMAL = r"^(https?)://([a-z0-9.-]+)(?![^?#]*(?:/\.|%2[eE]))(/[A-Za-z0-9._~!$&'()*+,;=:@%/-]*)(\?[A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?(#[A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?$"
# Fixed values of the URL standard: ports that are left out, and what is percent-encoded in each part beyond controls and other alphabets.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
ENCODED = {"path": ' "#<>?^`{}', "query": " \"#<>'", "fragment": ' "<>`'}


def trimmed(url: Column) -> Column:
    """Without spaces and controls at the ends, and without tabs and line breaks inside."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def encoded(text: Column, kind: str) -> Column:
    """Characters that a part of a URL may not hold, as percent and hexadecimal digits of UTF-8."""
    allowed = "".join("\\" + chr(k) for k in range(0x21, 0x7F) if chr(k) not in ENCODED[kind] and not chr(k).isalnum()) + "a-zA-Z0-9"
    one = lambda x: F.when(x.rlike(f"^[{allowed}]$"), x).otherwise(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    return let(text, lambda c: F.when(c.rlike(f"[^{allowed}]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c))


def without_dots(path: Column) -> Column:
    """A path that begins with / without . and .. segments, also percent-encoded ones."""
    one, two = "^(\\.|%2[eE])$", "^(\\.|%2[eE]){2}$"

    def step(acc: Column, x: Column) -> Column:
        return F.when(x.rlike(two), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x.rlike(one), acc).otherwise(F.concat(acc, F.array(x)))

    def kept(parts: Column) -> Column:
        out = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
        return F.array_join(F.concat(out, F.when(F.element_at(parts, -1).rlike(f"{one}|{two}"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")

    return let(path, lambda p: F.when(p.rlike(r"/(\.|%2[eE]){1,2}(/|$)"), let(F.split(p, "/", -1), kept)).otherwise(p))


def _host(scheme: Column, at: Column) -> Column:
    """Host in lower case, and its port unless it is the scheme's own."""
    port = F.create_map(*[F.lit(x) for name, n in DEFAULT_PORTS.items() for x in (name, f":{n}")])
    named = let(F.regexp_replace(F.lower(at), ":0*([0-9]*)$", ":$1"), lambda h: F.when(F.endswith(h, F.try_element_at(port, scheme)), F.regexp_replace(h, ":[0-9]*$", "")).otherwise(h))
    return F.regexp_replace(named, ":$", "")


def parsed(url: Column) -> Column:
    """A URL's normalised parts: scheme, user (with @), host (with port), path, query (with ?), fragment (with #); null if invalid."""
    def normal(u: Column) -> Column:
        part = lambda k: F.regexp_extract(u, URL, k)
        rest = lambda k, kind: let(part(k), lambda x: F.when(F.length(x) < 2, x).otherwise(F.concat(F.substring(x, 1, 1), encoded(F.substr(x, F.lit(2)), kind))))
        path = let(F.when(F.lower(part(1)).isin(*DEFAULT_PORTS), F.translate(part(4), "\\", "/")).otherwise(part(4)), lambda p: F.when(p == "", "/").otherwise(encoded(without_dots(p), "path")))
        fields = F.struct(
            F.lower(part(1)).alias("scheme"), part(2).alias("user"), _host(F.lower(part(1)), part(3)).alias("host"),
            path.alias("path"), rest(5, "query").alias("query"), rest(6, "fragment").alias("fragment"),
        )
        return F.when(u.rlike(URL) & ~u.rlike(r"^[^?#]*://[^/?#]*\s"), fields)

    def simple(u: Column) -> Column:
        """Most URLs have the normal form: they are only taken apart."""
        part = lambda k: F.regexp_extract(u, NORMAL, k)
        return F.struct(part(1).alias("scheme"), F.lit("").alias("user"), part(2).alias("host"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))

    return F.when(url.rlike(NORMAL), simple(url)).otherwise(let(trimmed(url), normal))


def origin(u: Column, user: bool = True) -> Column:
    """Of a parsed URL."""
    return F.concat(u["scheme"], F.lit("://"), u["user"] if user else F.lit(""), u["host"])


def without_fragment(url: Column) -> Column:
    return let(parsed(url), lambda u: F.concat(origin(u), u["path"], u["query"]))


def plain(url: Column) -> Column:
    """Without query, fragment, user and password; null if invalid."""
    return let(parsed(url), lambda u: F.concat(origin(u, user=False), u["path"]))


def masked(url: Column, year: int | None = None) -> Column:
    """Path segments that look like identifiers masked; numbers that begin with one of six years up to `year` stay."""
    now = F.lit(year) if year else F.year(F.current_date())
    years = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (now - i).cast("string"))

    def mask(s: Column) -> Column:
        slug = F.translate(s, "_", "-")
        return (
            F.when((F.length(s) >= 5) & s.rlike(r"^\d+$"), F.when(F.exists(years, lambda y: F.startswith(s, y)), s).otherwise("%3Cnumber%3E"))
            .when((F.length(s) >= 8) & s.rlike("^[0-9a-fA-F]+$"), "%3Chex%3E")
            .when((F.length(s) > 32) & s.rlike("^[a-zA-Z0-9+/]+={0,2}$"), "%3Cbase64%3E")
            .when((F.length(s) > 35) & s.rlike("^[0-9a-f-]+$"), "%3Cuuid%3E")
            .when((F.length(slug) > 60) & ~(slug.rlike(r"^[\s\w.-]+$") & slug.rlike(r"^(\w+-){3}")), "...")
            .otherwise(s)
        )

    segments = lambda p: F.array_join(F.transform(F.split(p, "/", -1), mask), "/")
    return let(parsed(url), lambda u: F.concat(origin(u), segments(u["path"]), u["query"], u["fragment"]))


def resolved(target: Column, base: Column) -> Column:
    """An absolute URL of target, relative to base."""
    def joined(t: Column, u: Column) -> Column:
        return (
            F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), t)
            .when(F.startswith(t, F.lit("//")), F.concat(u["scheme"], F.lit(":"), t))
            .when(F.startswith(t, F.lit("/")), F.concat(origin(u, user=False), t))
            .otherwise(F.concat(origin(u, user=False), F.regexp_replace(u["path"], "[^/]*$", ""), t))
        )

    return let(trimmed(target), lambda t: let(parsed(base), lambda u: joined(t, u)))


def media(target: Column, base: Column, host: Column) -> Column:
    """Target without query, fragment, user and password; only its path on host."""
    return let(parsed(resolved(target, base)), lambda u: F.when(F.regexp_replace(u["host"], ":[0-9]*$", "") == host, u["path"]).otherwise(F.concat(origin(u, user=False), u["path"])))


def prefixes(parts: Column, separator: str, lead: str = "") -> Column:
    """a, b, c become a, a:b, a:b:c."""
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit(lead), F.array_join(F.slice(parts, 1, i), separator)))
    return F.when(F.size(parts) > 0, made).otherwise(F.array().cast("array<string>"))


def path_prefixes(p: Column) -> Column:
    return prefixes(F.filter(F.split(p, "/", -1), lambda x: x != ""), "/", "/")


def host_suffixes(host: Column) -> Column:
    parts = F.filter(F.reverse(F.split(host, r"\.", -1)), lambda x: x != "")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.reverse(F.slice(parts, 1, i)), "."))
    return F.when(F.size(parts) > 0, made).otherwise(F.array().cast("array<string>"))


def url_segments(url: Column) -> Column:
    """Path prefixes of an https URL, domain suffixes of anything else with a dot."""
    return (
        F.when(F.startswith(url, F.lit("https://")), path_prefixes(parsed(url)["path"]))
        .when(F.contains(url, F.lit(".")), host_suffixes(url))
        .otherwise(F.array().cast("array<string>"))
    )
