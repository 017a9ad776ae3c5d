"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions import rules, stats
from ..operators.facets import KNOWN_CHECKPOINTS, KNOWN_FACETS, KNOWN_SUFFIXES
from ..sources.bundles import EVENTS_SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _first(x: str, pairs, prefix: str = "", end: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(prefix + p)}) THEN {_q(r)}" for r, p in pairs) + f"{end} END"


def _lookup(x: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(map(_q, keys))}) THEN {_q(r)}" for r, keys in table.items()) + " END"


def _vendor(o: str) -> str:
    return f"coalesce({_first(o, rules.CAMPAIGN_VENDORS, '(?i)')}, '')"


def _category(o: str, v: str) -> str:
    return f"coalesce({_first(o, rules.CAMPAIGN_CATEGORIES, '(?i)')}, {_lookup(v, rules.VENDOR_CATEGORIES)}, '')"


def _type(o: str, v: str, c: str) -> str:
    return f"coalesce({_first(o, rules.CAMPAIGN_TYPES, '(?i)')}, {_lookup(v, rules.VENDOR_TYPES)}, {_lookup(c, rules.CATEGORY_TYPES)}, '')"


_REST = "CASE WHEN cat <> '' OR ven <> '' THEN ':' || cat ELSE '' END || CASE WHEN ven <> '' THEN ':' || ven ELSE '' END"
_ACTION = "CASE " + " ".join(
    f"WHEN regexp_matches(source, {_q(m)}) THEN " + ("CASE " + " ".join(f"WHEN regexp_matches(source, {_q(p)}) THEN {_q(n)}" for n, p in reversed(list(zip(("accept", "reject", "dismiss"), a))) if p) + " END" if any(a) else "CAST(NULL AS VARCHAR)")
    for _, m, *a in rules.CONSENT
) + " END"
_CONSENT = _first("source", [(v, m) for v, m, *_ in rules.CONSENT])

URLRE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _url(u: str, k: int) -> str:
    return f"regexp_extract({u}, {_q(URLRE)}, {k})"


def _valid(u: str) -> str:
    return f"coalesce(regexp_matches({u}, {_q(URLRE)}) AND NOT regexp_matches({u}, '^[^?#]*://[^/?#]*\\s'), false)"


def _path(u: str) -> str:
    return f"CASE WHEN {_url(u, 4)} = '' THEN '/' ELSE replace({_url(u, 4)}, ' ', '%20') END"


def _plain(u: str) -> str:
    return f"CASE WHEN {_valid(u)} THEN lower({_url(u, 1)}) || '://' || lower({_url(u, 3)}) || {_path(u)} END"


def _masked(u: str, year: int) -> str:
    years = "|".join(str(year - i) for i in range(6))
    seg = (
        "CASE WHEN length(s) >= 5 AND regexp_matches(s, '^[0-9]+$') THEN CASE WHEN regexp_matches(s, '^(" + years + ")') THEN s ELSE '%3Cnumber%3E' END "
        "WHEN length(s) >= 8 AND regexp_matches(s, '^[0-9a-fA-F]+$') THEN '%3Chex%3E' WHEN length(s) > 32 AND regexp_matches(s, '^[a-zA-Z0-9+/]+={0,2}$') THEN '%3Cbase64%3E' "
        "WHEN length(s) > 35 AND regexp_matches(s, '^[0-9a-f-]+$') THEN '%3Cuuid%3E' "
        r"WHEN length(s) > 60 AND NOT (regexp_matches(replace(s, '_', '-'), '^[\s\w.-]+$') AND regexp_matches(replace(s, '_', '-'), '^(\w+-){3}')) THEN '...' ELSE s END"
    )
    path = f"array_to_string(list_transform(string_split({_path(u)}, '/'), lambda s: {seg}), '/')"
    return f"CASE WHEN {_valid(u)} THEN lower({_url(u, 1)}) || '://' || {_url(u, 2)} || lower({_url(u, 3)}) || {path} || {_url(u, 5)} || {_url(u, 6)} END"


def _prefixes(parts: str, sep: str, lead: str = "") -> str:
    return f"list_transform(range(1, len({parts}) + 1), lambda i: {_q(lead)} || array_to_string({parts}[1:i], {_q(sep)}))"


def _segments(u: str) -> str:
    p = f"list_filter(string_split({_path(u)}, '/'), lambda x: x <> '')"
    h = f"list_filter(list_reverse(string_split({u}, '.')), lambda x: x <> '')"
    hosts = f"list_transform(range(1, len({h}) + 1), lambda i: array_to_string(list_reverse({h}[1:i]), '.'))"
    return f"CASE WHEN starts_with({u}, 'https://') THEN {_prefixes(p, '/', '/')} WHEN contains({u}, '.') THEN {hosts} ELSE []::VARCHAR[] END"


def _at(cp: str, events: str = "ev") -> str:
    return f"list_filter({events}, lambda e: e.checkpoint = {_q(cp)})"


def _has(cp: str, events: str = "ev") -> str:
    return f"(len({_at(cp, events)}) > 0)"


def _largest(cp: str) -> str:
    return f"list_max(list_transform({_at(cp)}, lambda e: greatest(coalesce(e.value, 0), 0)))"


def _values(cp: str, f: str, events: str = "ev") -> str:
    return f"list_filter(list_transform({_at(cp, events)}, lambda e: e.{f}), lambda x: x IS NOT NULL AND x <> '')"


def _unpaid(barred: str) -> str:
    return f"CASE WHEN visit AND len(list_filter(ra, lambda e: e.checkpoint = 'acquisition' AND regexp_matches(e.source, '^({barred})'))) = 0 THEN weight ELSE 0 END"


_STRUCT = "{{'checkpoint': {0}, 'source': {1}, 'target': {2}, 'value': CAST(value AS DOUBLE)}}"
_LIST = lambda c, s, t: f"list({_STRUCT.format(c, s, t)} ORDER BY ts, event_id)"

PAGE_VIEWS = f"""
WITH e0 AS ({EVENTS_SQL.format(events="events", pages="pages")}),
e1 AS (SELECT * REPLACE (CASE WHEN checkpoint = 'enter' AND source = '' THEN '(direct)' ELSE source END AS source) FROM e0),
e2 AS (SELECT *, CASE WHEN checkpoint = 'click' THEN {_CONSENT} END AS cven, {_ACTION} AS action, coalesce(CASE WHEN checkpoint = 'utm' THEN target ELSE source END, 'undefined') AS o,
  coalesce((checkpoint = 'utm' AND lower(source) IN ('utm_source', 'utm_medium')) OR checkpoint IN ('paid', 'email'), false) AS campaign FROM e1),
e3 AS (SELECT *, {_vendor("o")} AS ven FROM e2),
e4 AS (SELECT *, {_category("o", "ven")} AS cat FROM e3),
e5 AS (SELECT *, CASE WHEN campaign THEN nullif((CASE WHEN checkpoint = 'paid' THEN 'paid' ELSE {_type("o", "ven", "cat")} END) || {_REST}, '') END AS acq FROM e4),
e6 AS (SELECT *, CASE WHEN cven IS NOT NULL THEN 'consent' ELSE checkpoint END AS c1, CASE WHEN cven IS NULL THEN source END AS s1, CASE WHEN cven IS NOT NULL THEN action ELSE target END AS t1 FROM e5),
e7 AS (SELECT *, CASE WHEN acq IS NOT NULL THEN 'acquisition' ELSE c1 END AS c2, coalesce(acq, s1) AS s2, CASE WHEN acq IS NULL THEN t1 END AS t2 FROM e6),
b0 AS (SELECT id, min(slot) AS slot, min(url) AS url, min(weight) AS weight, min(ua) AS ua,
  {_LIST("checkpoint", "source", "target")} AS ev, {_LIST("c1", "s1", "t1")} AS rc, {_LIST("c2", "s2", "t2")} AS ra FROM e7 GROUP BY id),
b AS (SELECT *, {_has("enter")} AS visit, {_largest("cwv-lcp")} AS lcp, {_largest("cwv-cls")} AS cls, {_at("cwv-inp")}[-1].value AS inp, {_at("cwv-ttfb")}[-1].value AS ttfb FROM b0),
s AS (SELECT *,
  CASE WHEN NOT {_has("prerender")} OR len(list_filter(ev, lambda e: e.checkpoint = 'navigate' AND e.target = 'prerendered')) > 0 THEN weight ELSE 0 END AS "pageViews",
  CASE WHEN visit THEN weight ELSE 0 END AS visits, CASE WHEN visit AND NOT {_has("click")} THEN weight ELSE 0 END AS bounces,
  CASE WHEN {_has("click")} OR len(list_filter(ev, lambda e: e.checkpoint IN ('viewmedia', 'viewblock'))) > 3 THEN weight ELSE 0 END AS engagement,
  {_unpaid("paid|owned")} AS earned, {_unpaid("paid")} AS organic,
  list_distinct(list_transform(ra, lambda e: e.checkpoint)) AS cps, {_prefixes("string_split(ua, ':')", ":")} AS uas FROM b)
"""
SERIES = ["pageViews", "visits", "bounces", "engagement", "earned", "organic", "lcp", "cls", "inp", "ttfb"]


def _pv(select: str) -> str:
    return PAGE_VIEWS + select


def _metrics(s: str) -> str:
    return (
        f"""SELECT '{s}' AS series, count("{s}") AS count, CAST(coalesce(sum(CAST("{s}" AS DOUBLE)), 0) AS DOUBLE) AS sum, CAST(coalesce(sum(CASE WHEN "{s}" IS NOT NULL THEN weight END), 0) AS DOUBLE) AS weight, """
        f"""CAST(min("{s}") AS DOUBLE) AS min, CAST(max("{s}") AS DOUBLE) AS max, round(avg("{s}"), 6) AS mean, round(coalesce(var_pop("{s}"), 0), 6) AS variance, round(coalesce(stddev_pop("{s}"), 0), 6) AS stddev, """
        f"""round(coalesce(stddev_pop("{s}") / sqrt(nullif(count("{s}"), 0)), 0), 6) AS stderr FROM s"""
    )


def _view(facet: str, values: str, where: str = "true") -> str:
    return f"SELECT '{facet}' AS facet, v AS value, count(*) AS count, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT weight, unnest({values}) AS v FROM s WHERE {where}) GROUP BY v"


def _score(x: str, name: str) -> str:
    fair, poor = stats.VITALS[name]
    return f"CASE WHEN {x} >= {poor} THEN 'poor' WHEN {x} >= {fair} THEN 'ni' WHEN {x} IS NOT NULL THEN 'good' END"


_VITALS = "list_filter([" + ", ".join(f"CASE WHEN {n} <> 0 THEN ({_score(n, n)}) || '{n.upper()}' END" for n in ("lcp", "cls", "inp")) + "], lambda x: x IS NOT NULL)"
_ENTER_RULES = "CASE " + " ".join(f"WHEN regexp_matches(u, {_q(p)}) THEN [u, '{t}:{v}', '{t}', '*:{v}']" for t, v, p in rules.REFERRERS) + " ELSE [u] END"
_NOFRAG = f"CASE WHEN {_valid('x')} THEN lower({_url('x', 1)}) || '://' || {_url('x', 2)} || lower({_url('x', 3)}) || {_path('x')} || {_url('x', 5)} END"
_ENTER = f"flatten(list_transform(list_filter(list_transform({_values('enter', 'source')}, lambda x: {_NOFRAG}), lambda u: u IS NOT NULL), lambda u: {_ENTER_RULES}))"
_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#]+)', 1))"
_BARE = "regexp_replace(x, '[?#].*$', '')"
# targets of media: rooted, in the folder above, on the page's own host, without a scheme, or elsewhere
_MEDIA = f"""list_transform({_values('viewmedia', 'target')}, lambda x: CASE
  WHEN starts_with(x, '//') THEN {_plain("(split_part(url, '/', 1) || x)")} WHEN starts_with(x, '/') THEN {_BARE}
  WHEN starts_with(x, '../') THEN regexp_replace(regexp_replace({_path("url")}, '[^/]*$', ''), '(/[^/]+)?/$', '/') || {_BARE.replace("x,", "substr(x, 4),")}
  WHEN {_url("x", 3)} = {_HOST} THEN {_path("x")} ELSE {_plain("x")} END)"""
_ACQ = "coalesce(list_filter(" + _prefixes("string_split(list_filter(ra, lambda e: e.checkpoint = 'acquisition')[-1].source, ':')", ":") + ", lambda x: x <> ''), []::VARCHAR[])"
_FACETS = {
    "userAgent": "uas", "url": f"[{_masked('url', 2026)}]", "plainURL": f"[{_plain('url')}]", "checkpoint": "cps", "vitals": _VITALS, "lcpTarget": _values("cwv-lcp", "target"),
    "lcpSource": _values("cwv-lcp", "source"), "acquisitionSource": _ACQ, "enterSource": _ENTER, "mediaTarget": _MEDIA,
}


def _percentiles(key: str, group: str) -> str:
    pick = ", ".join(f"list_sort(list(lcp) FILTER (WHERE lcp IS NOT NULL))[CAST(floor({p} * count(lcp) / 100) AS BIGINT) + 1] AS p{p}" for p in (0, 50, 75, 99, 100))
    return f"SELECT {key} AS ua, {pick} FROM s WHERE lcp IS NOT NULL {group}"


def _histogram(thresholds: str, where: str = "true") -> str:
    """thresholds: SQL of a CTE t(list) over v(v, w), the facet's values and weights, of bundles that pass a filter."""
    return f"""{PAGE_VIEWS.replace("WITH e0", "WITH RECURSIVE e0", 1)}, l AS (SELECT weight, CAST(floor(lcp) AS BIGINT) AS v FROM s WHERE lcp IS NOT NULL AND {where}),
v AS (SELECT v, sum(weight) AS w FROM l GROUP BY v), m AS (SELECT greatest(0, min(v)) AS lo, least(30000, max(v)) AS hi FROM v), {thresholds},
g AS (SELECT weight, list_filter(range(1, 7), lambda i: l.v < t.th[i])[1] AS i, t.th AS th FROM l, t)
SELECT 'bins' AS facet, CASE WHEN i IS NULL THEN '>=' || CAST(CAST(floor(th[6] + 0.5) AS BIGINT) AS VARCHAR) ELSE '<' || CAST(CAST(floor(th[i] + 0.5) AS BIGINT) AS VARCHAR) END AS value,
count(*) AS count, CAST(sum(weight) AS BIGINT) AS weight FROM g GROUP BY 2"""


_QUANTILES = """o AS (SELECT v, CAST(w AS DOUBLE) AS w, row_number() OVER (ORDER BY v, w) AS i FROM v, m WHERE v BETWEEN lo AND hi),
z AS (SELECT sum(w) / (6 + 1.0 / 6) AS step FROM o),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS acc, []::DOUBLE[] AS out
  UNION ALL SELECT o.i, CASE WHEN f.acc + o.w > z.step THEN CAST(0 AS DOUBLE) ELSE f.acc + o.w END, CASE WHEN f.acc + o.w > z.step THEN list_append(f.out, CAST(o.v AS DOUBLE)) ELSE f.out END FROM f JOIN o ON o.i = f.i + 1, z),
t AS (SELECT list_transform(range(1, 7), lambda k: coalesce(nullif(out[k], 0), hi)) AS th FROM (SELECT out FROM f ORDER BY i DESC LIMIT 1), m)"""


def _chao(counts: str) -> str:
    """counts: a query of k, the count of each value."""
    return f"""c AS ({counts}), a AS (SELECT CAST(count(*) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE k = 1) AS DOUBLE) AS f1, CAST(count(*) FILTER (WHERE k = 2) AS DOUBLE) AS f2 FROM c WHERE k > 0),
h AS (SELECT *, CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END AS more, f1 * (f1 - 1) / (2 * (f2 + 1)) AS bc FROM a),
x AS (SELECT *, bc + f1 * pow(2 * f1 - 1, 2) / (4 * pow(f2 + 1, 2)) + f1 * f1 * f2 * pow(f1 - 1, 2) / (4 * pow(f2 + 1, 4)) AS va, greatest(2.220446049250313e-16, (s + more) - s) AS d FROM h),
y AS (SELECT *, exp(1.96 * sqrt(ln(1 + va / (d * d)))) AS cc FROM x)"""


_CHAO_OUT = "round(s, 6) AS sobs, round(s + more, 6) AS shat, floor(more + 0.5) AS sunseen, f1, f2, round(va, 6) AS variance, round(s + d / cc, 6) AS lower, round(s + d * cc, 6) AS upper"
_SAMPLES = "CASE WHEN total > 0 AND moe > 0 THEN floor(pow(1.96 * total / moe, 2) + 0.5) ELSE 0 END"
_PHI = "(0.3989423 * exp(-z * z / 2) * (1 / (1 + 0.2316419 * abs(z))) * (0.3193815 + (1 / (1 + 0.2316419 * abs(z))) * (-0.3565638 + (1 / (1 + 0.2316419 * abs(z))) * (1.781478 + (1 / (1 + 0.2316419 * abs(z))) * (-1.821256 + (1 / (1 + 0.2316419 * abs(z))) * 1.330274)))))"
_ERF = "(1 - ((((1.061405429 * k + -1.453152027) * k + 1.421413741) * k + -0.284496736) * k + 0.254829592) * k * exp(-x * x))"
_KNOWN = "^(" + "|".join(k for k in KNOWN_FACETS + KNOWN_CHECKPOINTS if k.isalpha()) + r")(\.(" + "|".join(KNOWN_SUFFIXES) + "))?[!~]?$"


def _known() -> str:
    from .queries import KEYS

    return f"SELECT key, regexp_matches(key, {_q(_KNOWN)}) AS known FROM (VALUES {', '.join(f'({_q(k)})' for k in KEYS)}) t(key)"


_GROUP = ", ".join(
    f"""round(CAST(count("{s}") AS DOUBLE), 6) AS "{s}_count", round(CAST(coalesce(sum("{s}"), 0) AS DOUBLE), 6) AS "{s}_sum", round(CAST(coalesce(sum(CASE WHEN "{s}" IS NOT NULL THEN weight END), 0) AS DOUBLE), 6) AS "{s}_weight", """
    f"""round(avg("{s}"), 6) AS "{s}_mean", round(count("{s}") / (SELECT count("{s}") FROM s), 6) AS "{s}_share", round(sum(CAST("{s}" AS DOUBLE)) / (SELECT sum(CAST("{s}" AS DOUBLE)) FROM s), 6) AS "{s}_percentage" """
    for s in ("pageViews", "bounces", "lcp")
)



def _clusters(where: str = "true") -> str:
    return _pv(f""", p AS (SELECT weight, {_plain("url")} AS u FROM s WHERE {where}), k AS (SELECT c, count(*) AS n FROM (SELECT unnest({_segments("u")}) AS c FROM (SELECT DISTINCT u FROM p)) GROUP BY c ORDER BY n DESC, c LIMIT 5), top AS (SELECT list(c) AS cs FROM k)
SELECT 'clusters' AS facet, v AS value, count(*) AS count, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT weight, unnest(list_distinct(list_prepend(u, list_filter({_segments("u")}, lambda x: list_contains(cs, x))))) AS v FROM p, top) GROUP BY v""")


def _short(x: str, digits: str) -> str:
    """A whole number cut to significant digits, with its unit."""
    cut = f"(floor({x} / pow(10, greatest(0, length(CAST({x} AS VARCHAR)) - {digits})) + 0.5) * pow(10, greatest(0, length(CAST({x} AS VARCHAR)) - {digits})))"
    unit = f"least(4, (length(CAST(CAST({cut} AS BIGINT) AS VARCHAR)) - 1) // 3)"
    return f"rtrim(rtrim(printf('%.9f', {cut} / pow(1000, {unit})), '0'), '.') || ['', 'k', 'm', 'b', 't'][{unit} + 1]"


_TRACE = """WITH t AS (SELECT s_nationkey, list(s_suppkey ORDER BY s_suppkey) AS k FROM supplier WHERE s_nationkey <> 24 GROUP BY 1),
r AS (SELECT k[i] % 7 AS node, CASE WHEN i < len(k) THEN k[i] % 13 ELSE 0 END AS d FROM (SELECT k, unnest(range(1, len(k) + 1)) AS i FROM t)),
p AS (SELECT CASE node WHEN 4 THEN '(inline)' ELSE 'u' || CAST(node % 2 AS VARCHAR) || '.js' END || '#' || CASE node WHEN 5 THEN '(anonymous)' ELSE 'f' || CAST(node AS VARCHAR) END AS key,
  CAST(sum(d) AS BIGINT) AS time, count(*) AS samples FROM r WHERE node < 6 GROUP BY 1) """

ORACLE_SQL = {
    "daily_traffic": _pv("""SELECT slot, count(*) AS n, CAST(sum("pageViews") AS BIGINT) AS "pageViews", CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(bounces) AS BIGINT) AS bounces FROM s GROUP BY slot"""),
    "totals_metrics": _pv(" UNION ALL ".join(map(_metrics, SERIES))),
    "group_metrics": _pv(f"SELECT ua, {_GROUP} FROM s GROUP BY ua"),
    "group_percentiles": _pv(f"{_percentiles('ua', 'GROUP BY ua')} UNION ALL {_percentiles(_q('all'), '')}"),
    "filter_some": _pv("SELECT id FROM s WHERE list_has_any(cps, ['click', 'viewmedia'])"),
    "filter_every": _pv("SELECT id FROM s WHERE list_has_all(cps, ['click', 'viewmedia'])"),
    "filter_none": _pv("SELECT id FROM s WHERE NOT list_has_all(cps, ['click', 'viewmedia'])"),
    "filter_never": _pv("SELECT id FROM s WHERE NOT list_has_any(cps, ['click', 'viewmedia'])"),
    "filter_conjunction": _pv("SELECT id, weight FROM s WHERE list_contains(uas, 'desktop') AND list_has_all(cps, ['enter', 'click'])"),
    "filter_unknown": _pv("SELECT count(*) AS n FROM s WHERE false"),
    "conversions": _pv("SELECT CASE WHEN list_has_all(cps, ['click', 'enter']) AND list_contains(uas, 'mobile') THEN 'converted' ELSE 'not-converted' END AS value, count(*) AS count, CAST(sum(weight) AS BIGINT) AS weight FROM s GROUP BY 1"),
    "conversion_rates": _pv("SELECT ua, round(coalesce(CASE WHEN r BETWEEN 0 AND 100 THEN r END, 100), 6) AS rate FROM (SELECT ua, 100.0 * sum(CAST(engagement AS DOUBLE)) / nullif(sum(visits), 0) AS r FROM s GROUP BY ua)"),
    "facets_plain": _pv(" UNION ALL ".join(_view(f, _FACETS[f]) for f in ("userAgent", "checkpoint", "vitals"))),
    "facets_drilldown": _pv(" UNION ALL ".join([
        # checkpoint has every: its own filter holds for itself; checkpoint! has never: skipped for checkpoint only
        _view("userAgent", "uas", "list_contains(cps, 'click') AND NOT list_contains(cps, 'error')"),
        _view("checkpoint", "cps", "list_contains(uas, 'desktop') AND list_contains(cps, 'click')"),
        _view("checkpoint!", "cps", "list_contains(uas, 'desktop') AND list_contains(cps, 'click') AND NOT list_contains(cps, 'error')"),
        _view("vitals", _VITALS, "list_contains(uas, 'desktop') AND list_contains(cps, 'click') AND NOT list_contains(cps, 'error')"),
        _view("vitals!", _VITALS, "list_contains(uas, 'desktop') AND list_contains(cps, 'click') AND NOT list_contains(cps, 'error')"),
    ])),
    "facet_metrics": _pv("""SELECT v AS value, round(sum(CAST("pageViews" AS DOUBLE)), 6) AS "pageViews_sum", round(avg("pageViews"), 6) AS "pageViews_mean", round(coalesce(sum(lcp), 0), 6) AS lcp_sum, round(avg(lcp), 6) AS lcp_mean FROM (SELECT *, unnest(uas) AS v FROM s) GROUP BY v"""),
    **{f"facet_{f}": _pv(_view(f, v)) for f, v in _FACETS.items()},
    "checkpoint_sources": _pv(" UNION ALL ".join([*(_view(f"{c}.source", f"list_distinct({_values(c, 'source', 'rc')})") for c in ("click", "enter", "utm")), *(_view(f"{c}.target", f"list_distinct({_values(c, 'target', 'rc')})") for c in ("consent", "utm", "viewmedia"))])),
    "series_sums": _pv("SELECT ua, " + ", ".join(f'coalesce(sum(CAST("{s}" AS DOUBLE)), 0) AS "{s}"' for s in SERIES) + " FROM s GROUP BY ua"),
    "enriched": _pv("SELECT id, visit, lcp, cls, inp, ttfb FROM b"),
    "reclassified_events": _pv("SELECT c2 AS checkpoint, s2 AS source, t2 AS target, count(*) AS n FROM e7 GROUP BY 1, 2, 3"),
    "classify_acquisition": _pv(f", d0 AS (SELECT DISTINCT target AS o FROM e1 WHERE target IS NOT NULL), d1 AS (SELECT *, {_vendor('o')} AS ven FROM d0), d2 AS (SELECT *, {_category('o', 'ven')} AS cat FROM d1) SELECT o AS origin, {_type('o', 'ven', 'cat')} || {_REST} AS told, 'paid' || {_REST} AS paid FROM d2"),
    "classify_referrer": _pv(f"SELECT DISTINCT source, {_first('source', [(t, p) for t, _, p in rules.REFERRERS])} AS kind, {_first('source', [(v, p) for _, v, p in rules.REFERRERS])} AS vendor FROM e1 WHERE source IS NOT NULL"),
    "classify_consent": _pv(f"SELECT DISTINCT source, {_CONSENT} AS vendor, {_ACTION} AS action FROM e1 WHERE source IS NOT NULL"),
    "filled_days": _pv("""SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS slot, count(s.id) AS n, CAST(coalesce(sum("pageViews"), 0) AS BIGINT) AS "pageViews"
FROM (SELECT unnest(generate_series(min(CAST(slot AS DATE)) - INTERVAL 2 DAY, max(CAST(slot AS DATE)) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS d FROM s) LEFT JOIN s ON s.slot = CAST(CAST(d AS DATE) AS VARCHAR) GROUP BY 1"""),
    "interpolated_ratio": _pv("SELECT slot, round(r, 6) AS lcp_share, round(2 * r, 6) AS twice FROM (SELECT slot, coalesce(coalesce(sum(CASE WHEN lcp IS NOT NULL THEN weight END), 0) / CAST(sum(weight) AS DOUBLE), 0) AS r FROM s GROUP BY slot)"),
    "histogram_linear": _histogram("t AS (SELECT list_transform(range(0, 6), lambda i: (hi - lo) / 6.0 * i + lo) AS th FROM m)"),
    "histogram_logarithmic": _histogram("t AS (SELECT list_transform(range(0, 6), lambda i: exp(ln(hi - lo) / 6 * i) + lo) AS th FROM m)"),
    "histogram_quantiles": _histogram(_QUANTILES),
    "histogram_filtered": _histogram("t AS (SELECT list_transform(range(0, 6), lambda i: (hi - lo) / 6.0 * i + lo) AS th FROM m)", "list_contains(uas, 'mobile')"),
    "facet_order": _pv(f"SELECT *, row_number() OVER (ORDER BY weight DESC, value) AS rank FROM ({_view('checkpoint', 'cps')}) ORDER BY rank LIMIT 10"),
    "chunks": _pv("SELECT slot, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(len(ev)) AS BIGINT) AS events, count(lcp) AS lcps FROM s GROUP BY slot"),
    "lifecycle": _pv(f""", c AS (SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(uas, 'mobile')) AS m, count(*) FILTER (WHERE {_has('click')}) AS k, count(*) FILTER (WHERE {_has('click')} AND list_contains(uas, 'mobile')) AS mk FROM s)
SELECT unnest(['empty', 'filtered', 'reset_facets', 'reset_series', 'load', 'append']) AS step, unnest([0, m, n, m, mk, m + mk]) AS n, unnest([0, 3, 3, 0, 3, 3]) AS series, unnest([0, 1, 0, 1, 1, 1]) AS facets FROM c"""),
    "richness_of_visits": _pv(f", {_chao(f'SELECT count(*) AS k FROM s GROUP BY {_HOST}, slot')} SELECT {_CHAO_OUT}, round(d / cc, 6) AS darklower, round(d * cc, 6) AS darkupper, round(bc, 6) + 0.0 AS deltabc FROM y"),
    "readable": _pv(f"""SELECT slot, {_short("n", "3")} AS "pageViews" FROM (SELECT slot, CAST(sum("pageViews") AS BIGINT) AS n FROM s GROUP BY slot)"""),
    "rounded_to_confidence": f"""WITH p AS (SELECT p_partkey, CAST(floor(p_retailprice * p_partkey * p_size) AS BIGINT) AS t, 10 + p_size * p_size * p_partkey AS n FROM part),
e AS (SELECT *, CAST(floor(1.96 * sqrt((t / n) * (t / n) * n) + 0.5) AS BIGINT) AS err FROM p), c AS (SELECT *, CAST(t + err AS VARCHAR) AS a, CAST(t - err AS VARCHAR) AS b FROM e),
d AS (SELECT *, greatest(2, CAST(list_sum(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: CASE WHEN a[i] = b[i] THEN 1 ELSE 0 END)) AS BIGINT)) AS digits FROM c)
SELECT p_partkey, {_short("t", "digits")} AS shown, {_short("t", "2")} AS short FROM d""",
    "trace_profile": _TRACE + "SELECT * FROM p",
    "trace_report": _TRACE + """SELECT key, printf('%.2f', time / 1000 + CASE WHEN time % 250 = 125 THEN 1e-9 ELSE 0 END) || 'ms' || chr(9) || '(samples=' || CAST(samples AS VARCHAR) || ')' || chr(9) || key AS line FROM p
UNION ALL SELECT 'broken', 'nation 24' FROM supplier WHERE s_nationkey = 24 HAVING count(*) > 0""",
    "selectivity": _pv(f""", c AS (SELECT count(*) FILTER (WHERE list_contains(cps, 'click')) + count(*) FILTER (WHERE list_contains(cps, 'enter')) AS k, count(*) FILTER (WHERE ua = 'mobile:ios') AS u FROM s),
r AS (SELECT unnest(['checkpoint', 'userAgent', 'unknown']) AS facet, unnest([k, u, 2]) AS score FROM c) SELECT facet, score, CAST(row_number() OVER (ORDER BY score) - 1 AS INTEGER) AS place FROM r"""),
    "trace_top": _TRACE + "SELECT * FROM (SELECT *, 'own' AS of FROM p WHERE contains(key, 'u1') ORDER BY time DESC, key LIMIT 2) UNION ALL SELECT * FROM (SELECT *, 'all' AS of FROM p ORDER BY time DESC, key LIMIT 2)",
    "url_clusters": _clusters(),
    "clusters_filtered": _clusters("list_contains(uas, 'desktop:mac')"),
    "richness": _pv(f", {_chao(f'SELECT count(*) AS k FROM s GROUP BY {_plain(chr(117) + chr(114) + chr(108))}')} SELECT {_CHAO_OUT}, round(d / cc, 6) AS darklower, round(d * cc, 6) AS darkupper, round(bc, 6) + 0.0 AS deltabc FROM y"),
    "dark_matter": f"WITH p AS (SELECT floor(p_retailprice) AS total, floor(p_retailprice) * (1 + p_size % 2) AS moe FROM part), {_chao(f'SELECT {_SAMPLES} AS k FROM p')} SELECT {_CHAO_OUT} FROM y",
    "sampling": f"SELECT p_partkey, CAST(CASE WHEN n = 0 THEN 0 ELSE floor(1.96 * sqrt((total / n) * (total / n) * n) + 0.5) END AS BIGINT) AS error, CAST({_SAMPLES} AS BIGINT) AS sampled, round({_SAMPLES} / total, 6) AS rate FROM (SELECT p_partkey, floor(p_retailprice) AS total, CAST(p_size % 7 AS DOUBLE) AS n, 100.0 AS moe FROM part)",
    "z_test": _pv(f""", g AS (SELECT ua, sum(CAST(visits AS DOUBLE)) AS n1, sum(CAST(bounces AS DOUBLE)) AS c1 FROM s GROUP BY ua), a AS (SELECT g.*, (SELECT sum(n1) FROM g) AS n2, (SELECT sum(c1) FROM g) AS c2 FROM g),
p AS (SELECT *, (c1 + c2) / (n1 + n2) AS q FROM a), y AS (SELECT *, (c1 / n1 - c2 / n2) / sqrt(q * (1 - q) * (1 / n1 + 1 / n2)) AS z0 FROM p), w AS (SELECT *, abs(z0) AS z FROM y)
SELECT ua, round(CASE WHEN c1 / n1 = c2 / n2 THEN 1 ELSE 2 * (1 - CASE WHEN z > 0 THEN 1 - {_PHI} ELSE {_PHI} END) END, 6) AS p FROM w"""),
    "t_test": _pv(f""", g AS (SELECT starts_with(ua, 'desktop') AS d, lcp AS v FROM s), a AS (SELECT avg(v) FILTER (WHERE d) AS m1, var_pop(v) FILTER (WHERE d) AS v1, count(v) FILTER (WHERE d) AS n1, avg(v) FILTER (WHERE NOT d) AS m2, var_pop(v) FILTER (WHERE NOT d) AS v2, count(v) FILTER (WHERE NOT d) AS n2 FROM g),
y AS (SELECT (m1 - m2) / sqrt((v1 + v2) / 2 * (1.0 / n1 + 1.0 / n2)) / sqrt(2) AS x FROM a), k AS (SELECT x, 1 / (1 + 0.3275911 * abs(x)) AS k FROM y)
SELECT round(1 - (0.5 + 0.5 * CASE WHEN x < 0 THEN -{_ERF} ELSE {_ERF} END), 6) AS p FROM k"""),
    "trend": _pv(""", d AS (SELECT CAST(slot AS DATE) AS d, CAST(sum("pageViews") AS DOUBLE) AS v FROM s GROUP BY slot), i AS (SELECT v, CAST(d - (SELECT min(d) FROM d) AS DOUBLE) AS i FROM d) SELECT round(regr_slope(v, i), 4) AS slope, round(regr_intercept(v, i), 4) AS intercept FROM i"""),
    "scores": _pv(f""", g AS (SELECT list_filter([{", ".join(f"CASE WHEN {n} <> 0 THEN {_score(n, n)} END" for n in ("lcp", "cls", "inp"))}], lambda x: x IS NOT NULL) AS l, {_score("ttfb", "ttfb")} AS ttfb FROM s)
SELECT CASE WHEN len(l) = 0 THEN NULL WHEN list_contains(l, 'poor') THEN 'poor' WHEN list_contains(l, 'ni') THEN 'ni' ELSE 'good' END AS score, ttfb, count(*) AS n FROM g GROUP BY 1, 2"""),
    "append_bundles": _pv('SELECT ua AS "userAgent", count(*) AS n, count(x) AS again FROM (SELECT ua, NULL AS x FROM b UNION ALL SELECT ua, 1 FROM b WHERE visit) GROUP BY ua'),
    "url_masks": f"""WITH p AS (SELECT page_id, url || '#z' AS u, regexp_replace(url || '#z', '^([^:]+://[^/?#]+)', '\\1/20241234567/00deadbeef') AS l FROM pages) SELECT page_id, {_masked("l", 2026)} AS masked, {_plain("u")} AS plain, array_to_string({_segments("u")}, ' ') AS segments FROM p""",
    "known_facets": _known(),
}
