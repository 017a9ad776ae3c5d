"""Views and operators over small bundles, and properties that must hold for any data."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats, rules, stats, urls
from tidemark.operators import aggregates as A
from tidemark.operators import facets as fa
from tidemark.operators import series as se
from tidemark.plans import trace
from tidemark.plans.explorer import Explorer, two_digits
from tidemark.sources import bundles as B
from tidemark.streaming import windows


def bundle(id_, events=(), weight=100, url="https://www.example.com/a/b", ua="desktop:windows", **more):
    keys = ("checkpoint", "source", "target", "value", "timeDelta")
    return {"id": id_, "host": "www.example.com", "time": "2024-05-06T05:10:00Z", "timeSlot": "2024-05-06T05:00:00Z", "url": url, "userAgent": ua, "hostType": "external", "weight": weight, "domain": None, "events": [dict(zip(keys, (*e, *[None] * (5 - len(e))))) for e in events], **more}


def frame(spark, *rows):
    return B.enrich(spark.createDataFrame(list(rows), B.BUNDLE))


def only(df):
    return [r[0] for r in df.collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_enrich(spark):
    r = frame(spark, bundle("a", [("enter", ""), ("cwv-lcp", None, None, 3.0), ("cwv-lcp", None, None, None), ("cwv-inp", None, None, 9.0), ("cwv-inp", None, None, 4.0), ("cwv-cls",)]), bundle("b")).orderBy("id").collect()
    assert r[0]["visit"] and r[0]["events"][0]["source"] == "(direct)" and (r[0]["cwvLCP"], r[0]["cwvCLS"], r[0]["cwvINP"], r[0]["cwvTTFB"]) == (3, 0, 4, None)
    assert not r[1]["visit"] and r[1]["cwvLCP"] is None


def test_sources(spark, tmp_path):
    chunk = [{"date": "2024-05-06", "rumBundles": [bundle("a", [("click",)]), bundle("a")]}]
    (tmp_path / "a.json").write_text(json.dumps(chunk))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump(chunk[0], f)
    got = B.read_chunks(spark, str(tmp_path), multi_line=True)
    assert got.count() == 4 and got.select("id").distinct().count() == 1
    B.write_chunks(got, f"{tmp_path}/lines")
    lines = B.read_chunks(spark, f"{tmp_path}/lines")
    assert sorted(map(str, lines.collect())) == sorted(map(str, got.select(lines.columns).collect()))
    B.write_bundles(got, f"{tmp_path}/out")
    assert B.read_bundles(spark, f"{tmp_path}/out").count() == 4
    x = Explorer.empty(spark).with_series("pv", se.page_views())
    assert x.totals().first()["pv__sum"] == 0 and x.load(B.enrich(got)).append(B.enrich(got)).totals().first()["pv__count"] == 8


@pytest.fixture(scope="module")
def three(spark):
    rows = [bundle("1", [("click",), ("enter", "https://www.google.com/")], 100), bundle("2", [("enter", "")], 200, ua="desktop:mac"), bundle("3", [("click",)], 300, ua="mobile:ios")]
    return Explorer(frame(spark, *rows)).with_series("pageViews", se.page_views()).with_facet("userAgent", fa.user_agent()).with_facet("checkpoint", fa.checkpoint(), "some", "none")


def test_filters(three):
    ids = lambda x, spec: sorted(r["id"] for r in x.filter_by(spec).collect())
    assert ids(three, {}) == ids(three, {"nothing": []}) == ["1", "2", "3"] and ids(three, {"nothing": ["x"]}) == []
    assert ids(three, {"userAgent": "desktop"}) == ["1", "2"] and ids(three, {"userAgent": ["desktop"], "checkpoint": ["click"]}) == ["1"]
    want = {"some": ["1", "2", "3"], "every": ["1"], "none": ["2", "3"], "never": []}
    for combiner, found in want.items():
        assert ids(three.with_facet("c", fa.checkpoint(), combiner), {"c": ["click", "enter"]}) == found
    assert ids(three.reset_facets(), {"x": ["y"]}) == ["1", "2", "3"]
    with pytest.raises(KeyError):
        Explorer(three.bundles, facets=three.facets, strict=True).filter_by({"x": ["y"]})
    assert only(three.bundles.orderBy("id").select(three.has_conversion({"checkpoint": ["click"]}))) == [True, False, True]
    assert not any(only(three.bundles.select(three.has_conversion({"x": ["click"]}))))


def test_selectivity(three):
    x = three.with_filter({"checkpoint": ["click", "enter"], "userAgent": ["mobile"], "x": ["a"], "none": []})
    assert x.selectivity() == {"checkpoint": 4, "userAgent": 1, "x": 1} and [k for k in x.ordered().spec if k in three.facets] == ["userAgent", "checkpoint"]
    assert three.with_filter({"checkpoint": ["click"], "userAgent": ["mobile"]}).ordered().filtered().count() == 1


def rows(view):
    return {(r["facet"], r["value"]): (r["count"], r["weight"]) for r in view.collect()}


def test_facets(three):
    plain = rows(three.facet_view())
    assert plain["userAgent", "desktop"] == (2, 300) and plain["checkpoint", "click"] == plain["checkpoint!", "click"] == (2, 400)
    assert [r["value"] for r in three.facet_order("userAgent").collect()][:2] == ["desktop", "mobile"]
    drilled = rows(three.with_filter({"userAgent": ["mobile"], "checkpoint": ["enter"]}).facet_view())
    assert drilled["checkpoint", "click"] == (1, 300) and ("checkpoint!", "click") not in drilled and drilled["userAgent", "desktop"] == (2, 300)
    m = three.facet_view(["userAgent"], ("sum", "mean")).where("value = 'desktop'").first()
    assert m["pageViews__sum"] == 300 and m["pageViews__mean"] == 150


@pytest.mark.parametrize("combiner", ["some", "every", "none", "never"])
def test_one_pass_is_many(spark, sf_dir, combiner):
    """One scan gives what a filtered scan per facet gives."""
    x = Explorer(B.page_views(spark, sf_dir)).with_facet("ua", fa.user_agent(), combiner).with_facet("cp", fa.checkpoint(), "some", "never")
    x = x.with_filter({"ua": ["desktop"], "cp": ["click", "enter"], "cp!": ["error"]})
    got = rows(x.facet_view())
    want = {}
    for name, skipped in (("ua", {"ua"} if combiner in ("some", "none") else set()), ("cp", {"cp", "cp!"}), ("cp!", set())):
        left = x.filter_by({k: v for k, v in x.spec.items() if k not in skipped})
        for r in left.select(F.explode(x.facets[name].values).alias("v"), "weight").groupBy("v").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect():
            want[name, r["v"]] = (r["n"], r["w"])
    assert got == want and got


def test_one_scan_one_exchange(three):
    plan = three.with_filter({"userAgent": ["desktop"]}).facet_view()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_persist(three):
    kept = three.load(three.bundles.select("*")).persist()
    assert kept.cache_stats() == {"memory": True, "disk": True} and kept.filtered().count() == 3
    assert kept.unpersist().cache_stats() == {"memory": False, "disk": False}


def test_groups(spark, three):
    got = {r["key"]: r for r in three.group(F.col("userAgent")).collect()}
    assert got["mobile:ios"]["pageViews__share"] == pytest.approx(1 / 3) and got["mobile:ios"]["pageViews__percentage"] == 0.5
    twice = three.group(F.array(F.lit("a"), F.lit("a"), F.lit(None))).first()
    assert twice["key"] == "a" and twice["bundles"] == 6
    assert three.group(F.lit("")).count() == 0 and three.group(F.lit(None).cast("string")).count() == 0
    spine = spark.createDataFrame([("mobile:ios",), ("x",)], "key string")
    x = three.with_interpolation("half", ["pageViews"], lambda s: F.try_divide(s["pageViews"], F.lit(2))).with_interpolation("none", ["half"], lambda s: F.try_divide(s["half"], F.lit(0)))
    filled = {r["key"]: (r["bundles"], r["pageViews__sum"], r["half"], r["none"]) for r in x.group(F.col("userAgent"), spine).collect()}
    assert filled == {"mobile:ios": (1, 300, 150, 0), "x": (0, 0, 0, 0)}


def test_aggregates(spark):
    x = Explorer(frame(spark, *[bundle(str(v), [("cwv-lcp", None, None, float(v))]) for v in range(100, 1001, 100)])).with_series("lcp", se.vital("lcp")).with_series("inp", se.vital("inp"))
    p = x.total_percentiles("lcp", (0, 50, 90, 99, 100)).first()
    assert tuple(p) == (100, 600, 1000, 1000, None)
    few = x.load(x.bundles.where("cast(id as int) <= 400").withColumn("cwvLCP", F.col("cwvLCP") / 10)).totals().first()
    assert (few["lcp__variance"], few["lcp__stddev"], few["lcp__stderr"]) == pytest.approx((125, math.sqrt(125), math.sqrt(125) / 2))
    assert (few["inp__count"], few["inp__sum"], few["inp__variance"], few["inp__stderr"], few["inp__mean"], few["inp__max"]) == (0, 0, 0, 0, None, None)


def test_percentiles_of_outliers(spark):
    """One value far off, ties and few values: ranks are exact, and ranges hold about as many values each."""
    x = Explorer(spark.range(20_000).select(F.lit(1).alias("weight"), (F.col("id") % 3).cast("string").alias("key"), F.when(F.col("id") == 7, 1e9).when(F.col("id") % 5 == 0, 3.0).otherwise((F.col("id") * 7919 % 10_007) / 8).alias("s")))
    x = x.with_series("s", F.col("s"))
    values = {}
    for r in x.bundles.collect():
        values.setdefault(r["key"], []).append(r["s"])
    points = (0, 1, 33.3, 50, 99, 99.99, 100)
    pick = lambda v: tuple(sorted(v)[int(p * len(v) // 100)] if p < 100 else None for p in points)
    assert {r[0]: tuple(r)[1:] for r in x.group_percentiles(F.col("key"), "s", points).collect()} == {k: pick(v) for k, v in values.items()}
    assert tuple(x.total_percentiles("s", points).first()) == pick(sum(values.values(), []))
    counted = x.bundles.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in A.ranked(counted, []).groupBy("range").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 4 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_ranks_of_many_values(spark, keys):
    """Ranges don't depend on the order or the partitions of rows, so both places where a plan has them agree and no rank is off."""
    values = spark.range(100_000).select((F.col("id") % 2).cast("string").alias("key"), (F.col("id") * 7919 % 100_003 / 8).alias("v"), (F.col("id") % 3 + 1).alias("n"))
    found = [sorted(map(tuple, A.ranked(rows, keys).select(F.col("key") if keys else F.lit(""), "v", "n", "range", "end").collect())) for rows in (values.repartition(23), values.coalesce(1).sortWithinPartitions(F.desc("v")))]
    assert found[0] == found[1]
    upto = {}
    for key, _, n, _, end in found[0]:
        upto[key] = upto.get(key, 0) + n
        assert end == upto[key]


def test_totals_only_on_demand(three):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(three.group(F.col("userAgent"), names=("sum",))) and "Join" in plan(three.group(F.col("userAgent"), names=("sum", "share")))
    got = three.group(F.col("userAgent"), names=("share",)).columns
    assert "pageViews__share" in got and "pageViews__percentage" not in got
    assert three.facet_view(["userAgent"], ("share", "percentage")).where("pageViews__share is not null or pageViews__percentage is not null").count() == 0


def test_series(spark):
    many = [("viewblock",)] * 4
    b = frame(
        spark, bundle("0", [("enter", "x")]), bundle("1", [("prerender",)]), bundle("2", [("prerender",), ("navigate", None, "prerendered")]), bundle("3", many), bundle("4", many[:3]),
        bundle("5", [("enter", "x"), ("paid", None)]), bundle("6", [("enter", "x"), ("email", "newsletter")]), bundle("7", [("enter", "x"), ("utm", "UTM_SOURCE", "facebook"), ("click",)]),
    ).orderBy("id")
    assert {n: only(b.select(se.SERIES[n]())) for n in ("pageViews", "visits", "bounces", "engagement", "earned", "organic")} == {
        "pageViews": [100, 0, 100, 100, 100, 100, 100, 100], "visits": [100, 0, 0, 0, 0, 100, 100, 100], "bounces": [100, 0, 0, 0, 0, 100, 100, 0],
        "engagement": [0, 0, 0, 100, 0, 0, 0, 100], "earned": [100, 0, 0, 0, 0, 0, 0, 100], "organic": [100, 0, 0, 0, 0, 0, 100, 100],
    }


def test_builtin_facets(spark):
    b = frame(spark, bundle("0", [
        ("enter", "https://News.google.com#x"), ("enter", "(direct)"), ("click", "#onetrust-accept"), ("click", ".a", "/t"), ("click", ".a"), ("utm", "utm_medium", "social"), ("cwv-lcp", "img", "", 5000.0),
        ("cwv-cls", None, None, 0.0), ("viewmedia", None, "/m/a.png?x#y"), ("viewmedia", None, "../b.png"), ("viewmedia", None, "https://u:p@cdn.example.com/c.png"), ("viewmedia", None, "//cdn.example.com"),
    ]))
    got = lambda c: b.select(c.alias("x")).first()[0]
    assert got(fa.user_agent()) == ["desktop", "desktop:windows"]
    assert got(fa.enter_source()) == ["https://news.google.com/", "news:google", "news", "*:google"]
    assert got(fa.checkpoint()) == ["enter", "consent", "click", "acquisition", "cwv-lcp", "cwv-cls", "viewmedia"]
    assert got(fa.vitals()) == ["poorLCP"] and got(fa.lcp_source()) == ["img"] and got(fa.lcp_target()) == []
    assert got(fa.acquisition_source()) == [":social"]
    assert got(fa.media_target()) == ["/m/a.png", "/b.png", "https://cdn.example.com/c.png", "https://cdn.example.com/"]
    assert got(fa.checkpoint_source("click")) == [".a"] and got(fa.checkpoint_target("consent")) == ["accept"] and got(fa.checkpoint_source("consent")) == []
    d = b.withColumn("domain", F.lit("custom.domain")).select(fa.url(2026), fa.plain_url()).first()
    assert tuple(d) == ("custom.domain", "custom.domain")


@pytest.mark.parametrize(("path", "want"), [
    ("/path/to/page", None), ("/user/12345", "/user/%3Cnumber%3E"), ("/user/2020013579", "/user/%3Cnumber%3E"), ("/user/2021013579", None), ("/user/2026013579", None), ("/hash/a1b2c3d4e5f6", "/hash/%3Chex%3E"),
    ("/path?query=string#fragment", None), ("/path/VGVzdHMgYXJlIGtpbmRhIGltcG9ydGFudA==", "/path/%3Cbase64%3E"), ("/path/123e4567-e89b-12d3-a456-426614174000", "/path/%3Cuuid%3E"),
    ("/p/" + "loremipsumdolorsitametconsecteturadipiscingelit-1234567890-abcdefghijk", "/p/..."), ("/en/2024/09/11/bringing-a-very-long-title-to-the-page-about-video-models-coming-soon.html", None),
])
def test_masks(spark, path, want):
    assert value(spark, urls.masked(F.lit("https://www.example.com" + path), 2026)) == "https://www.example.com" + (want or path)


def test_urls(spark):
    assert value(spark, urls.plain(F.lit("HTTPS://u:p@Host.com?q#f"))) == "https://host.com/" and value(spark, urls.plain(F.lit("no url"))) is None
    assert value(spark, urls.url_segments(F.lit("https://x.com/a//b/"))) == ["/a", "/a/b"] and value(spark, urls.url_segments(F.lit("www.x.com"))) == ["com", "x.com", "www.x.com"]
    assert value(spark, urls.url_segments(F.lit("none"))) == value(spark, urls.url_segments(F.lit("https://x.com/"))) == []


def test_url_normal_form(spark):
    want = {
        "http://a.com:80/x": "http://a.com/x", "https://a.com:443": "https://a.com/", "https://a.com:80/": "https://a.com:80/", "http://a.com:/x": "http://a.com/x", "  HTTP://A.com/b c\n": "http://a.com/b%20c",
        "https://a.com/a/./b/../c/..": "https://a.com/a/", "https://a.com/../../x": "https://a.com/x", "https://a.com/a/%2E%2e/b/.": "https://a.com/b/", "https://a.com/.../..x": "https://a.com/.../..x",
        "https://a.com/é😀?q": "https://a.com/%C3%A9%F0%9F%98%80", 'https://a.com/"<>^`{}|~[]%41': "https://a.com/%22%3C%3E%5E%60%7B%7D|~[]%41", "https://a.com\\b\\c": None, "https://a.com/b\\c": "https://a.com/b/c",
        "ht\ttps://a.com/": "https://a.com/", "https://u:p@a.com:443/#x": "https://a.com/", "foo://a.com/b\\c": "foo://a.com/b\\c",
    }
    got = {r["u"]: r["p"] for r in spark.createDataFrame([(u,) for u in want], "u string").select("u", urls.plain(F.col("u")).alias("p")).collect()}
    assert {u: got[u] for u in want if want[u]} == {u: p for u, p in want.items() if p}
    assert value(spark, urls.without_fragment(F.lit("https://a.com/?a b'\"<é>&c=%20#frag"))) == "https://a.com/?a%20b%27%22%3C%C3%A9%3E&c=%20"
    assert value(spark, urls.masked(F.lit("https://a.com:443/x/../12345?a b#c d`"), 2026)) == "https://a.com/%3Cnumber%3E?a%20b#c%20d%60"
    assert value(spark, urls.plain(urls.resolved(F.lit("../../b.png?x"), F.lit("https://A.com/p/q/r")))) == "https://a.com/b.png"
    assert value(spark, urls.plain(F.lit(None).cast("string"))) is None
    long = "https://a.com/" + "seg/" * 20_000
    assert value(spark, urls.plain(F.lit(long + "?q"))) == long and value(spark, urls.plain(F.lit(long + "./x"))) == long + "x"


ORIGINS = {
    "google": "paid:search:google", "facebook": ":social:facebook", "push": "owned:push", "gmb": ":local:google", "teads": "paid::teads", "newsletter": "owned:email", "dv360": "paid:video:google", "sfmc": "",
    "linkin.bio": "owned:social", "organicgmb": "owned:local:google", "chatgpt.com": "earned:ai:chatgpt", "ctv": "paid:video:amazon", "sea": "paid:search", "yext": "paid:local:yext", "reddit": "paid:social:reddit",
    "social-organic": "owned:social", "print": "owned:print", "video": ":video", "ppc": "paid", "marketo": "owned:email:marketo", "facebook-instagram": ":social:instagram", "youtube": ":video:youtube",
}


def test_classifiers(spark):
    df = spark.createDataFrame(list(ORIGINS.items()), "o string, want string")
    assert df.where(rules.acquisition(F.col("o")) != F.col("want")).collect() == []
    assert value(spark, rules.acquisition(F.lit(None).cast("string"), True)) == "paid" and value(spark, rules.acquisition(F.lit("fb"), "x")) == "x:social:facebook"
    told = {"https://www.google.com/": "search:google", "https://news.yahoo.co.jp/": "news:yahoo", "https://x.com/": "social:x", "http://localhost:3000": "developer:localhost", "https://ads.eu.criteo.com/": "ads:criteo", "https://example.com/": None, "": None}
    for url, want in told.items():
        r = value(spark, rules.referrer(F.lit(url)))
        assert (r and f"{r['type']}:{r['vendor']}") == want
    for css, want in {"#onetrust-reject-x": ("onetrust", "reject"), "#didomi-host .didomi-popup-close": ("tealium", "dismiss"), "#usercentrics-root": ("usercentrics", None), "#CybotCookiebotDialogBodyButtonDecline": ("cybot", "reject"), ".x": None}.items():
        r = value(spark, rules.consent(F.lit(css)))
        assert (r and tuple(r)) == want
    assert [fa.is_known_facet(k) for k in ("url", "url!", "click.source~", "click.x", "404", "cwv-lcp", "url!!", "")] == [True, True, True, False, False, False, False, False]


def test_histograms(spark):
    x = Explorer(frame(spark, *[bundle(str(i), weight=1) for i in range(31)])).with_facet("n", F.col("id"))
    assert x.thresholds("n") == [3.0 * i for i in range(10)]
    view = rows(x.with_histogram("h", "n").facet_view(["h"]))
    assert sum(n for n, _ in view.values()) == 31 and view["h", "<3"] == (3, 3) and view["h", ">=27"] == (4, 4)
    assert x.thresholds("n", 2, steps="quantiles") == [12, 25] and x.thresholds("n", 2, 10, 20)[0] == 10
    assert x.thresholds("n", 3, steps="logarithmic")[0] == 1
    for n, weights in ((5, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]), (4, [100, 1, 1, 1, 1]), (3, [1, 1])):  # as one fold over the ordered values
        y = Explorer(frame(spark, *[bundle(str(i), weight=w) for i, w in enumerate(weights)])).with_facet("n", F.col("id"))
        now, out, step = 0, [], sum(weights) / (n + 1 / n)
        for i, w in enumerate(weights):
            now += w
            if now > step:
                out.append(i)
                now = 0
        assert y.thresholds("n", n, steps="quantiles") == [(out[k] if k < len(out) else 0) or len(weights) - 1 for k in range(n)]
    cut = x.with_filter({"n": ["1"]}).with_facet("w", F.col("weight")).with_filter({"w": ["5"]}).with_histogram("h", "n", 2)
    assert cut.with_filter({}).facet_view(["h"]).count() == 0


def test_clusters(spark):
    x = Explorer(frame(spark, *[bundle(str(i), url=f"https://x.com/a/{i}") for i in range(12)], bundle("z", url="https://x.com/b"))).with_facet("u", fa.plain_url())
    assert x.top_clusters("u") == ["/a"]
    view = rows(x.with_clusters("c", "u", 1, negative="none").facet_view(["c"]))
    assert view["c", "/a"] == (12, 1200) and view["c", "https://x.com/b"] == (1, 100) and len(view) == 14


def test_stats(spark):
    v = lambda c: value(spark, c)
    assert [v(stats.sampling_error(F.lit(a), F.lit(b))) for a, b in ((60, 10), (600, 100), (300, 100), (30, 10), (5, 0))] == [37, 118, 59, 19, 0]
    assert v(stats.z_test_two_proportions(*[F.lit(float(x)) for x in (1000, 100, 1000, 100)])) == 1 and v(stats.z_test_two_proportions(*[F.lit(float(x)) for x in (1000, 100, 1000, 10)])) < 1e-6
    assert v(stats.standard_normal_cdf(F.lit(1.96))) == pytest.approx(0.975, abs=1e-4) and v(stats.erf(F.lit(-1.0))) == pytest.approx(math.erf(-1), abs=1e-6)
    assert [v(stats.conversion_rate(F.lit(a), F.lit(b))) for a, b in ((1, 4), (0, 0), (5, 4), (-1, 4))] == [25, 100, 100, 100]
    assert [v(stats.score_vital(F.lit(x), n)) for x, n in ((2499.0, "lcp"), (2500.0, "LCP"), (0.25, "cls"), (7e9, "x"), (None, "lcp"))] == ["good", "ni", "poor", "good", None]
    line = stats.regression(spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(5)], "i double, v double"), "v", "i").first()
    assert tuple(line) == pytest.approx((2, 1))
    counts = spark.createDataFrame([(1.0,)] * 10 + [(2.0,)] * 5 + [(0.0,), (-3.0,), (float("inf"),), (float("nan"),)], "m double")
    c = stats.chao1(counts, "m").first()
    assert (c["sObs"], c["f1"], c["f2"], c["sHat"], c["sUnseen"]) == (15, 10, 5, 25, 10) and c["lower"] < 25 < c["upper"]
    none = stats.chao1(counts.limit(0), "m").first()
    assert (none["sObs"], none["lower"], none["upper"], none["variance"], none["deltaBC"]) == (0, 0, 0, 0, None)
    assert v(stats.samples_of_error(F.lit(100.0), F.lit(196.0))) == 1 and v(stats.samples_of_error(F.lit(100.0), F.lit(0.0))) == 0


def test_formats(spark):
    shown = {100: "100", 1000: "1k", 10**5: "100k", 10**6: "1m", 10**12: "1t", 10**15: "1000t", 10**16: "10,000t", 10**18: "1,000,000t", 1500: "1.5k", 150_000: "150k"}
    assert {n: formats.round_to_confidence_interval(n) for n in shown} == shown
    cut = {(31415, 30): "31k", (3141592, 300): "3.1m", (314159265, 3000): "310m", (3141592653, 30): "3.1b", (3141592653, 300000): "3.142b", (3141592653, 3000): "3.1b"}
    assert {k: formats.round_to_confidence_interval(*k) for k in cut} == cut
    ties = {1250: "1.3k", 1.25: "1.3", 125: "130", 1.15: "1.2", -1250: "-1.3k", 1350: "1.4k", 99.5: "100", 999_500: "1m"}
    assert {n: formats.to_human_readable(n) for n in ties} == ties
    assert [two_digits(x) for x in (0.125, 125.0, 1.25, 2.5, 1e6, 0.0, 12345.0, -0.125, 99.6)] == ["0.13", "130", "1.3", "2.5", "1,000,000", "0", "12,000", "-0.13", "100"]
    assert value(spark, formats.rounded_to_confidence(F.lit(3141592653), F.lit(300000))) == "3.142b" and value(spark, formats.rounded_to_confidence(F.lit(None).cast("double"))) is None
    assert formats.to_human_readable(float("nan")) == "-" and formats.to_human_readable(999_999) == "1m"
    assert value(spark, formats.human_readable(F.lit(1234), 3)) == "1.23k"


def test_trace(spark, tmp_path):
    node = lambda i, **f: {"id": i, "callFrame": f}
    event = {"cat": "disabled-by-default-v8.cpu_profiler", "name": "ProfileChunk", "args": {"data": {"cpuProfile": {"nodes": [node(1, url="a.js", functionName="f"), node(2, functionName="g"), {"id": 3}], "samples": [1, 2, 2, 9, 3]}, "timeDeltas": [5, 7]}}}
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump({"traceEvents": [event, {"cat": "x"}, event]}, f)
    got = trace.profile(trace.read_trace(spark, str(tmp_path)))
    assert [tuple(r) for r in got.collect()] == [("(inline)#g", 14, 4), ("a.js#f", 10, 2)]
    (tmp_path / "u.json").write_text('{"traceEvents": [{"cat"')
    both = trace.read_trace(spark, str(tmp_path))
    assert sorted(map(tuple, trace.profile(both).collect())) == sorted(map(tuple, got.collect())) and trace.broken(both).first()["file"].endswith("u.json")
    assert trace.report(got).first()["line"] == "0.01ms\t(samples=4)\t(inline)#g"
    assert [value(spark, formats.milliseconds(F.lit(x))) for x in (125, 15, 5, 1234567, 0)] == ["0.13ms", "0.01ms", "0.01ms", "1234.57ms", "0.00ms"]
    assert trace.top(got, "a\\.js").count() == 1 and trace.top(got, "none", 1).first()["key"] == "(inline)#g"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"date": "d", "rumBundles": [bundle("a", [("enter", "")]), bundle("b", time="2024-05-06T07:59:00Z")]}))
    out = windows.hourly(windows.read_stream(spark, f"{tmp_path}/in"), {"visits": se.visits()})
    query = out.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    assert [(r["bundles"], r["visits"]) for r in spark.table("hours").orderBy("hour").collect()] == [(1, 100), (1, 0)]
