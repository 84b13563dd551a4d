import gc
import weakref

import pytest
from pyspark.sql import functions as F

from chronolith.operators import labeling, links, pages, panel, quality, stats
from chronolith.operators.extract import Limits, extract_totals, monthly_total
from chronolith.operators.labeling import Ontology, Rule
from chronolith.operators.links import SourceRule
from chronolith.plans import queries


def scores(spark, rule, title, body):
    df = spark.createDataFrame([(title, body)], "title string, text string")
    return labeling.scored(df, Ontology((rule,))).first()[rule.code]


def test_scoring(spark):
    assert scores(spark, Rule("X", ("recall",)), "Recall recall", "recall") == 3
    assert scores(spark, Rule("X", ("exit",), ("entered into an agreement",)), "", "exit; entered into an agreement") == 0
    assert scores(spark, Rule("X", ("from R",)), "", "data from reports") == 1
    assert scores(spark, Rule("X", ("a",)), None, None) == 0
    docs = spark.createDataFrame([("data from reports",)], "text string")
    assert labeling.pattern_frequency(docs, Ontology((Rule("X", ("from R", "data")),))).first()["matches"] == 1
    wide = spark.createDataFrame([(1, "recall recall", "x")], "id long, title string, text string")
    rules = Ontology((Rule("A", ("recall",), (), 2), Rule("B", ("recall",), (), 3)))
    assert labeling.label_matrix(wide, rules).select("A", "B").first() == (1, 0)
    assert [r["event_code"] for r in labeling.label_hits(wide, rules).collect()] == ["A"]


@pytest.mark.parametrize(("url", "title", "want"), [("https://x.test/news", "", True), ("https://x.test/news/motoring/", "", True), ("https://x.test/category/cars", "", True), ("https://x.test/news/a-story", "Hello", False)])
def test_listing(spark, url, title, want):
    row = spark.createDataFrame([(url, title, "t", None, None), (url, title, "t", None, "2024")], "u string, t string, x string, r string, p string")
    got = row.select(labeling.listing_page(*map(F.col, "utxrp")).alias("l"), labeling.listing_page(*map(F.col, "utxrp"), strict=True).alias("s")).collect()
    assert [tuple(r) for r in got] == [(want, False), (False, False)]


def test_links(spark):
    rule = SourceRule("s", (r"^https?://(www\.)?x\.test/m/.*", "["), ("/tag/",))
    urls = spark.createDataFrame([("HTTPS://X.test/m/1",), ("https://x.test/m/tag/",), ("https://x.test/m/TAG/",), (" ",)], "u string")
    assert [r[0] for r in urls.select(links.allowed(F.col("u"), rule)).collect()] == [True, False, True, False]
    for hi, want in ((5, [1, 5, 2, 4, 3]), (4, [1, 4, 2, 3])):
        assert [r["page"] for r in links.page_order(spark.range(1, hi + 1).toDF("page")).orderBy("place").collect()] == want
    queue = spark.createDataFrame([("b/uploads/2024/03/b",), ("b/uploads/2024/03/a",), ("c",), ("b/uploads/2023/12/d",)], "pdf_url string")
    assert [r["pdf_url"][-1] for r in links.download_queue(queue, 9).collect()] == ["a", "b", "d", "c"]
    log = spark.createDataFrame([("u1", "success"), ("u2", "failed"), ("u3", "skipped")], "pdf_url string, status string")
    assert sorted(r["pdf_url"] for r in links.pending(log.select("pdf_url"), log).collect()) == ["u2", "u3"]
    assert spark.createDataFrame([("/wp/uploads/2024/03/a b.pdf?x",)], "u string").select(links.output_name(F.col("u"))).first()[0] == "2024_03_a_b.pdf"


CASES = [
    ("In January 2024 new vehicle sales totalled 41,636 units.", (2024, 1), (41636, "HEADLINE_REGEX", "high", "", "NEW_VEHICLE_SALES_ANCHORED_SCAN")),
    ("In January 2024 new vehicle sales totalled 41,636 units.", (None, None), (41636, "HEADLINE_REGEX", "medium", "", "NEW_VEHICLE_SALES_ANCHORED_SCAN")),
    ("In January 2024 new vehicle sales totalled 81,636 units.", (2024, 1), (81636, "HEADLINE_REGEX", "high", "OUT_OF_RANGE", "NEW_VEHICLE_SALES_ANCHORED_SCAN")),
    ("Industry Total 41,636 40,900 1,200 +2.1%", (None, None), (41636, "ANCHORED_INDUSTRY_TOTAL", "medium", "MULTIPLE_TOTALS_NEARBY", "INDUSTRY_TOTAL_FIRST_NUMBER_TEXT")),
    ("Industry Total YTD 41,636", (None, None), (None, "", "", "", "")),
    ("Total vehicle sales 31 500 for the period", (None, None), (31500, "FALLBACK_SCAN", "low", "", "FALLBACK_SCAN_NEAR_TOTAL_VEHICLE_SALES")),
    ("Report 31,500 and 42,100 figures", (None, None), (None, "", "", "AMBIGUOUS", "")),
    ("new vehicle sales were 15 364 2024", (None, None), (None, "", "", "", "")),
]


@pytest.mark.parametrize(("text", "period", "want"), CASES)
def test_extraction(text, period, want):
    got = monthly_total(text, "", Limits(), period)
    assert (got.value, got.method, got.confidence, got.warning, got.pattern) == want


def test_extraction_switches_and_frame(spark):
    text = "In January 2024 new vehicle sales totalled 41,636 units."
    assert monthly_total(text, "", Limits(lazy_gaps=True), (2024, 1)).pattern == "NEW_VEHICLE_SALES_TOTALLED_UNITS"
    rows = spark.createDataFrame([(text, [[["Industry Total", "20,000"]]], "x.pdf"), (None, None, None)], "text string, tables array<array<array<string>>>, file_name string")
    got = extract_totals(rows).select("period_year", "period_month", "total_sales_units").collect()
    assert [tuple(r) for r in got] == [(2024, 1, 41636), (None, None, None)]


def test_headline_behind_a_long_text(spark):
    text = "word " * 50_000 + "In January 2024 new vehicle sales totalled 41,636 units."
    rows = spark.createDataFrame([(text, None, None)], "text string, tables array<array<array<string>>>, file_name string")
    one = lambda limits: tuple(extract_totals(rows, limits).select("total_sales_units", "extraction_method").first())
    assert one(Limits()) == (41636, "HEADLINE_REGEX")
    assert one(Limits(head=50_000)) == (41636, "FALLBACK_SCAN") and one(Limits(chars=220_000)) == (None, "")


@pytest.mark.parametrize("key", ["9c82e4685ca7e26784", "17728a3e3d77648d9b", "x1y26784"])
def test_digits_of_a_key_are_no_total(key):
    for text, want in ((f"password={key} a. Total vehicle sales 40,695 for the period", 40695), (f"Industry Total {key} 40,695", 40695), (f"New vehicle sales were {key} units", None)):
        assert (monthly_total(text, "", Limits(), (None, None)).value, monthly_total(text, "", Limits(), (None, None)).warning) == (want, "")
    assert monthly_total("Total vehicle sales to40,695units", "", Limits(), (None, None)).value == 40695  # glued words


def test_best_by_month(spark):
    rows = [
        (2024, 1, "FALLBACK_SCAN", "low", "", 1, "a"), (2024, 1, "HEADLINE_REGEX", "medium", "", 1, "c"), (2024, 1, "HEADLINE_REGEX", "high", "", 1, "d"), (2024, 1, "HEADLINE_REGEX", "high", "", 1, "b"),
        (2024, 2, None, None, None, None, "z"), (2024, 2, None, None, None, None, "y"), (None, 2, None, None, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "period_year int, period_month int, extraction_method string, extraction_confidence string, evidence_window string, total_sales_units long, pdf_path string")
    for parts in (1, 5):
        assert sorted(r["pdf_path"] for r in panel.best_by_month(df.repartition(parts)).collect()) == ["b", "y"]


def test_coverage_lag_and_model(spark):
    frame = spark.createDataFrame
    got = panel.coverage(
        frame([("2024-01", 2)], "month_id string, news_articles int"),
        frame([("2024-01", 3.0), ("2024-02", 0.0)], "month_id string, event_intensity_total double"),
        panel.sales_months(frame([("2024-02", None)], "month_id string, total_sales_units long")),
        panel.panel_months(frame([("2024-03", 5, 1)], "month_id string, total_sales_units long, flag int")),
    ).orderBy("month_id")
    assert [tuple(r)[1:] for r in got.collect()] == [(2, 3.0, 0, None, 0, None, None), (0, 0.0, 1, True, 0, None, None), (0, 0.0, 0, None, 1, False, 1.0)]
    months = frame([("2019-04", 5, 1), ("2022-03", 7, 1)], "month_id string, flag int, total_sales_units long")
    assert [r["events_t_minus_1"] for r in stats.lagged(months).orderBy("month_id").collect()] == [None, 5.0]
    with pytest.raises(ValueError, match="complete months"):
        stats.lag_model(months)
    flags = [(k * 7) % 11 for k in range(40)]
    rows = [(f"{2019 + k // 12}-{k % 12 + 1:02d}", flags[k], 100.0 + 3 * flags[k] + 2 * flags[k - 1] + k % 12) for k in range(1, 40)]
    model = {r["variable"]: r for r in stats.lag_model(frame(rows, "month_id string, flag int, total_sales_units double")).collect()}
    assert abs(model["events_t"]["coef"] - 3) < 1e-6 and abs(model["events_t_minus_1"]["coef"] - 2) < 1e-6 and model["events_t"]["n_obs"] == 38


def test_quality(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k long, v string")
    got = {r["column"]: tuple(r)[1:] for r in quality.profile(df, "k").collect()}
    assert got["v"] == ("string", 1, 50.0, "a|b")
    assert spark.createDataFrame([("x" * 81,)], "v string").select(quality.shown(F.col("v"))).first()[0] == "x" * 77 + "..."
    good = spark.createDataFrame([(2024, m, m) for m in range(1, 13)], "period_year int, period_month int, flag int")
    quality.enforce(quality.count_checks(good, ["flag"]))
    with pytest.raises(quality.GateError, match="unique_period"):
        quality.enforce(quality.count_checks(good.union(good), ["flag"]))
    with pytest.raises(quality.GateError):
        quality.require_columns(good, ["none"])


PAGE = """<html><head><meta property="og:title" content="Shared &amp; title"><meta name="author" content="Ann"><title>Own</title>
<script type="application/ld+json">{"@graph": [{"datePublished": "2024-03-05T10:00:00Z"}]}</script></head>
<body><nav><a href="/n">Next</a></nav><article>%s<script>x()</script></article></body></html>""" % ("word " * 60)


def test_pages(spark):
    df = spark.createDataFrame([("https://x.test/a/", PAGE), ("https://x.test/b", None)], "url string, html string")
    rows = pages.page_fields(df).collect()
    assert (rows[0]["title"], rows[0]["author"], rows[0]["published_at"]) == ("Shared & title", "Ann", "2024-03-05T10:00:00Z")
    assert rows[0]["text"] == ("word " * 60).strip() and rows[1]["text"] == ""
    found = pages.page_links(df).select("link_url", "link_text").collect()
    assert [tuple(r) for r in found] == [("https://x.test/n", "Next")]
    feed = "<rss><channel><item><link>http://a</link></item><item><link>http://a</link></item></channel></rss>"
    assert pages.feed_links(feed) == ["http://a"] and pages.feed_links("<x") == []


def test_a_worker_holds_few_pages_at_once(spark):
    """Pages go out a hundred at a time, not in Arrow batches, and a tree goes with its page."""
    df = spark.createDataFrame([("https://x.test/", PAGE)], "url string, html string")
    for found in (pages.page_fields(df), pages.page_links(df), pages.feed_items(df, "html")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan
    gc.disable()
    try:
        gone = weakref.ref(pages.Page(PAGE).root), weakref.ref(pages.parse("<div><p>" * 100_000 + "</b></p>"))
        assert [r() for r in gone] == [None, None]
    finally:
        gc.enable()


def test_industry_totals_read_whole_texts(spark, tmp_path):
    docs = [(k, f"Long text {k} " * 50) for k in range(4)] + [(4, None), (5, "industry total 44,000 units " + "x" * 300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["total"] for r in queries.industry_totals(spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: 15001, 2: 15002, 3: None, 4: None, 5: 44000}


@pytest.mark.parametrize(
    ("html", "title", "text", "href"),
    [
        ("<title>a&amp</title><h1>a&amp;&amp</h1><a href='?x=1&copy=2&amp;y'>b</a>", "a&amp", "a&amp a&&amp b", "?x=1&copy=2&y"),
        ("<title>&notit; &lt;</title><a href='/&#38'>&#38 &\ufdd0</a><script>a&&b&amp;c</script>", "&notit; <", "&notit; < & &\ufdd0", "/&"),
    ],
)
def test_named_references_end_with_a_semicolon(html, title, text, href):
    page = pages.Page(html)
    assert (pages.title(page), page.root.text(), page.first("a").attrs["href"]) == (title, text, href)
    assert [n.children for n in page.by_name.get("script", ())] in ([], [["a&&b&amp;c"]])


LONG = "word " * 60


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div class='related-articles'>{LONG}no</div><div class='x content'>{LONG}yes</div>", (LONG + "yes").strip()),
        (f"<article>short</article><div class=entry-content>{LONG}<script>no</script></div>", LONG.strip()),
        (f"<div class=story>{LONG}a</div><p>b</p>", f"{LONG}a b"),
        (f"<article>it ΓÇô is{LONG}</article>", f"it - is{LONG}".strip()),
    ],
)
def test_main_container(html, want):
    assert pages.main_text(pages.Page(f"<body>{html}</body>")) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<meta name=author content='  A  B '><p class=author>C D</p>", "A B"),
        ("<meta name=author content=' '><p class='x Big-AUTHOR-box'>C D</p>", "C D"),
        ("<p class=byline>E F</p><p class=author>x</p>", "E F"),  # a text of one character is no name
        (f"<p class=author>{LONG * 2}</p><p class=author>C D</p>", ""),
        ("<p>none</p>", ""),
    ],
)
def test_author(html, want):
    assert pages.author(pages.Page(html)) == want


LD = "<script type='application/ld+json'>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<meta name=sailthru.date content=2021><meta property='og:published_time' content=2020>", "2020"),
        ("<meta name=timestamp content=1><meta name=dc.date.issued content=2022>", "2022"),
        ("<time>5 May 2021</time><time datetime=2020></time>", "5 May 2021"),
        (LD + '[{"datePublished":"no", "@graph":[{"x":1},{"datePublished":"2020-01-02"}]}]</script>', "2020-01-02"),
        (LD + "{broken</script>" + LD + '{"datePublished":"2020-01-03"}</script>', "2020-01-03"),
        (LD + '[1, {"datePublished": 2020}]</script>', "2020"),
        ("<p>2020-01-01</p>", ""),
    ],
)
def test_published(html, want):
    assert pages.published(pages.Page(html)) == want


def test_unparsable_date_is_looked_for_in_the_text(spark):
    rows = [(1, f"<meta name=date content=soon><article>{LONG} 7 June 2021</article>"), (2, "<meta name=date content='2021-03-04'><p>7 June 2021</p>"), (3, "<p>x</p>"), (4, None)]
    got = {r["id"]: (r["published_raw"], r["published_at"]) for r in pages.page_fields(spark.createDataFrame(rows, "id long, html string")).collect()}
    assert got == {1: ("soon", "2021-06-07T00:00:00Z"), 2: ("2021-03-04", "2021-03-04T00:00:00Z"), 3: ("", ""), 4: ("", "")}


def test_broken_patterns_are_left_out(spark):
    assert scores(spark, Rule("X", ("a(", "b"), ("c(",)), "", "b") == 1
    assert scores(spark, Rule("X", ("Stra\u00dfe|S", "K")), "", "\u017f \u212a") == 2  # ignoring case takes the long s and the Kelvin sign, too
    docs = spark.createDataFrame([("abc",)], "text string")
    assert labeling.pattern_frequency(docs, Ontology((Rule("X", ("a(", "b")),))).first()["matches"] == 1


def test_sections(spark):
    rule = SourceRule("s", (r"^https://x\.test/a",))
    page = lambda k, body: (f"https://x.test/p/{k}", 200, body)
    link = lambda *names: "".join(f"<a href='/{n}'>{n}</a>" for n in names)
    rows = [page(1, link("a1", "b")), page(2, link("a2")), page(3, link("a1", "a3")), page(4, link("a4", "a2")), ("https://x.test/p/5", 404, link("a5")), ("https://x.test/p/6", 200, "")]
    stored = spark.createDataFrame(rows, "url string, status int, html string")
    found = [r["link_url"][-2:] for r in pages.section_links(stored, rule, "https://x.test/p/{page}", 1, 10).collect()]
    assert found == ["a1", "a4", "a2", "a3"]  # pages 1, 4, 2, 3
    assert pages.section_links(stored, rule, "https://x.test/q/{page}").count() == 0
    chain = [("https://x.test/n", 200, link("a1") + "<a href='/m'>Next page</a><a href='/o'>next</a>"), ("https://x.test/m", 200, link("a2", "a1") + "<a href='/n'>older</a>"), ("https://x.test/o", 200, link("a9"))]
    stored = spark.createDataFrame(chain, "url string, status int, html string")
    assert [r["link_url"][-2:] for r in pages.chain_links(stored, rule, "https://x.test/n").collect()] == ["a1", "a2"]
    feed = spark.createDataFrame([("<rss><item><link>https://x.test/a1</link></item><item><link>https://x.test/b</link></item></rss>",)], "xml string")
    assert [r["link_url"] for r in pages.feed_items(feed, "xml", rule).collect()] == ["https://x.test/a1"]


def test_panel_gate(spark):
    rows = [("2020-01", 2020, 1, 5.0, 1, 2), ("2020-02", 2020, 3, None, -1, 2), ("2020-03", 2020, 3, None, None, 0)]
    df = spark.createDataFrame(rows, "month_id string, period_year int, period_month int, total_sales_units double, a int, b int")
    got = {r["check"]: (r["passed"], r["detail"]) for r in quality.panel_checks(df).collect()}
    assert got == {"unique_month": (True, 0), "numeric": (False, 1), "not_negative": (False, 1), "month_agrees": (False, 1), "missing_sales": (True, 2)}
    assert quality.documented_months("- 2020-03\n- 2020-02  \n* 2020-04") == ["2020-02", "2020-03"]
    with pytest.raises(quality.GateError):
        quality.documented_months("none")
    month = lambda *names: spark.createDataFrame([(n,) for n in names], "month_id string")
    quality.enforce(quality.documented_checks(df, month("2020-02", "2020-03", "2020-03")))
    with pytest.raises(quality.GateError, match="not_missing: 1"):
        quality.enforce(quality.documented_checks(df, month("2020-02", "2020-03", "2021-01")))


def test_snapshot_faults_and_counts(spark):
    import hashlib

    digest = lambda x: hashlib.sha256(x).hexdigest()
    rows = spark.createDataFrame([("a", "p1", digest(b"1")), ("b", "p2", digest(b"2")), ("c", "p3", digest(b"3")), ("d", "p9", "x")], "article_id string, snapshot_path string, snapshot_sha256 string")
    files = spark.createDataFrame([("p1", bytearray(b"1")), ("p2", bytearray(b"x"))], "path string, content binary")
    assert {r["article_id"]: r["fault"] for r in quality.snapshot_mismatches(rows, files, 3).collect()} == {"b": "differs", "c": "missing"}
    seen, counts = quality.observed(rows, "rows", marked=F.count_if(F.col("snapshot_sha256") == "x"))
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == {"rows": 4, "marked": 1}
    with pytest.raises(quality.GateError):
        quality.require_tables(spark, ["/no/such/file"])


def test_lag_model_by_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(f"{2019 + k // 12}-{k % 12 + 1:02d}", int(rng.integers(0, 40)), None if k % 11 == 5 else float(rng.integers(100, 200))) for k in range(50)]
    got = {r["variable"]: r for r in stats.lag_model(spark.createDataFrame(rows, "month_id string, hits int, total_sales_units double")).collect()}
    kept = [(m, y, x, rows[k][1]) for k, (m, x, y) in enumerate(rows[1:]) if y is not None]
    months, years = sorted({m[5:] for m, *_ in kept})[1:], sorted({m[:4] for m, *_ in kept})[1:]
    a = np.array([[1, x, lag, *(m[5:] == v for v in months), *(m[:4] == v for v in years)] for m, _, x, lag in kept], float)
    y = np.array([r[1] for r in kept])
    coef, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ coef
    error = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (rest @ rest) / (len(y) - a.shape[1]))
    names = ["const", "events_t", "events_t_minus_1", *(f"month_{int(m)}" for m in months), *(f"year_{y}" for y in years)]
    for name, c, e in zip(names, coef, error, strict=True):
        assert (got[name]["coef"], got[name]["std_err"], got[name]["n_obs"]) == (pytest.approx(c, rel=1e-6, abs=1e-6), pytest.approx(e, rel=1e-6), len(y))
