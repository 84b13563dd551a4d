"""Registered queries over the test tables, each with SQL that states the same in another engine's terms.

documents stand in for articles, pages for stored HTML, orders for monthly sales, lineitem for monthly event counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import hashing, text, times
from chronolith.operators import extract, labeling, links, pages, panel, quality, stats
from chronolith.operators.labeling import Ontology, Rule
from chronolith.operators.links import SourceRule
from chronolith.sources.tables import parquet
from chronolith.streaming import events as streaming

ONTOLOGY = Ontology(
    (
        Rule("LICENSING", ("licen[cs]e", "copyright", "general public"), ("all rights",), 1),
        Rule("MOTION", ("tion", "the ing"), (), 3),
        Rule("LINKING", ("with", "from", "that"), ("token",), 3),
        Rule("ROMANCE", ("que", "ment", "ción"), (), 2),
    )
)
RULES = [
    SourceRule("com", (r"^https?://[^/]*\.com/",), ("/es/", "utm_")),
    SourceRule("net", (r"^https?://[^/]*\.net/", r"^HTTPS?://M\.")),
    SourceRule("all", (), ("?",)),
    SourceRule("hub", (), (), "news_site", True),
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("doc_id") % 2500).cast("int"))
    return docs.select(
        "doc_id", "text", F.col("source").alias("source_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), day.alias("day"), F.year(day).alias("period_year"), F.month(day).alias("period_month"), times.month_of(day).alias("month_id")
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = times.month_of(F.col("l_shipdate"))
    flags = [F.count_if(F.col("l_returnflag") == f).alias(f"flag_{f.lower()}") for f in "ANR"]
    return parquet(spark, sf_dir, "lineitem").groupBy(month.alias("month_id")).agg(*flags)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals; every seventh month lacks its total."""
    month = times.month_of(F.col("o_orderdate"))
    rows = parquet(spark, sf_dir, "orders").groupBy(month.alias("month_id")).agg(F.count("*").alias("n"))
    return rows.select("month_id", F.when(times.number_of_month(F.col("month_id")) != 7, F.col("n")).alias("total_sales_units"))


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).join(sales(spark, sf_dir), "month_id", "left")


ARTICLES = """a AS (SELECT doc_id, text, source AS source_id, split_part(text, chr(10), 1) AS title, (DATE '2019-01-01' + (doc_id % 2500)::INTEGER) AS day FROM documents),
art AS (SELECT *, year(day)::INTEGER AS period_year, month(day)::INTEGER AS period_month, strftime(day, '%Y-%m') AS month_id FROM a)"""
COUNTS = """c AS (SELECT strftime(l_shipdate, '%Y-%m') AS month_id, count(*) FILTER (l_returnflag = 'A') AS flag_a, count(*) FILTER (l_returnflag = 'N') AS flag_n, count(*) FILTER (l_returnflag = 'R') AS flag_r FROM lineitem GROUP BY 1),
s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month_id, CASE WHEN month(min(o_orderdate)) <> 7 THEN count(*) END AS total_sales_units FROM orders GROUP BY 1),
p AS (SELECT c.*, s.total_sales_units FROM c LEFT JOIN s USING (month_id))"""


def _score_sql(rule: Rule) -> str:
    points = " + ".join(f"(CASE WHEN regexp_matches(lower({c}), '(?i){p}') THEN {w} ELSE 0 END)" for p in rule.positive for c, w in (("title", ONTOLOGY.title_weight), ("text", ONTOLOGY.body_weight)))
    if not rule.negative:
        return f"({points})"
    veto = " OR ".join(f"regexp_matches(lower(title || chr(10) || text), '(?i){p}')" for p in rule.negative)
    return f"(CASE WHEN {veto} THEN 0 ELSE {points} END)"


SCORES = f"{ARTICLES}, sc AS (SELECT art.*, {', '.join(f'{_score_sql(r)} AS {r.code}' for r in ONTOLOGY.rules)} FROM art)"


@query("event_month_counts", f"WITH {SCORES} SELECT period_year, period_month, {', '.join(f'sum(({r.code} >= {r.min_score})::INTEGER)::BIGINT AS {r.code}' for r in ONTOLOGY.rules)} FROM sc GROUP BY ALL")
def event_month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.month_counts(labeling.label_matrix(articles(spark, sf_dir), ONTOLOGY), ONTOLOGY.codes)


@query("event_hits", " UNION ALL ".join(f"(WITH {SCORES} SELECT doc_id, '{r.code}' AS event_code, {r.code}::INTEGER AS score FROM sc WHERE {r.code} >= {r.min_score})" for r in ONTOLOGY.rules))
def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_hits(articles(spark, sf_dir), ONTOLOGY).select("doc_id", "event_code", "score")


@query("event_matrix", f"WITH {SCORES} SELECT doc_id, {', '.join(f'({r.code} >= {r.min_score})::INTEGER AS {r.code}' for r in ONTOLOGY.rules)} FROM sc")
def event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_matrix(articles(spark, sf_dir), ONTOLOGY).select("doc_id", *ONTOLOGY.codes)


@query(
    "pattern_frequency",
    " UNION ALL ".join(f"SELECT '{r.code}' AS event_code, sum({' + '.join(f"regexp_matches(lower(text), '{p}')::BIGINT" for p in r.positive)})::BIGINT AS matches FROM documents" for r in ONTOLOGY.rules),
)
def pattern_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.pattern_frequency(parquet(spark, sf_dir, "documents"), ONTOLOGY)


PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "listing_pages",
    f"""SELECT page_id, page_id % 3 = 0 AND (regexp_matches(u, '^https?://[^/]+/news$') OR regexp_matches(u, '/news/(category|latest|industry|motoring|cars|vehicle)s?$') OR regexp_matches(u, '/category/[^/]+$')
OR (regexp_matches(t, 'motoring|latest|category|news') AND length(html) > 2000)) AS listing
FROM (SELECT page_id, html, lower(rtrim(CASE WHEN page_id % 5 = 0 THEN 'https://x.example/News/' WHEN page_id % 5 = 1 THEN 'https://x.example/category/cars' ELSE url END, '/')) AS u, 'latest ' || lower({PAGE_TITLE}) AS t FROM pages)""",
)
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, "https://x.example/News/").when(k == 1, "https://x.example/category/cars").otherwise(F.col("url"))
    title = F.concat(F.lit("latest "), F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
    dated = F.when(F.col("page_id") % 3 != 0, "2024-01-01")
    return parquet(spark, sf_dir, "pages").select("page_id", labeling.listing_page(url, title, F.col("html"), F.lit(None).cast("string"), dated).alias("listing"))


@query("article_identity", f"WITH {ARTICLES}, h AS (SELECT doc_id, sha256(title || chr(10) || text) AS text_sha256 FROM art) SELECT doc_id, text_sha256, text_sha256[:16] AS article_id, sha256(text_sha256 || '|' || 'http://x/' || doc_id)[:16] AS fallback_id FROM h")
def article_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("doc_id", hashing.article_sha256(F.col("title"), F.col("text")).alias("text_sha256"))
    url = F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))
    return rows.select("*", hashing.article_id(F.col("text_sha256")).alias("article_id"), hashing.fallback_id(F.col("text_sha256"), url).alias("fallback_id"))


@query(
    "simhash64",
    """WITH t AS (SELECT doc_id, token, count(*) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents) GROUP BY ALL),
m AS (SELECT doc_id, w, ('0x' || substr(md5(token), 1, 16))::UBIGINT AS h FROM t),
b AS (SELECT doc_id, k, sum(CASE WHEN (h >> k) & 1 = 1 THEN w ELSE -w END) AS s FROM (SELECT *, unnest(range(64))::UBIGINT AS k FROM m) GROUP BY ALL),
u AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN (1::UBIGINT << k)::HUGEINT ELSE 0 END) AS v FROM b GROUP BY 1)
SELECT doc_id, (CASE WHEN v > 9223372036854775807 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS simhash64 FROM u""",
)
def simhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.simhash64(parquet(spark, sf_dir, "documents"), "doc_id", "text")


@query("token_frequency", "SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents) GROUP BY 1")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.token_frequency(parquet(spark, sf_dir, "documents"), "text")


COVERAGE = f"""WITH {ARTICLES}, {COUNTS},
n AS (SELECT month_id, count(*)::INTEGER AS news_articles FROM art GROUP BY 1),
e AS (SELECT month_id, (flag_a + flag_n + flag_r)::DOUBLE AS event_intensity_total FROM c),
v AS (SELECT month_id, total_sales_units IS NULL AS naamsa_total_missing, 1 AS naamsa_available FROM s),
q AS (SELECT month_id, bool_or(total_sales_units IS NULL) AS panel_sales_missing, sum(flag_a + flag_n + flag_r)::DOUBLE AS panel_event_intensity_total, 1 AS panel_available FROM p GROUP BY 1)
SELECT month_id, coalesce(news_articles, 0)::INTEGER AS news_articles, coalesce(event_intensity_total, 0)::DOUBLE AS event_intensity_total, coalesce(naamsa_available, 0)::INTEGER AS naamsa_available, naamsa_total_missing,
coalesce(panel_available, 0)::INTEGER AS panel_available, panel_sales_missing, panel_event_intensity_total FROM n FULL JOIN e USING (month_id) FULL JOIN v USING (month_id) FULL JOIN q USING (month_id)"""


@query("coverage_audit", COVERAGE)
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = month_panel(spark, sf_dir)
    return panel.coverage(panel.news_months(articles(spark, sf_dir)), panel.event_months(counts(spark, sf_dir)), panel.sales_months(sales(spark, sf_dir)), panel.panel_months(both)).orderBy("month_id")


@query("missingness_audit", f"WITH {COUNTS} SELECT DISTINCT month_id, 'total_sales_units' AS missing_field, 'panel_monthly_events_sales' AS dataset, 'missing_in_panel' AS reason FROM p WHERE total_sales_units IS NULL")
def missingness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.missing_months(month_panel(spark, sf_dir))


@query("sales_event_panel", f"WITH {COUNTS} SELECT * FROM p")
def sales_event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_panel(spark, sf_dir).select("month_id", "flag_a", "flag_n", "flag_r", "total_sales_units")


@query("plot_frame", f"WITH {COUNTS} SELECT (month_id || '-01')::DATE AS month_dt, total_sales_units::DOUBLE AS sales, (flag_a + flag_n + flag_r)::DOUBLE AS intensity FROM p WHERE total_sales_units IS NOT NULL OR flag_a + flag_n + flag_r <> 0")
def plot_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.plot_frame(month_panel(spark, sf_dir))


LAGGED = f"WITH {COUNTS}, g AS (SELECT month_id, total_sales_units::DOUBLE AS y, (flag_a + flag_n + flag_r)::DOUBLE AS events_t FROM p), l AS (SELECT *, lag(events_t) OVER (ORDER BY month_id) AS events_t_minus_1, month_id[:4]::INTEGER AS year, month_id[6:7]::INTEGER AS month_num FROM g)"


@query("lag_features", f"{LAGGED} SELECT * FROM l")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lagged(month_panel(spark, sf_dir))


_MOMENTS = ["y", "events_t", "events_t_minus_1"]


@query(
    "lag_moments",
    " UNION ALL ".join(f"({LAGGED} SELECT '{a}*{b}' AS product, sum({a} * {b}) AS total FROM l WHERE y IS NOT NULL AND events_t_minus_1 IS NOT NULL)" for i, a in enumerate(_MOMENTS) for b in _MOMENTS[i:]),
)
def lag_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.moments(stats.complete(stats.lagged(month_panel(spark, sf_dir))), _MOMENTS)


@query("lag_model")
def lag_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lag_model(month_panel(spark, sf_dir))


_PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / greatest(count(*), 1), 2)::DOUBLE AS missing_pct, arg_min({c}, o_orderkey)::VARCHAR AS example_value FROM orders"
        for c, t in _PROFILED.items()
    ),
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return quality.profile(rows.select(*_PROFILED), "o_orderkey").select("column", "dtype", "missing_count", F.col("missing_pct").cast("double").alias("missing_pct"), "example_value")


@query(
    "quality_gate",
    f"""WITH {COUNTS}, k AS (SELECT month_id, month_id[:4]::INTEGER AS y, month_id[6:7]::INTEGER AS m, * EXCLUDE (month_id) FROM p)
SELECT 'monthly_event_counts' AS "table", 'unique_period' AS "check", count(*) = count(DISTINCT (y, m)) AS passed, count(*) - count(DISTINCT (y, m)) AS detail FROM k
UNION ALL SELECT 'monthly_event_counts', 'months', count(*) >= 12, count(*) FROM k
UNION ALL SELECT 'monthly_event_counts', 'numeric', count(*) FILTER (flag_a IS NULL OR flag_n IS NULL OR flag_r IS NULL) = 0, count(*) FILTER (flag_a IS NULL OR flag_n IS NULL OR flag_r IS NULL) FROM k
UNION ALL SELECT 'monthly_event_counts', 'not_negative', count(*) FILTER (least(flag_a, flag_n, flag_r) < 0) = 0, count(*) FILTER (least(flag_a, flag_n, flag_r) < 0) FROM k
UNION ALL SELECT 'panel', 'numeric', count(*) FILTER (flag_a IS NULL OR flag_n IS NULL OR flag_r IS NULL) = 0, count(*) FILTER (flag_a IS NULL OR flag_n IS NULL OR flag_r IS NULL) FROM k
UNION ALL SELECT 'panel', 'not_negative', count(*) FILTER (least(flag_a, flag_n, flag_r) < 0) = 0, count(*) FILTER (least(flag_a, flag_n, flag_r) < 0) FROM k
UNION ALL SELECT 'sales_headlines', 'unique_period', count(*) = count(DISTINCT (y, m)), count(*) - count(DISTINCT (y, m)) FROM k UNION ALL SELECT 'sales_headlines', 'missing_totals', true, count(*) FILTER (total_sales_units IS NULL) FROM k
UNION ALL SELECT 'sales_headlines', 'positive', count(*) FILTER (total_sales_units <= 0) = 0, count(*) FILTER (total_sales_units <= 0) FROM k UNION ALL SELECT 'sales_headlines', 'in_range', true, count(*) FILTER (total_sales_units NOT BETWEEN 10000 AND 200000) FROM k
UNION ALL SELECT 'panel', 'unique_month', count(*) = count(DISTINCT month_id), count(*) - count(DISTINCT month_id) FROM k
UNION ALL SELECT 'panel', 'month_agrees', count(*) FILTER (month_id[:7] <> y || '-' || lpad(m::VARCHAR, 2, '0')) = 0, count(*) FILTER (month_id[:7] <> y || '-' || lpad(m::VARCHAR, 2, '0')) FROM k UNION ALL SELECT 'panel', 'missing_sales', true, count(*) FILTER (total_sales_units IS NULL) FROM k""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = month_panel(spark, sf_dir).withColumn("period_year", times.year_of_month(F.col("month_id"))).withColumn("period_month", times.number_of_month(F.col("month_id")))
    flags = ["flag_a", "flag_n", "flag_r"]
    return reduce(DataFrame.unionByName, (quality.count_checks(keyed, flags), quality.sales_checks(keyed), quality.panel_checks(keyed)))


@query("documented_months", f"""WITH {COUNTS}, k AS (SELECT DISTINCT month_id FROM p WHERE total_sales_units IS NULL), d AS (SELECT DISTINCT month_id FROM p WHERE month_id LIKE '%-07')
SELECT 'panel' AS "table", 'undocumented' AS "check", count(*) = 0 AS passed, count(*) AS detail FROM k ANTI JOIN d USING (month_id) UNION ALL SELECT 'panel', 'not_missing', count(*) = 0, count(*) FROM d ANTI JOIN k USING (month_id)""")
def documented_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = month_panel(spark, sf_dir)
    return quality.documented_checks(rows, rows.where("month_id like '%-07'").select("month_id"))


@query("total_hits", f"WITH {SCORES} SELECT count(*) AS articles_kept, ({' + '.join(f'count(*) FILTER ({r.code} >= {r.min_score})' for r in ONTOLOGY.rules)})::BIGINT AS total_hits FROM sc")
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.total_hits(labeling.label_matrix(articles(spark, sf_dir), ONTOLOGY), ONTOLOGY.codes)


@query("duplicate_texts", "SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(parquet(spark, sf_dir, "documents"), ["text"])


@query("news_span", f"WITH {ARTICLES} SELECT count(DISTINCT source_id) AS sources, count(DISTINCT month_id) AS months, min(month_id) AS first_month, max(month_id) AS last_month FROM art")
def news_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("month_id").alias("months"), F.min("month_id").alias("first_month"), F.max("month_id").alias("last_month"))


@query(
    "url_routing",
    r"""SELECT page_id, 'com' AS source_id FROM pages WHERE url IS NOT NULL AND regexp_matches(url, '(?i)^https?://[^/]*\.com/') AND NOT contains(url, '/es/') AND NOT contains(url, 'utm_')
UNION ALL SELECT page_id, 'net' FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/]*\.net/') OR regexp_matches(url, '(?i)^HTTPS?://M\.') UNION ALL SELECT page_id, 'all' FROM pages WHERE NOT contains(url, '?') AND trim(url) <> ''""",
)
def url_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.route(parquet(spark, sf_dir, "pages"), RULES).select("page_id", "source_id")


UPLOADS = "u AS (SELECT page_id, 'https://x.example' || CASE WHEN page_id % 3 = 0 THEN '/files/' ELSE '/uploads/' || (2015 + page_id % 9) || '/' || lpad((1 + page_id % 12)::VARCHAR, 2, '0') || '/' END || 'sales report ' || page_id || CASE WHEN page_id % 2 = 0 THEN '.pdf?v=1' ELSE '' END AS pdf_url FROM pages)"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    place = F.when(k % 3 == 0, "/files/").otherwise(F.concat(F.lit("/uploads/"), (2015 + k % 9).cast("string"), F.lit("/"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("/")))
    url = F.concat(F.lit("https://x.example"), place, F.lit("sales report "), k.cast("string"), F.when(k % 2 == 0, ".pdf?v=1").otherwise(""))
    return parquet(spark, sf_dir, "pages").select("page_id", url.alias("pdf_url"))


@query(
    "upload_names",
    rf"""WITH {UPLOADS}, r AS (SELECT *, nullif(regexp_extract(pdf_url, '/uploads/(\d{{4}})/(\d{{2}})/', 1), '')::INTEGER AS y, nullif(regexp_extract(pdf_url, '/uploads/(\d{{4}})/(\d{{2}})/', 2), '')::INTEGER AS m, split_part(split_part(pdf_url, '/', -1), '?', 1) AS guess FROM u)
SELECT page_id, y AS year, m AS month, guess, coalesce(y || '_' || lpad(m::VARCHAR, 2, '0') || '_', '') || replace(guess, ' ', '_') || CASE WHEN guess LIKE '%.pdf' THEN '' ELSE '.pdf' END AS output_name, true AS is_pdf_link FROM r""",
)
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("pdf_url")
    year, month = links.upload_period(url)
    return uploads(spark, sf_dir).select("page_id", year.alias("year"), month.alias("month"), links.file_guess(url).alias("guess"), links.output_name(url).alias("output_name"), links.pdf_allowed(url, ["SALES report", r"\.pdf$"]).alias("is_pdf_link"))


@query("download_queue", rf"WITH {UPLOADS} SELECT page_id, pdf_url FROM u ORDER BY try_cast(regexp_extract(pdf_url, '/uploads/(\d{{4}})/', 1) AS INTEGER) DESC NULLS LAST, try_cast(regexp_extract(pdf_url, '/uploads/\d{{4}}/(\d{{2}})/', 1) AS INTEGER) DESC NULLS LAST, pdf_url LIMIT 40")
def download_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.download_queue(uploads(spark, sf_dir), 40).select("page_id", "pdf_url")


MANIFEST = "m AS (SELECT pdf_url, CASE page_id % 4 WHEN 1 THEN 'success' WHEN 2 THEN 'failed' ELSE 'skipped' END AS status FROM u WHERE page_id % 4 <> 0)"


@query("pending_downloads", f"WITH {UPLOADS}, {MANIFEST} SELECT page_id, pdf_url FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pdf_url = u.pdf_url AND m.status = 'success')")
def pending_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uploads(spark, sf_dir)
    state = F.when(F.col("page_id") % 4 == 1, "success").when(F.col("page_id") % 4 == 2, "failed").otherwise("skipped")
    return links.pending(rows, rows.where("page_id % 4 <> 0").withColumn("status", state)).select("page_id", "pdf_url")


@query("source_cap", f"WITH {ARTICLES} SELECT doc_id, source_id FROM art QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY day DESC, doc_id) <= 15")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.capped(articles(spark, sf_dir), "source_id", [F.desc("day"), F.col("doc_id")], 15).select("doc_id", "source_id")


@query("first_articles", f"WITH {ARTICLES} SELECT doc_id, source_id FROM art QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY source_id, doc_id) = 1")
def first_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumn("key", hashing.sha256(F.col("text")))
    return links.keep_first(rows, "key", [F.col("source_id"), F.col("doc_id")]).select("doc_id", "source_id")


@query("ordered_union", "WITH x AS (SELECT 0 AS part, user_id, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 1, user_id, event_id FROM events WHERE event_type <> 'click') SELECT user_id, event_id, part FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, event_id) = 1")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    click = F.col("event_type") == "click"
    return links.ordered_union([rows.where(click), rows.where(~click)], "user_id", "event_id").select("user_id", "event_id", "part")


@query(
    "source_own_caps",
    f"WITH {ARTICLES} SELECT doc_id, source_id FROM art QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY day DESC, doc_id) <= CASE WHEN source_id LIKE '%1' THEN 7 WHEN source_id LIKE '%2' THEN 11 ELSE 1000000000 END",
)
def source_own_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir)
    names = [r[0] for r in rows.select("source_id").distinct().collect()]  # sources are few
    caps = {s: 7 if s.endswith("1") else 11 for s in names if s and s[-1] in "12"}
    return links.capped_by_source(rows, caps, [F.desc("day"), F.col("doc_id")]).select("doc_id", "source_id")


@query(
    "files_already_there",
    rf"""WITH {UPLOADS}, r AS (SELECT pdf_url, coalesce(regexp_extract(pdf_url, '/uploads/(\d{{4}})/(\d{{2}})/', 1) || '_' || nullif(regexp_extract(pdf_url, '/uploads/(\d{{4}})/(\d{{2}})/', 2), '') || '_', '') || replace(split_part(split_part(pdf_url, '/', -1), '?', 1), ' ', '_') || CASE WHEN split_part(split_part(pdf_url, '/', -1), '?', 1) LIKE '%.pdf' THEN '' ELSE '.pdf' END AS name FROM u),
f AS (SELECT 'raw/sales_report_' || page_id || '.pdf' AS path, length(html) % 5 AS bytes FROM pages)
SELECT '2024-01-02T03:04:05Z' AS downloaded_at_utc, pdf_url, path AS saved_path, NULL::VARCHAR AS sha256, bytes::BIGINT AS bytes, NULL::INTEGER AS http_status, 'skipped' AS status, 'file_already_exists' AS error FROM r JOIN f ON f.path = 'raw/' || r.name WHERE bytes > 0""",
)
def files_already_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = parquet(spark, sf_dir, "pages").select(F.concat(F.lit("raw/sales_report_"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"), (F.length("html") % 5).alias("bytes"))
    return links.already_there(uploads(spark, sf_dir), files, "raw", F.lit("2024-01-02T03:04:05Z"))


@query("page_order", "WITH p AS (SELECT page_id AS page, min(page_id) OVER () AS lo, max(page_id) OVER () AS hi FROM pages) SELECT page, row_number() OVER (ORDER BY least(page - lo, hi - page), page) - 1 AS place FROM p")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_order(parquet(spark, sf_dir, "pages").select(F.col("page_id").alias("page"))).select("page", F.col("place").cast("bigint").alias("place"))


@query("admissible_articles", f"WITH {ARTICLES} SELECT doc_id FROM art WHERE length(text) >= 800 AND year(day) >= 2020 AND day BETWEEN DATE '2020-02-01' AND DATE '2024-06-30'")
def admissible_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.admissible(articles(spark, sf_dir).withColumn("published_ts", F.col("day").cast("timestamp")), 800, 2020, "2020-02-01", "2024-06-30").select("doc_id")


DATED = f"""{ARTICLES}, x AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'https://x/2024/02/31/a' WHEN doc_id % 7 < 4 THEN 'https://x/' || strftime(day, '%Y/%m/%d') || '/a' ELSE 'https://x/a-' || strftime(day, '%Y_%m-%d') END AS url,
coalesce(text, '') || CASE WHEN doc_id % 7 = 1 THEN ' on 31 Feb 2024' WHEN doc_id % 7 < 4 THEN ' posted ' || strftime(day, '%-d %B %Y') || ' by' ELSE ' at ' || strftime(day, '%Y/%m/%d') END AS said FROM art)"""
_NAMED, _PLAIN = r"(?i)\b([0-3]?\d)\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+((?:19|20)\d{2})\b", r"\b((?:19|20)\d{2})[-/](0[1-9]|1[0-2])[-/]([0-3]\d)\b"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with an address (url) and their whole text with a date behind it (said)."""
    k = F.col("doc_id") % 7
    url = F.when(k == 0, "https://x/2024/02/31/a").when(k < 4, F.concat(F.lit("https://x/"), F.date_format("day", "yyyy/MM/dd"), F.lit("/a"))).otherwise(F.concat(F.lit("https://x/a-"), F.date_format("day", "yyyy_MM-dd")))
    tail = F.when(k == 1, " on 31 Feb 2024").when(k < 4, F.concat(F.lit(" posted "), F.date_format("day", "d MMMM yyyy"), F.lit(" by"))).otherwise(F.concat(F.lit(" at "), F.date_format("day", "yyyy/MM/dd")))
    return articles(spark, sf_dir).select("doc_id", "day", url.alias("url"), F.concat(F.coalesce("text", F.lit("")), tail).alias("said"))


@query(
    "dates_found",
    rf"""WITH {DATED}, f AS (SELECT doc_id, day, CASE WHEN regexp_matches(url, '/20\d{{2}}/\d{{2}}/\d{{2}}/') THEN regexp_extract(url, '/(20\d{{2}}/\d{{2}}/\d{{2}})/', 1) ELSE replace(regexp_extract(url, '20\d{{2}}[-_]\d{{2}}[-_]\d{{2}}'), '_', '-') END AS u,
CASE WHEN regexp_matches(said, '{_NAMED}') THEN regexp_extract(said, '{_NAMED}', 3) || '-' || upper(regexp_extract(said, '{_NAMED}', 2)) || '-' || regexp_extract(said, '{_NAMED}', 1) ELSE regexp_extract(said, '{_PLAIN}', 1) || '-' || regexp_extract(said, '{_PLAIN}', 2) || '-' || regexp_extract(said, '{_PLAIN}', 3) END AS t FROM x)
SELECT doc_id, try_cast(replace(u, '/', '-') AS DATE) AS url_date, coalesce(try_strptime(t, '%Y-%b-%d'), try_strptime(t, '%Y-%m-%d'))::DATE AS text_date, strftime(day, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM f""",
)
def dates_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir).select("doc_id", times.date_in_url(F.col("url")).alias("url_date"), times.date_in_text(F.col("said")).alias("text_date"), times.iso_utc(F.col("day").cast("timestamp")).alias("iso"))


@query(
    "event_times",
    rf"""WITH {DATED}, f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN strftime(day, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS published, CASE WHEN doc_id % 3 = 1 THEN strftime(day, '%B %-d, %Y') ELSE 'soon' END AS raw, url, strftime(day + 3, '%Y-%m-%dT%H:%M:%SZ') AS fetched FROM x)
SELECT doc_id, coalesce(try_strptime(published, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(raw, '%B %-d, %Y'), try_strptime(regexp_extract(url, '/(20\d{{2}}/\d{{2}}/\d{{2}})/', 1), '%Y/%m/%d'),
CASE WHEN NOT regexp_matches(url, '/20\d{{2}}/\d{{2}}/\d{{2}}/') THEN try_strptime(replace(regexp_extract(url, '20\d{{2}}[-_]\d{{2}}[-_]\d{{2}}'), '_', '-'), '%Y-%m-%d') END, strptime(fetched, '%Y-%m-%dT%H:%M:%SZ')) AS event_time FROM f""",
)
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, iso = F.col("doc_id") % 3, lambda day: times.iso_utc(day.cast("timestamp"))
    published, raw = F.when(k == 0, iso(F.col("day"))).otherwise(""), F.when(k == 1, F.date_format("day", "MMMM d, yyyy")).otherwise("soon")
    when = times.event_time(published, raw, F.col("url"), iso(F.date_add("day", 3)))
    return dated(spark, sf_dir).select("doc_id", when.cast("timestamp_ntz").alias("event_time"))


PERIODS = f"""{ARTICLES}, x AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'Report-' || strftime(day, '%B-%Y') ELSE strftime(day, '%Y_04_x') END || '.pdf' AS name,
CASE doc_id % 4 WHEN 0 THEN 'for the  month of ' || strftime(day, '%B %Y') WHEN 1 THEN 'strong sales seen in all of ' || strftime(day, '%B %Y') WHEN 2 THEN 'rain of ' || strftime(day, '%B %Y') ELSE 'wet ' || strftime(day, '%B %Y') || ' and then dry March 2031 with sales' END || ' ' || coalesce(text, '') AS said FROM art)"""
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_ANY_MONTH = rf"(?i)\b({_MONTHS})\s+((?:19|20)\d{{2}})\b"


@query(
    "periods_found",
    rf"""WITH {PERIODS}, h AS (SELECT doc_id, name, trim(regexp_replace(said, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))[:16000] AS head FROM x),
f AS (SELECT *, CASE WHEN regexp_matches(head, '(?i)month of ({_MONTHS}) ((?:19|20)\d{{2}})') THEN regexp_extract(head, '(?i)month of ((?:{_MONTHS}) (?:19|20)\d{{2}})', 1)
WHEN regexp_matches(head, '(?i)\b({_MONTHS}) ((?:19|20)\d{{2}}) (?:new vehicle )?sales\b') THEN regexp_extract(head, '(?i)\b((?:{_MONTHS}) (?:19|20)\d{{2}}) (?:new vehicle )?sales\b', 1)
WHEN regexp_matches(head, '(?i)\bIn ({_MONTHS}) ((?:19|20)\d{{2}})\b') THEN regexp_extract(head, '(?i)\bIn ((?:{_MONTHS}) (?:19|20)\d{{2}})\b', 1)
WHEN contains(lower(head[greatest(strpos(head, regexp_extract(head, '{_ANY_MONTH}')) - 80, 1):strpos(head, regexp_extract(head, '{_ANY_MONTH}')) + length(regexp_extract(head, '{_ANY_MONTH}')) + 79]), 'sales') THEN regexp_extract(head, '{_ANY_MONTH}') END AS said FROM h)
SELECT doc_id, regexp_extract(name, '(?:19|20)\d{{2}}')::INTEGER AS file_year, CASE WHEN regexp_matches(name, '{_MONTHS}') THEN month(strptime(regexp_extract(name, '{_MONTHS}'), '%B')) ELSE regexp_extract(name, '^\d{{4}}_(\d\d)_', 1)::INTEGER END::INTEGER AS file_month,
year(try_strptime(said, '%B %Y'))::INTEGER AS text_year, month(try_strptime(said, '%B %Y'))::INTEGER AS text_month FROM f""",
)
def periods_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, month = F.col("doc_id"), F.date_format("day", "MMMM yyyy")
    name = F.concat(F.when(k % 2 == 0, F.concat(F.lit("Report-"), F.date_format("day", "MMMM-yyyy"))).otherwise(F.concat(F.date_format("day", "yyyy"), F.lit("_04_x"))), F.lit(".pdf"))
    said = F.when(k % 4 == 0, F.concat(F.lit("for the  month of "), month)).when(k % 4 == 1, F.concat(F.lit("strong sales seen in all of "), month)).when(k % 4 == 2, F.concat(F.lit("rain of "), month))
    said = F.concat_ws(" ", said.otherwise(F.concat(F.lit("wet "), month, F.lit(" and then dry March 2031 with sales"))), F.coalesce("text", F.lit("")))
    file_year, file_month = times.period_of_file(name)
    rows = times.with_period_of_text(articles(spark, sf_dir).withColumns({"name": name, "said": said}), "said")
    return rows.select("doc_id", file_year.alias("file_year"), file_month.alias("file_month"), "text_year", "text_month")


@query("link_harvest", """SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.harvested(parquet(spark, sf_dir, "pages")).select("page_id", "pos", "href")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with an author and a date in one of several places, or in none."""
    k = F.col("page_id")
    head = F.when(k % 4 == 0, F.concat(F.lit('<meta name="author" content=" Ann  Lee '), k.cast("string"), F.lit('"><meta name="date" content="2021-03-04">'))).when(k % 4 == 1, '<meta property="article:published_time" content="2020-02-30"><meta name="dc.date.issued" content="2020-05-06T07:08:09+02:00">').otherwise("")
    body = F.when(k % 4 == 2, F.concat(F.lit('<span class="big Post-Author-name">By '), k.cast("string"), F.lit("</span><time>5 May 2022</time>"))).otherwise("")
    html = F.replace(F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), head)), F.lit("<body>"), F.concat(F.lit("<body>"), body))
    return parquet(spark, sf_dir, "pages").withColumn("html", html)


MARKED = r"""h AS (SELECT page_id, url, replace(replace(html, '<head>', '<head>' || CASE page_id % 4 WHEN 0 THEN '<meta name="author" content=" Ann  Lee ' || page_id || '"><meta name="date" content="2021-03-04">'
WHEN 1 THEN '<meta property="article:published_time" content="2020-02-30"><meta name="dc.date.issued" content="2020-05-06T07:08:09+02:00">' ELSE '' END),
'<body>', '<body>' || CASE WHEN page_id % 4 = 2 THEN '<span class="big Post-Author-name">By ' || page_id || '</span><time>5 May 2022</time>' ELSE '' END) AS html FROM pages)"""


def _plain_sql(html: str) -> str:
    """Text between tags, with the references that the pages have."""
    bare = f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{char}')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


@query(
    "page_fields",
    rf"""WITH {MARKED}, f AS (SELECT page_id, {_plain_sql(PAGE_TITLE)} AS title, {_plain_sql("regexp_extract(html, '<article>(.*?)</article>', 1, 's')")} AS article, {_plain_sql("regexp_extract(html, '<body>(.*?)(?:</body>|$)', 1, 's')")} AS body,
coalesce(nullif(trim(regexp_replace(regexp_extract(html, '<meta name="author" content="([^"]*)"', 1), '\s+', ' ', 'g')), ''), trim(regexp_extract(html, '(?i)<[a-z]+ class="[^"]*author[^"]*">([^<]*)<', 1))) AS author,
coalesce(nullif(regexp_extract(html, '<meta property="article:published_time" content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<meta name="date" content="([^"]*)"', 1), ''), regexp_extract(html, '<time>([^<]*)<', 1)) AS raw FROM h)
SELECT page_id, title, author, raw AS published_raw, CASE WHEN length(article) >= 200 THEN article ELSE body END AS text, coalesce(strftime(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d %B %Y')), '%Y-%m-%dT%H:%M:%SZ'), '') AS published_at FROM f""",
)
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_fields(marked_pages(spark, sf_dir)).select("page_id", "title", "author", "published_raw", "text", "published_at")


@query(
    "page_links",
    rf"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1, 's') AS l, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2, 's') AS t FROM pages),
r AS (SELECT page_id, url, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS href, unnest(t) AS said FROM a)
SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || href END AS link_url, {_plain_sql("said")} AS link_text FROM r""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(parquet(spark, sf_dir, "pages")).select("page_id", "pos", "link_url", "link_text")


RELEASE = """r AS (SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'In March 2024 new vehicle sales totalled ' WHEN 3 THEN 'Total vehicle sales ' ELSE 'Industry  Total ' || CASE doc_id % 4 WHEN 2 THEN '9,999 and ' ELSE '' END END
|| (15 + (doc_id // 1000) % 45) || ',' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || CASE doc_id % 4 WHEN 3 THEN ' for the period' ELSE ' units.' END AS text FROM documents)"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, each with a sentence behind it that one of four ways of extraction finds."""
    k = F.col("doc_id")
    start = F.when(k % 4 == 0, "In March 2024 new vehicle sales totalled ").when(k % 4 == 1, "Industry  Total ").when(k % 4 == 2, "Industry  Total 9,999 and ").otherwise("Total vehicle sales ")
    number = F.concat((15 + F.floor(k / 1000) % 45).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), start, number, F.when(k % 4 == 3, " for the period").otherwise(" units."))
    return parquet(spark, sf_dir, "documents").select("doc_id", said.alias("text"), F.lit(None).cast("array<array<array<string>>>").alias("tables"), F.concat(F.lit("2024_03_"), k.cast("string"), F.lit(".pdf")).alias("file_name"))


@query(
    "industry_totals",
    rf"""WITH {RELEASE} SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_extract(text, 'Industry\s+Total\s+(.*)', 1, 's'), '\d{{1,3}}(?:,\d{{3}})+|\d+'), lambda x: replace(x, ',', '')::BIGINT), lambda x: x BETWEEN 10000 AND 160000)[1] AS total FROM r""",
)
def industry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases(spark, sf_dir).select("doc_id", extract.industry_total_native(F.col("text")).alias("total"))


@query(
    "release_totals",
    rf"""WITH {RELEASE}, f AS (SELECT doc_id, doc_id % 4 AS k, regexp_extract(text, '(?:totalled|Total|and|Total vehicle sales) (\d\d,\d{{3}}) ?(?:units\.|for the period)', 1) AS said FROM r)
SELECT doc_id, 2024 AS period_year, 3 AS period_month, replace(said, ',', '')::BIGINT AS total_sales_units, CASE k WHEN 0 THEN 'HEADLINE_REGEX' WHEN 3 THEN 'FALLBACK_SCAN' ELSE 'ANCHORED_INDUSTRY_TOTAL' END AS extraction_method,
CASE k WHEN 0 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS extraction_confidence, '' AS warning_flag FROM f""",
)
def release_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_totals(releases(spark, sf_dir)).select("doc_id", "period_year", "period_month", "total_sales_units", "extraction_method", "extraction_confidence", "warning_flag")


@query(
    "best_by_month",
    """WITH d AS (SELECT 2019 + doc_id % 5 AS y, 1 + (doc_id // 5) % 12 AS m, ['', 'FALLBACK_SCAN', 'ANCHORED_INDUSTRY_TOTAL', 'HEADLINE_REGEX'][doc_id % 4 + 1] AS method, ['low', 'medium', 'high'][doc_id % 3 + 1] AS confidence,
coalesce(text, '') AS evidence, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS total, 'path ' || lpad(doc_id::VARCHAR, 9, '0') AS path FROM documents)
SELECT y::INTEGER AS period_year, m::INTEGER AS period_month, path AS pdf_path FROM d QUALIFY row_number() OVER (PARTITION BY y, m ORDER BY CASE method WHEN 'HEADLINE_REGEX' THEN 3 WHEN 'ANCHORED_INDUSTRY_TOTAL' THEN 2 WHEN 'FALLBACK_SCAN' THEN 1 ELSE 0 END DESC,
CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, (contains(lower(evidence), 'units') OR contains(lower(evidence), 'vehicles'))::INTEGER + 2 * contains(lower(evidence), 'industry total')::INTEGER + 2 * contains(lower(evidence), 'new vehicle sales')::INTEGER
+ 2 * contains(lower(evidence), 'aggregate new vehicle sales')::INTEGER + 2 * contains(lower(evidence), 'total reported industry sales')::INTEGER + 2 * contains(lower(evidence), 'total vehicle sales')::INTEGER + 2 * contains(lower(evidence), 'domestic new vehicle sales')::INTEGER DESC, total IS NOT NULL DESC, path) = 1""",
)
def best_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    methods, confidences = F.array(*map(F.lit, ("", "FALLBACK_SCAN", "ANCHORED_INDUSTRY_TOTAL", "HEADLINE_REGEX"))), F.array(*map(F.lit, ("low", "medium", "high")))
    rows = parquet(spark, sf_dir, "documents").select(
        (2019 + k % 5).cast("int").alias("period_year"), (1 + F.floor(k / 5) % 12).cast("int").alias("period_month"), F.get(methods, (k % 4).cast("int")).alias("extraction_method"), F.get(confidences, (k % 3).cast("int")).alias("extraction_confidence"),
        F.col("text").alias("evidence_window"), F.when(k % 11 != 0, F.col("n_chars")).alias("total_sales_units"), F.concat(F.lit("path "), F.lpad(k.cast("string"), 9, "0")).alias("pdf_path"),
    )
    return panel.best_by_month(rows).select("period_year", "period_month", "pdf_path")


@query(
    "scalar_texts",
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal, strlen(text)::BIGINT AS bytes, trim(text[greatest(91 - 40, 1):110 + 40]) AS around, (15000 + doc_id)::BIGINT AS number FROM documents""",
)
def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat((F.lit(15) + F.floor(F.col("doc_id") / 1000)).cast("string"), F.lit(","), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
    return parquet(spark, sf_dir, "documents").select(
        "doc_id", text.collapse(F.col("text")).alias("normal"), F.octet_length("text").cast("bigint").alias("bytes"), text.context(F.col("text"), F.lit(90), F.lit(110), 40).alias("around"), text.whole_number(spaced).alias("number")
    )


@query(
    "whole_texts",
    r"""WITH n AS (SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), 'ΓÇô', '-'), 'ΓÇÖ', ''''), 'ΓÇ£', '"'), 'ΓÇ¥', '"') AS text FROM documents)
SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r\x{85}\p{Z}]+', ' ', 'g')) AS normal FROM n""",
)
def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts, repairs included."""
    return parquet(spark, sf_dir, "documents").select("doc_id", text.collapse(F.col("text")).alias("normal"))


@query("set_equality", f"WITH {COUNTS} SELECT 0::BIGINT AS only_left, (SELECT count(*) FROM p WHERE total_sales_units IS NULL)::BIGINT AS only_right")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = month_panel(spark, sf_dir)
    return quality.same_set(rows.where("total_sales_units is not null").select("month_id"), rows.select("month_id"))


@query("event_day_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.day_counts(parquet(spark, sf_dir, "events")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
