"""URL filters, routing, crawl planning and download planning."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.text import pdf_name, usable


@dataclass(frozen=True)
class SourceRule:
    source_id: str
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    kind: str = "news_site"
    discovery_only: bool = False


def any_of(conditions: list[Column], none: bool) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(none)


def allowed(url: Column, rule: SourceRule) -> Column:
    """No deny substring (by case) and some allow pattern (any case); without allow patterns all pass, blank never."""
    u = F.coalesce(url, F.lit(""))
    denied = any_of([u.contains(d) for d in rule.deny], False)
    fits = any_of([u.rlike(f"(?iu){p}") for p in rule.allow if usable(p)], not rule.allow)
    return (F.trim(u) != "") & ~denied & fits


def route(urls: DataFrame, rules: list[SourceRule], url_col: str = "url") -> DataFrame:
    """A row for every rule that accepts a URL; rules are unrolled into one projection, so nothing is joined."""
    rules = [r for r in rules if r.kind in ("news_site", "rss_feed") and not r.discovery_only]
    hits = F.array(*[F.when(allowed(F.col(url_col), r), F.lit(r.source_id)) for r in rules])
    return urls.withColumn("source_id", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def pdf_allowed(url: Column, patterns: list[str]) -> Column:
    return any_of([F.coalesce(url, F.lit("")).rlike(f"(?iu){p}") for p in patterns if usable(p)], False)


def upload_period(url: Column) -> tuple[Column, Column]:
    of = lambda k: F.nullif(F.regexp_extract(url, r"/uploads/(\d{4})/(\d{2})/", k), F.lit("")).try_cast("int")
    return of(1), of(2)


def file_guess(url: Column) -> Column:
    return F.get(F.split(F.element_at(F.split(url, "/"), -1), r"\?"), F.lit(0))


def output_name(url: Column) -> Column:
    """The file guess as a safe PDF name, after YYYY_MM_ if the URL tells."""
    year, month = upload_period(url)
    return F.concat(F.coalesce(F.concat(year.cast("string"), F.lit("_"), F.lpad(month.cast("string"), 2, "0"), F.lit("_")), F.lit("")), pdf_name(file_guess(url)))


def page_order(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """Pages with their place in the order first, last, second, second last, ..."""
    bounds = pages.agg(F.min(page_col).alias("lo"), F.max(page_col).alias("hi"))
    from_end, from_start = F.col("hi") - F.col(page_col), F.col(page_col) - F.col("lo")
    place = F.when(from_start <= from_end, 2 * from_start).otherwise(2 * from_end + 1)
    return pages.crossJoin(F.broadcast(bounds)).withColumn("place", place).drop("lo", "hi")  # one row of bounds


def highest_page(probes: DataFrame) -> DataFrame:
    return probes.where("status = 200 and length(body) > 0").agg(F.max("page").alias("page"))


def pending(links: DataFrame, manifest: DataFrame, key: str = "pdf_url") -> DataFrame:
    """Links without a successful download."""
    return links.join(manifest.where("status = 'success'").select(key).distinct(), key, "left_anti")


def download_queue(links: DataFrame, most: int, url_col: str = "pdf_url") -> DataFrame:
    """The newest uploads first, undated ones last, ties by URL; the first `most`."""
    year, month = upload_period(F.col(url_col))
    dated = links.withColumn("year", year).withColumn("month", month)
    return dated.orderBy(F.col("year").desc_nulls_last(), F.col("month").desc_nulls_last(), F.col(url_col).asc_nulls_last()).limit(most)


def capped(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def keep_first(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return capped(rows, key, order, 1)


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """UNION DISTINCT that keeps each key's first row: earlier parts first, then by order."""
    ranked = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    return keep_first(reduce(DataFrame.unionByName, ranked), key, [F.col("part"), F.col(order)])


def harvested(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """href of every link with its position, by pattern."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("*", F.posexplode(found).alias("pos", "href"))


def next_link(links: DataFrame, page_key: str) -> DataFrame:
    """The first link of each page whose text leads on."""
    text = F.lower(F.trim("text"))
    return links.where(text.isin("next", "older", "next page") | text.contains("next")).groupBy(page_key).agg(F.min_by("url", "pos").alias("url"))


def already_there(queue: DataFrame, files: DataFrame, folder: str, now: Column) -> DataFrame:
    """Log rows, as of a download manifest, for links whose output file is there (files: path, bytes) and not empty."""
    own = queue.withColumn("saved_path", F.concat(F.lit(folder.rstrip("/") + "/"), output_name(F.col("pdf_url"))))
    found = own.join(files.where("bytes > 0").select(F.col("path").alias("saved_path"), "bytes"), "saved_path")
    null = lambda kind: F.lit(None).cast(kind)
    return found.select(
        now.alias("downloaded_at_utc"), "pdf_url", "saved_path", null("string").alias("sha256"), F.col("bytes").cast("bigint").alias("bytes"), null("int").alias("http_status"), F.lit("skipped").alias("status"), F.lit("file_already_exists").alias("error")
    )


def capped_by_source(urls: DataFrame, caps: dict[str, int], order: list[Column]) -> DataFrame:
    """The first URLs of each source, up to the source's own cap; sources without one keep all."""
    most = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]) if caps else F.lit(None).cast("map<string,int>")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    kept = F.col("place") <= F.coalesce(F.try_element_at(most, F.col("source_id")), F.lit(2**31 - 1))
    return urls.withColumn("place", place).where(kept).drop("place")
