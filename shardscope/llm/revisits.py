"""WARC revisits: a not-modified record gets the latest earlier full response of its canonical URL.

The as-of join is cut into time ranges, more of them the more records there are, so that a URL with a third of all records is no single task: within (URL, range) a
window carries the last response; a window over the occupied ranges of a URL, one row each, carries it into the next of them. A revisit is checked against the response it met by its validators, and the
headers that a 304 may change are merged into the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardscope.llm.common import table, written

#: Headers that a not-modified response may bring up to date (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name another page (fixed values).
TRACKING = "^(utm_[^=]*|fbclid|gclid|ref)(=|$)"
#: Time ranges at least, and records for which there is another one.
RANGES, RANGE_RECORDS = 64, 100_000


def canonical_url(url: Column) -> Column:
    """host/path?query in one spelling: without scheme, user, www., default port, fragment, closing slash and tracking parameters; lower-case host, sorted parameters.

    A text that is no absolute URL is trimmed only; null stays null.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(?:[?](.*))?$"
    host = F.lower(F.regexp_extract(plain, pattern, 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, pattern, 2), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(plain, pattern, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.concat_ws("&", F.array_sort(query))
    joined = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(plain.rlike(pattern), joined).otherwise(plain)


def _named(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only, the first in order of spelling counts. Null is none."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def _tag(headers: str) -> Column:
    return F.regexp_replace(F.trim(F.col(headers)["etag"]), "^W/", "")


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """record_id, canonical, outcome, response_id, headers of every revisit.

    ``records``: record_id, url, at (time), revisit (boolean), headers (map), digest. A response counts for revisits at its own time too; of
    responses at one time the larger record_id does. Entity tags decide where both have one, else dates of modification, else digests:
    outcome is resolved, changed (they differ), unchecked (no validator in common) or missing (no earlier response); only resolved and unchecked revisits
    get headers. Repeated revisits are answered each. Records without URL, time or revisit flag take no part as responses, and as revisits are missing. An empty table gives no rows.
    The result does not depend on ``ranges``.
    """
    rows = written(
        records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "at", "revisit", _named(F.col("headers")).alias("headers"), "digest"), "records"
    )
    usable = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    span = rows.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).first()
    ranges = ranges or max(RANGES, span["n"] // RANGE_RECORDS)
    low, width = span["low"] or 0, max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // ranges))
    dealt = rows.where(usable & F.col("revisit").isNotNull()).withColumn("range", F.floor((F.col("at") - low) / width))
    response = F.when(~F.col("revisit"), F.struct("at", "record_id"))
    order = Window.partitionBy("canonical", "range").orderBy("at", F.col("revisit").cast("int"), "record_id")
    here = F.last(response, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    asked = dealt.withColumn("here", here).where("revisit").select("record_id", "canonical", "range", "headers", "digest", "here")
    last = dealt.groupBy("canonical", "range").agg(F.max(F.when(~F.col("revisit"), F.struct("at", "record_id"))).alias("last"))
    # the last response of the occupied ranges before
    earlier = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("last", F.last("last", ignorenulls=True).over(earlier)).where("last IS NOT NULL")
    met = asked.join(carried, ["canonical", "range"], "left").withColumn("response_id", F.coalesce("here.record_id", "last.record_id"))
    # of responses that repeat a record_id one stands for all, the first by its headers
    one = F.min(F.struct(F.array_sort(F.map_entries("headers")).alias("headers"), "digest")).alias("full")
    full = rows.where(~F.col("revisit")).groupBy(F.col("record_id").alias("response_id")).agg(one)
    met = met.join(full, "response_id", "left").withColumns({"old": F.map_from_entries("full.headers"), "old_digest": F.col("full.digest")})
    tags, dates = _tag("headers") == _tag("old"), F.trim(F.col("headers")["last-modified"]) == F.trim(F.col("old")["last-modified"])
    same = F.coalesce(tags, dates, F.col("digest") == F.col("old_digest"))
    outcome = F.when(F.col("response_id").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    found = met.withColumn("outcome", outcome).select(
        "record_id", "canonical", "outcome", F.when(F.col("outcome") != "missing", F.col("response_id")).alias("response_id"),
        F.when(F.col("outcome").isin("resolved", "unchecked"), merged).alias("headers"),
    )
    lost = rows.where(F.col("revisit") & ~usable).select("record_id", "canonical", F.lit("missing").alias("outcome"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers"))
    return found.unionByName(lost)


#: How long after its page the crawl asks again, in pages.
AGAIN = 5000


def crawl(pages: DataFrame) -> DataFrame:
    """Every page as a full response, and a later request for it that was answered not modified.

    Requests carry the tag of the page or its date (every third); some of their headers may not change a stored response. Where another page of the same
    canonical URL came in between, the validators disagree.
    """
    html = F.coalesce("html", F.lit(""))
    tag, date = F.concat(F.lit('"'), F.md5(html), F.lit('"')), F.concat(F.lit("t"), F.col("page_id").cast("string"))
    full = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Length"), F.octet_length(html).cast("string"), F.lit("Cache-Control"), F.lit("no-cache"))
    dated = F.create_map(F.lit("Last-Modified"), date, F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), F.concat(F.lit("x"), F.col("page_id").cast("string")))
    tagged = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"))
    response = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit(False).alias("revisit"), full.alias("headers"), F.sha2(html, 256).alias("digest")
    )
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (F.col("page_id") + AGAIN).alias("at"), F.lit(True).alias("revisit"),
        F.when(F.col("page_id") % 3 == 0, dated).otherwise(tagged).alias("headers"), F.sha2(html, 256).alias("digest"),
    )
    return response.unionByName(revisit)


SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '') AS p,
    '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(?:[?](.*))?$' AS rx FROM pages
), q AS (
  SELECT page_id, html, p, regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(?:[?](.*))?$') AS ok,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(?:[?](.*))?$', 1)), '^.*@', ''), '^www[.]', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(?:[?](.*))?$', 2), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(?:[?](.*))?$', 3), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))), '&') AS args FROM u
), c AS (
  SELECT page_id, html, CASE WHEN ok THEN base || CASE WHEN args <> '' THEN '?' || args ELSE '' END ELSE p END AS canonical FROM q
), m AS (
  SELECT r.page_id, r.canonical, r.html, f.page_id AS f_id, f.html AS f_html
  FROM c r ASOF LEFT JOIN c f ON r.canonical = f.canonical AND r.page_id + 5000 >= f.page_id
), o AS (
  SELECT *, CASE WHEN f_id IS NULL THEN 'missing' WHEN page_id % 3 = 0 THEN CASE WHEN page_id = f_id THEN 'resolved' ELSE 'changed' END
    WHEN md5(html) = md5(f_html) THEN 'resolved' ELSE 'changed' END AS outcome FROM m
)
SELECT 2 * page_id + 1 AS record_id, canonical, outcome, 2 * f_id AS response_id,
  CASE WHEN outcome <> 'resolved' THEN NULL WHEN page_id % 3 = 0 THEN
    'cache-control: no-cache|content-length: ' || octet_length(encode(f_html)) || '|etag: "' || md5(f_html) || '"|expires: x' || page_id || '|last-modified: t' || page_id
  ELSE 'cache-control: max-age=60|content-length: ' || octet_length(encode(f_html)) || '|etag: W/"' || md5(html) || '"|last-modified: t' || f_id END AS headers
FROM o
"""


def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Per revisit: record_id, canonical, outcome, response_id and the merged headers as text."""
    found = resolve(crawl(table(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(lines, "|")))
