"""Not-modified revisits: each is resolved to the latest earlier full response of its canonical URL.

The as-of join runs in two levels, so that a URL with very many captures is split: a window within (URL, span of
time), and the last response of each (URL, span) carried to the next spans. Payloads stay out of it and are joined
by record at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans of time that captures are cut into.
SPANS = 64
#: Query parameters that do not name a resource; header fields that a not-modified answer may renew.
TRACKING = "^(?:utm_[a-z]+|gclid|fbclid)(?:=|$)"
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path, sorted query without tracking; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.btrim(url), "#[^\\n]*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, "[?]([^\\n]*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def header(headers: Column, name: str) -> Column:
    """First value of a header field, whatever its case."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: (F.lower(k) == name) & v.isNotNull())), F.lit(0))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored header fields, with the permitted ones of the revisit in their place."""
    stored, fresh = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (stored, fresh))
    renewed = F.map_filter(fresh, lambda k, _: F.lower(k).isin(*RENEWED))
    names = F.transform(F.map_keys(renewed), F.lower)
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(names, F.lower(k))), renewed)


def agrees(revisit: Column, response: Column) -> Column:
    """Whether the first validator that both have is the same: entity tag, date of change, digest; NULL without one."""
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags = weak(header(revisit["headers"], "etag")) == weak(header(response["headers"], "etag"))
    dates = header(revisit["headers"], "last-modified") == header(response["headers"], "last-modified")
    return F.coalesce(tags, dates, revisit["digest"] == response["digest"])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, captured_at, kind, headers, digest, payload).

    ``kind`` is 'response' or 'revisit'; other kinds take no part. Result: record_id, url, canonical_url, source_id,
    status, headers, payload. Status: 'resolved' (a validator agrees; headers merged, payload of the response),
    'mismatch' (it disagrees), 'unchecked' (no common validator), 'orphan' (no earlier response; NULL or empty URLs and
    NULL times are orphans). Earlier means a smaller captured_at; among equal times the larger record_id is later.
    Repeated rows are resolved each; NULL headers are empty; an empty table gives no rows; other columns are ignored.
    """
    spark = records.sparkSession
    base = records.select("record_id", "url", "captured_at", "kind", "headers", "digest").where(F.col("kind").isin("response", "revisit")).withColumn("canonical_url", canonical(F.col("url")))
    can = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    timed = base.where(can)
    bounds = timed.agg(F.percentile_approx(F.col("captured_at").cast("double"), [i / SPANS for i in range(1, SPANS)], 1000)).first()[0] or []
    levels = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]).cast("array<double>")
    timed = timed.withColumn("span", F.size(F.filter(levels, lambda b: b <= F.col("captured_at").cast("double"))))
    response = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id", "headers", "digest"))
    order = [F.col("captured_at"), F.col("kind").desc(), F.col("record_id")]
    within = timed.withColumn("found", F.last(response, ignorenulls=True).over(Window.partitionBy("canonical_url", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = timed.groupBy("canonical_url", "span").agg(F.max_by(response, F.when(F.col("kind") == "response", F.struct("captured_at", "record_id"))).alias("end"))
    carried = ends.select("canonical_url", "span", F.last("end", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    placed = within.where("kind = 'revisit'").join(carried, ["canonical_url", "span"], "left").withColumn("source", F.coalesce("found", "carried")).drop("span", "found", "carried")
    lost = base.where(~can & (F.col("kind") == "revisit")).withColumn("source", F.lit(None).cast(placed.schema["source"].dataType))
    every = placed.unionByName(lost)
    agreed = agrees(F.struct("headers", "digest"), F.col("source"))
    status = F.when(F.col("source").isNull(), "orphan").when(agreed, "resolved").when(~agreed, "mismatch").otherwise("unchecked")
    judged = every.withColumn("status", status).withColumn("headers", F.when(F.col("status") == "resolved", merged(F.col("source.headers"), F.col("headers"))).otherwise(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    judged = judged.select("record_id", "url", "canonical_url", F.col("source.record_id").alias("source_id"), F.col("source.captured_at").alias("source_at"), "status", "headers")
    bodies = records.where("kind = 'response'").groupBy(F.col("record_id").alias("source_id"), F.col("captured_at").alias("source_at")).agg(F.first("payload").alias("payload"))
    out = judged.where("status = 'resolved'").join(bodies, ["source_id", "source_at"], "left").unionByName(judged.where("status <> 'resolved'").withColumn("payload", F.lit(None).cast(records.schema["payload"].dataType)))
    return out.select("record_id", "url", "canonical_url", "source_id", "status", "headers", "payload")


def page_records(pages: DataFrame) -> DataFrame:
    """Every page as a full response at second ``page_id``, and as a revisit 1000 seconds later that carries its tag."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    response = pages.select(F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("captured_at"), F.lit("response").alias("kind"), F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"), tag.alias("digest"), F.col("html").alias("payload"))
    revisit = pages.select(F.col("page_id").alias("record_id"), "url", (F.col("page_id") + 1000).alias("captured_at"), F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), (F.col("page_id") + 1000).cast("string"), F.lit("X-Cache"), F.lit("hit")).alias("headers"), tag.alias("digest"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


def digest(resolved: DataFrame) -> DataFrame:
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return resolved.select(F.col("record_id").alias("page_id"), "canonical_url", "source_id", "status", F.array_join(fields, ";").alias("headers"), F.md5("payload").alias("payload_md5"))


SQL = r"""
WITH c AS (
    SELECT page_id, html, md5(coalesce(html, '')) AS tag,
        regexp_replace(regexp_replace(trim(url), '#[^\n]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
p AS (
    SELECT page_id, html, tag, rest,
        regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '') AS host,
        regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?]([^\n]*)$', 1), '&'),
            lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid)(?:=|$)'))), '&') AS q FROM c),
u AS (
    SELECT page_id, html, tag, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
        || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical_url FROM p),
j AS (
    SELECT r.page_id, r.canonical_url, r.tag, max(s.page_id) AS source_id
    FROM u r LEFT JOIN u s ON s.canonical_url = r.canonical_url AND s.page_id < r.page_id + 1000 GROUP BY ALL)
SELECT j.page_id, j.canonical_url, j.source_id,
    CASE WHEN j.source_id IS NULL THEN 'orphan' WHEN s.tag = j.tag THEN 'resolved' ELSE 'mismatch' END AS status,
    CASE WHEN s.tag = j.tag THEN 'Content-Type=text/html;date=' || (j.page_id + 1000) || ';etag=W/' || j.tag
        ELSE 'X-Cache=hit;date=' || (j.page_id + 1000) || ';etag=W/' || j.tag END AS headers,
    CASE WHEN s.tag = j.tag THEN md5(s.html) END AS payload_md5
FROM j LEFT JOIN u s ON s.page_id = j.source_id
"""
