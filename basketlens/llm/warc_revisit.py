"""WARC not-modified revisits: as-of join to the latest earlier full response of the canonical URL.

A revisit record (304) has no payload.  It is resolved against the latest
earlier response of the same canonical URL: validators are compared, and the
headers that a 304 may update are merged over those of the response.  The
as-of join is two-level, so that one very common URL is not one task: the last
response of each (URL, time bucket) is pre-aggregated, a window over those few
rows carries it into later buckets, and a window inside (URL, bucket) does the
rest.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import stage

#: Headers that a 304 response may carry to update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not choose content.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
BUCKET = 4096


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default ports, fragment, tracking parameters, final slash and letter case of the host removed."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?")
    return F.concat(host, F.regexp_replace(rest, r"[?&/]+$", ""))


def _strong(etag: Column) -> Column:
    """ETag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per record with a non-null id, URL and time; null or other types count as responses.

    ``records``: record_id, url, captured (long), type ("response" or
    "revisit"), etag, last_modified, headers (map), payload_digest.  Output:
    record_id, canonical_url, captured, type, status, refers_to, payload_digest,
    headers.  Status: ``full`` (a response), ``resolved``,
    ``validator_mismatch``, ``unvalidated`` (no validator on both sides) or
    ``unresolved`` (no earlier response).  Only resolved revisits take payload
    and headers over.  Records of one time are ordered by id; "earlier" is by
    (captured, record_id).  A revisit with null headers adds none.
    """
    r = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("captured").cast("long").alias("captured"),
        F.when(F.col("type") == "revisit", "revisit").otherwise("response").alias("type"), "etag", "last_modified",
        F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("headers"), "payload_digest",
    ).where("record_id is not null and canonical_url is not null and captured is not null")
    # read three times below: the payloads that digests are made of are read once
    r = stage(r.withColumn("bucket", F.floor(F.col("captured") / bucket)), "records")
    full = F.when(F.col("type") == "response", F.struct(
        "captured", "record_id", "etag", "last_modified", "payload_digest", F.map_entries("headers").alias("headers")))
    last = r.where("type = 'response'").groupBy("canonical_url", "bucket").agg(
        F.max_by(full, F.struct("captured", "record_id")).alias("last"))
    # buckets of the URL that have any record, so that the carry reaches each of them
    cells = r.select("canonical_url", "bucket").distinct().join(last, ["canonical_url", "bucket"], "left")
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select("canonical_url", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("captured", "record_id").rowsBetween(
        Window.unboundedPreceding, -1)
    j = r.withColumn("near", F.last(full, ignorenulls=True).over(inside)).join(carry, ["canonical_url", "bucket"])
    j = j.withColumn("ref", F.coalesce("near", "carry"))
    same = F.when(F.col("etag").isNotNull() & F.col("ref.etag").isNotNull(), _strong(F.col("etag")) == _strong(F.col("ref.etag"))
                  ).when(F.col("last_modified").isNotNull() & F.col("ref.last_modified").isNotNull(),
                         F.col("last_modified") == F.col("ref.last_modified"))
    status = (F.when(F.col("type") == "response", "full").when(F.col("ref").isNull(), "unresolved")
              .when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("validator_mismatch"))
    j = j.withColumn("status", status)
    update = F.map_filter("headers", lambda k, v: F.lower(k).isin(*PERMITTED))
    stored = F.map_from_entries("ref.headers")
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.transform(F.map_keys(update), F.lower), F.lower(k)))
    resolved = F.col("status") == "resolved"
    return j.select(
        "record_id", "canonical_url", "captured", "type", "status",
        F.when(resolved | (F.col("status") == "validator_mismatch") | (F.col("status") == "unvalidated"),
               F.col("ref.record_id")).alias("refers_to"),
        F.when(resolved, F.col("ref.payload_digest")).when(F.col("type") == "response", F.col("payload_digest")).alias("payload_digest"),
        F.when(resolved, F.map_concat(kept, update)).otherwise(F.col("headers")).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """WARC-like records of a crawl of ``pages`` (page_id is the time of capture).

    Each page is a response, and its section's front page is asked for at the
    same time: every fifth time in full, else as a revisit.  The front page's
    ETag changes every fifty captures; some revisits have Last-Modified only,
    some no validator.
    """
    p = pages.where("page_id is not null and url is not null").select(
        "page_id", "url", F.md5("html").alias("digest"), F.length("html").cast("string").alias("size"))
    own = F.struct(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured"), F.lit("response").alias("type"),
        F.col("digest").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("digest")).alias("headers"),
        F.col("digest").alias("payload_digest"))
    version = F.floor(F.col("page_id") / 50).cast("string")
    kind = F.when(F.col("page_id") % 5 == 0, "response").otherwise("revisit")
    etag = F.when(F.col("page_id") % 11 < 9, F.concat(F.when(F.col("page_id") % 2 == 0, "W/").otherwise(""), F.lit('"v'), version, F.lit('"')))
    front = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_extract("url", r"^[^:]+://[^/?#]+(/[a-z]{2})?", 0).alias("url"),
        F.col("page_id").alias("captured"), kind.alias("type"), etag.alias("etag"),
        F.when(F.col("page_id") % 11 < 10, F.concat(F.lit("day "), version)).alias("last_modified"),
        F.create_map(F.lit("Date"), F.col("page_id").cast("string"), F.lit("content-length"), F.col("size"),
                     F.lit("Server"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string"))).alias("headers"),
        F.when(F.col("page_id") % 5 == 0, F.col("digest")).alias("payload_digest"))
    return p.select(F.inline(F.array(own, front)))


def headers_text(headers: Column) -> Column:
    """``name=value`` in ascending order of names, joined by ";"."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
