"""Not-modified records resolved to the response they stand for.

Each revisit is joined, as of its time, to the latest earlier full response of the same
canonical URL. Its validators are checked against that response: the entity tag if it has
one (compared weakly), else the time of last change. A match takes the response's payload
and headers, with the header fields that a not-modified answer may bring merged over them.

The as-of join runs on the distinct (URL, time) points without payloads. Points are cut
into ranges of time, so that one URL with a great share of all records is many bounded
windows; the last response of earlier ranges is carried in from one row for each URL and
range.

Outcomes: ``resolved``, ``validator_mismatch``, ``no_response`` (no earlier one, or a null
URL or time). A revisit without validators takes the latest response as it is. Of several
responses at one time the largest ``record_id`` counts. Responses at the revisit's own time
are not earlier. Repeated revisits each get their row; an empty table gives an empty result.
Extra columns are ignored. A null header map is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The fields that a 304 answer carries for the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Points of a range of time, about.
RANGE_POINTS = 100_000


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment and a last slash do not tell pages apart; parameters are sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&")), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _last(column: str, window: Window) -> Column:
    return F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))


def as_of(points: DataFrame) -> DataFrame:
    """``points`` (url, ts, response or null; one row each) with ``latest``: the last response at an earlier time."""
    ranges = max(1, -(-points.count() // RANGE_POINTS))
    cuts = points.agg(F.percentile_approx("ts", [k / ranges for k in range(1, ranges)] or [0.5], 10_000)).first()[0]
    cuts = sorted(set(cuts or [])) if ranges > 1 else []
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    points = points.withColumn("range", F.size(F.filter(bounds, lambda b: b <= F.col("ts"))))
    inside = points.withColumn("near", _last("response", Window.partitionBy("url", "range").orderBy("ts")))
    ends = (points.where("response IS NOT NULL").groupBy("url", "range").agg(F.max_by("response", "ts").alias("response")))
    every = points.select("url", "range").distinct().join(ends, ["url", "range"], "left")
    carried = every.select("url", "range", _last("response", Window.partitionBy("url").orderBy("range")).alias("before"))
    return inside.join(carried, ["url", "range"]).select("url", "ts", F.coalesce("near", "before").alias("latest"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit with its outcome, the response it stands for and the merged headers.

    ``records``: record_id, url, ts (bigint), kind (``response`` or ``revisit``), status,
    etag, last_modified, headers (map of lower-case names), digest of the payload.
    """
    narrow = records.select("record_id", canonical_url(F.col("url")).alias("url"), "ts", "kind", "status", "etag",
                            "last_modified", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
                            "digest")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    response = F.struct("record_id", "etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("headers"))
    asked = narrow.where((F.col("kind") == "revisit") | full).where("url IS NOT NULL AND ts IS NOT NULL")
    points = asked.groupBy("url", "ts").agg(F.max(F.when(full, response)).alias("response"))
    revisits = narrow.where("kind = 'revisit'")
    joined = revisits.join(as_of(points), ["url", "ts"], "left")

    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    latest = F.col("latest")
    agrees = (F.when(F.col("etag").isNotNull(), F.coalesce(weak(F.col("etag")) == weak(latest["etag"]), F.lit(False)))
              .when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == latest["last_modified"], F.lit(False)))
              .otherwise(True))
    outcome = F.when(latest.isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    brought = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    stored = F.map_filter(F.map_from_entries(latest["headers"]), lambda k, v: ~F.map_contains_key(brought, k))
    merged = F.map_concat(stored, brought)
    done = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "ts", "outcome", latest["record_id"].alias("response_id"),
        F.when(done, latest["digest"]).alias("digest"), F.when(done, merged).alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the payload of their response."""
    stored = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "payload")
    return resolved.where("outcome = 'resolved'").join(stored, "response_id")


def header_lines(headers: Column) -> Column:
    """A header map as lines in the order of the names."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Two crawl records for each page of ``pages``: its response, and a later or earlier not-modified answer."""
    turn = F.pmod(F.col("page_id") * 7919, F.lit(1_000_003))
    tag, stamp = F.concat(F.lit('"'), F.md5(F.encode("html", "UTF-8")), F.lit('"')), (turn - 500).cast("string")
    size = F.octet_length("html").cast("string")
    common = lambda *more: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in more))
    base = pages.select("page_id", "url", "html", turn.alias("turn"), tag.alias("tag"), stamp.alias("stamp"), size.alias("size"))
    response = base.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"), "url", F.col("turn").alias("ts"),
        F.lit("response").alias("kind"), F.lit(200).alias("status"), F.col("tag").alias("etag"), F.col("stamp").alias("last_modified"),
        common("content-type", "text/html", "content-length", F.col("size"), "date", F.col("turn").cast("string"),
               "etag", F.col("tag")).alias("headers"), F.md5(F.encode("html", "UTF-8")).alias("digest"), F.col("html").alias("payload"))
    asked = F.col("turn") + F.pmod(F.col("page_id") * 104_729, F.lit(2_000_003)) - 600_000
    kind = F.pmod(F.col("page_id"), F.lit(4))
    tags = F.when(kind == 0, F.col("tag")).when(kind == 1, F.concat(F.lit("W/"), F.col("tag"))).when(kind == 2, F.lit('"old"'))
    revisit = base.select(
        F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("record_id"), "url", asked.alias("ts"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"), tags.alias("etag"), F.col("stamp").alias("last_modified"),
        common("content-type", "text/plain", "date", asked.cast("string"), "cache-control", "max-age=60").alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)
