"""WARC revisits: as-of join by canonical URL to the latest earlier full response.

A ``revisit`` record says that a page was not modified and has no payload.  It is
resolved to the latest ``response`` of the same canonical URL that stands before
it in (time, record id) order, if their validators agree: entity tags by weak
comparison if the revisit has one, else the Last-Modified value.  The resolved
record gets the response's payload and its headers, overlaid with those headers of
the revisit that a 304 may carry.

Scale.  Only narrow columns take part in the as-of join.  It runs in two levels:
inside slices of time of each URL, then over one row per slice, so that a URL that
a third of all captures share is spread over as many tasks as it has slices.  Slices
end at approximate quantiles of all times, so a few odd dates do not widen them
(captures of one URL at one and the same time are one slice).
Payloads and headers are fetched once, by record id, for what was resolved; a
revisit's own headers by a hash of all that it says.
DataFrame functions only.

Defined cases.  ``status`` is ``resolved``, ``no_prior`` (no earlier response, or
no URL), ``mismatch`` (validators differ) or ``no_validator`` (the revisit has
none, or the response lacks the one it has); only resolved rows have a payload,
the others keep their own headers.  Of header names that differ in case alone the
last counts; null headers are none.  Times are compared in their own type.  Equal
times are ordered by record id, of
repeated record ids one response counts; every revisit row gives a row, also if
its id is null or repeated.  Records of other types are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a 304 response updates (RFC 9110, 15.4.5) and Last-Modified.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid)(=|$)"
_SITE = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)"
SLICES = 256


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without a final slash, and the
    sorted parameters that do not track visitors; scheme and fragment are left out."""
    whole = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, _SITE, 1)), "^www\\.|:(80|443)$", "")
    rest = F.regexp_replace(whole, _SITE, "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    given = F.split(F.regexp_replace(rest, "^[^?]*[?]?", ""), "&")
    params = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))


def _header(name: str) -> Column:
    return F.element_at("headers", name)


def _lower_names(headers: Column) -> Column:
    """The map with names in lower case; of equal ones the last entry."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(F.map_keys(headers), F.lower)
    later = lambda e, i: F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def _slice_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most ``value``, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def resolve_revisits(records: DataFrame, *, slices: int = SLICES) -> DataFrame:
    """``record_id, url_key, status, resolved_id, headers, payload`` for every revisit of
    ``records(record_id, record_type, url, ts, headers map<string,string>, payload)``;
    header names are compared in lower case, ``ts`` is a number or a timestamp."""
    kind = dict(records.dtypes)["ts"]
    number = F.col("ts").cast("timestamp").cast("double") if kind in ("timestamp_ntz", "date") else F.col("ts").cast("double")
    rows = records.filter(F.col("record_type").isin("response", "revisit")).select(
        "record_id", (F.col("record_type") == "response").alias("full"), canonical_url(F.col("url")).alias("url_key"), "ts", _lower_names(F.col("headers")).alias("headers"), "payload"
    )
    # what a revisit says, so that its own headers are found again: ids can be null or repeated
    said = F.xxhash64("record_id", "url_key", "ts", F.array_sort(F.map_entries("headers")))
    rows = rows.withColumn("key", F.when(~F.col("full"), said))
    narrow = rows.select("record_id", "full", "url_key", "ts", F.regexp_replace(_header("etag"), "^W/", "").alias("etag"), _header("last-modified").alias("modified"), "key")
    bounds = narrow.agg(F.percentile_approx(number, [i / slices for i in range(1, slices)]).alias("b")).first()["b"]
    narrow = narrow.withColumn("slice", _slice_of(number, sorted(set(bounds or []))))

    found = F.struct("ts", "record_id", "etag", "modified")
    known = narrow.filter("url_key is not null and ts is not null")
    inside = Window.partitionBy("url_key", "slice").orderBy("ts", "record_id", F.col("full").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = known.withColumn("near", F.last(F.when(F.col("full"), found), ignorenulls=True).over(inside)).filter("not full")
    newest = known.groupBy("url_key", "slice").agg(F.max(F.when(F.col("full"), found)).alias("newest"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select("url_key", "slice", F.last("newest", ignorenulls=True).over(earlier).alias("carried")).filter("carried is not null")
    asof = local.join(carried, ["url_key", "slice"], "left").select("record_id", "url_key", "etag", "modified", "key", F.coalesce("near", "carried").alias("prior"))
    lost = narrow.filter("not full and (url_key is null or ts is null)").select("record_id", "url_key", "etag", "modified", "key", F.lit(None).cast(asof.schema["prior"].dataType).alias("prior"))

    pair = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("prior.etag")).otherwise(F.col("modified") == F.col("prior.modified"))
    status = F.when(F.col("prior").isNull(), "no_prior").when(pair.isNull(), "no_validator").when(pair, "resolved").otherwise("mismatch")
    judged = asof.unionByName(lost).select("record_id", "url_key", status.alias("status"), F.col("prior.record_id").alias("prior_id"), "key")
    judged = judged.select("record_id", "url_key", "status", F.when(F.col("status") == "resolved", F.col("prior_id")).alias("resolved_id"), "key")

    old = rows.filter("full").select(F.col("record_id").alias("resolved_id"), F.col("headers").alias("old"), "payload").join(
        judged.filter("resolved_id is not null").select("resolved_id").distinct(), "resolved_id", "left_semi"
    ).dropDuplicates(["resolved_id"])
    own = rows.filter("not full").select("key", F.col("record_id").alias("own_id"), F.col("headers").alias("own")).dropDuplicates(["key", "own_id"]).withColumnRenamed("key", "own_key")
    sent = F.map_filter(F.col("own"), lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter(F.col("old"), lambda k, v: ~F.coalesce(F.map_contains_key(sent, k), F.lit(False)))
    merged = F.when(F.col("resolved_id").isNull(), F.col("own")).otherwise(F.map_concat(kept, F.coalesce(sent, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    return (
        judged.join(own, (F.col("key") == F.col("own_key")) & F.col("record_id").eqNullSafe(F.col("own_id"))).join(old, "resolved_id", "left")
        .select("record_id", "url_key", "status", "resolved_id", merged.alias("headers"), "payload")
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC-like records from ``pages(page_id, url, html)``: each page's full response, then a revisit
    of it, as much later as the page is long.  Revisits send a weak entity tag where the URL has a
    fragment, only Last-Modified where it has parameters, and else the entity tag."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    dated = F.concat(F.lit("bytes-"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    base = pages.select("page_id", "url", "html", tag.alias("tag"), dated.alias("dated"))

    def headers(**fields: Column) -> Column:
        return F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v))), lambda k, v: v.isNotNull())

    full = base.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("record_type"), "url", (F.col("page_id") * 2).alias("ts"),
        headers(content_type=F.lit("text/html"), etag=F.col("tag"), last_modified=F.col("dated"), server=F.lit("origin"), cache_control=F.lit("max-age=60")).alias("headers"),
        F.col("html").alias("payload"),
    )
    weak, params = F.col("url").contains("#"), F.col("url").contains("?")
    later = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("record_type"), "url",
        (F.col("page_id") * 2 + F.octet_length(F.coalesce("html", F.lit("")))).alias("ts"),
        headers(
            etag=F.when(weak, F.concat(F.lit("W/"), F.col("tag"))).when(params, F.lit(None)).otherwise(F.col("tag")),
            last_modified=F.col("dated"), server=F.lit("edge"), content_length=F.lit("0"), cache_control=F.concat(F.lit("max-age="), F.col("page_id").cast("string")),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(later)
