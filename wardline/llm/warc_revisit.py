"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit says that a page had not changed; its content is that of the latest earlier full response with the same
canonical URL. The join is two-level: records are grouped by URL and time bucket, a window inside the bucket finds
the latest earlier response there, and the last response of each earlier bucket is carried forward over one small
row per URL and bucket. A URL with very many records is thus spread over its buckets. Only ids, validators and
headers take part; payloads are joined afterwards by response id.

Validators decide whether the response found is the one meant: entity tags first (compared weakly), then
modification dates, then payload digests. Statuses: ``resolved``; ``changed`` (a validator differs);
``unvalidated`` (no validator in common); ``missing`` (no earlier response). A resolved revisit has the headers
of the response, updated by those of the revisit that may be updated.

Defined results: earlier means an earlier date, or the same date and a smaller id; a null date is before all
others; a null URL is a URL of its own; null headers are none; names of headers are compared without case, and
of several with one name the first counts as validator; a record that is there several times takes part once;
records of other kinds are ignored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fields that a not-modified answer must not replace, in lower case.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that only track visitors.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$"
BUCKET_SECONDS = 3600


def canonical(url: Column) -> Column:
    """Host and path without scheme, user, default port, ``www.``, fragment, last slash and tracking parameters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lowered(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, those replaced that the fresh ones may update; names in lower case, sorted."""
    update = F.filter(lowered(fresh), lambda h: ~h["name"].isin(*NOT_UPDATED))
    names = F.transform(update, lambda h: h["name"])
    rest = F.filter(lowered(stored), lambda h: ~F.array_contains(names, h["name"]))
    return F.array_sort(F.concat(rest, update))


def resolve(records: DataFrame) -> DataFrame:
    """One row a revisit: ``record_id, url_key, response_id, status, headers``.

    ``records``: ``record_id`` long, ``kind`` (``response`` or ``revisit``), ``url``, ``date`` timestamp, ``headers``
    array of (name, value).
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    narrow = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", (F.col("kind") == "response").alias("full"), canonical(F.col("url")).alias("url_key"),
        F.coalesce(F.unix_micros("date"), F.lit(-(2**63))).alias("at"), F.coalesce("headers", none).alias("headers"),
    )
    # Records that differ in their headers only: the smallest headers stand for all.
    narrow = narrow.groupBy("record_id", "full", "url_key", "at").agg(F.min("headers").alias("headers"))
    timed = narrow.withColumn("bucket", F.floor(F.col("at") / F.lit(BUCKET_SECONDS * 1_000_000)))
    answer = F.when(F.col("full"), F.struct("at", "record_id", "headers"))
    before = W.partitionBy("url_key", "bucket").orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    inside = timed.withColumn("found", F.last(answer, ignorenulls=True).over(before)).where("not full")

    latest = timed.where("full").groupBy("url_key", "bucket").agg(F.max(F.struct("at", "record_id", "headers")).alias("latest"))
    asked = inside.where("found is null").select("url_key", "bucket").distinct()
    marks = latest.unionByName(asked.withColumn("latest", F.lit(None).cast(latest.schema["latest"].dataType)))
    one = marks.groupBy("url_key", "bucket").agg(F.max("latest").alias("latest"))
    earlier = W.partitionBy("url_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = one.withColumn("carried", F.last("latest", ignorenulls=True).over(earlier)).where("carried is not null").select("url_key", "bucket", "carried")

    matched = inside.join(carried, ["url_key", "bucket"], "left").withColumn("response", F.coalesce("found", "carried"))
    old = F.col("response.headers")
    pairs = [(_weak(_header(F.col("headers"), "etag")), _weak(_header(old, "etag")))]
    pairs += [(_header(F.col("headers"), n), _header(old, n)) for n in ("last-modified", "warc-payload-digest")]
    status = F.lit("unvalidated")
    for new, was in reversed(pairs):
        status = F.when(new.isNotNull() & was.isNotNull(), F.when(new == was, "resolved").otherwise("changed")).otherwise(status)
    status = F.when(F.col("response").isNull(), "missing").otherwise(status)
    judged = matched.withColumn("status", status)
    good = F.col("status") == "resolved"
    return judged.select(
        "record_id", "url_key", F.col("response.record_id").alias("response_id"), "status",
        F.when(good, merged(old, F.col("headers"))).otherwise(F.array_sort(lowered(F.col("headers")))).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """``resolved`` with the payload of the response, where there is one; many revisits may share a response."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col(payload).alias("payload"))
    bodies = bodies.groupBy("response_id").agg(F.min("payload").alias("payload"))
    wanted = resolved.where("status = 'resolved'").join(bodies, "response_id", "left")
    rest = resolved.where("status <> 'resolved'").withColumn("payload", F.lit(None).cast(records.schema[payload].dataType))
    return wanted.unionByName(rest)
