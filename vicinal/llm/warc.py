"""Not-modified revisits of web captures, resolved against the responses they refer to.

Captures are dealt out in the order of URL and time, so a URL with very many captures takes many tasks,
however they are spread over time.  A revisit finds the latest earlier response in its own slice of
that order, or the last one of an earlier slice, carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

# Header fields that a not-modified answer may bring up to date.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www and standard port; path without final slashes; sorted
    parameters without those in TRACKING; no scheme and no fragment.  Null for null and for URLs
    without a host."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&")
    query = F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, tail))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record, joined as of its time to the latest earlier full response of its URL.

    records: record_id long, url, ts long (seconds), kind ('response' or 'revisit'), status int, etag,
    last_modified, digest, headers map (names in lower case).  A full response is a 'response' with
    status 200; earlier means a smaller ts, and among equal ones the larger record_id counts as later.

    Result: record_id, canonical_url, outcome, matched_id, digest and headers.  outcome: 'resolved';
    'mismatch' if the validators differ (ETags compared weakly, else Last-Modified, else digests);
    'unvalidated' if there is none on both sides; 'no_response' without an earlier response or
    without a usable URL or time.  headers of a resolved record are the response's, with the
    permitted ones of the revisit in their place; of others, the revisit's own.  Null maps count as
    empty, repeated records stay, other columns are ignored, an empty table gives no rows.  URLs and
    headers may have any length.
    """
    r = records.select(
        "record_id", canonical_url(F.col("url")).alias("u"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag", "last_modified", "digest",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    said = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    usable = r.where("u is not null and ts is not null and (kind = 'revisit' or (kind = 'response' and status = 200))")
    # revisits come before the responses of the same second; the last column parts records that are repeated
    usable = usable.withColumn("late", F.when(full, 1).otherwise(0)).withColumn("copy", F.monotonically_increasing_id())
    dealt = usable.repartitionByRange("u", "ts", "late", "record_id", "copy").withColumn("slice", F.spark_partition_id()).drop("copy")
    usable = checkpointed(dealt)
    order = Window.partitionBy("u", "slice").orderBy("ts", "late", "record_id")
    inside = usable.withColumn("near", F.last(F.when(full, said), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    inside = inside.where("kind = 'revisit'").drop("late")
    # from earlier slices: the last response of each, carried forward over slices with revisits
    lasts = usable.where(full).groupBy("u", "slice").agg(F.max_by(F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"), F.struct("ts", "record_id")).alias("last"))
    asked = inside.where("near is null").select("u", "slice").distinct()
    slices = lasts.join(asked.withColumn("asked", F.lit(True)), ["u", "slice"], "full_outer")
    by_slice = Window.partitionBy("u").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("far", F.last("last", ignorenulls=True).over(by_slice)).where("asked").select("u", "slice", "far")
    late = inside.where("near is null").join(carried, ["u", "slice"], "left")
    joined = inside.where("near is not null").withColumn("m", F.col("near")).unionByName(late.withColumn("m", F.col("far")).drop("far"))
    lost = r.where("kind = 'revisit' and (u is null or ts is null)").withColumn("slice", F.lit(None).cast("int")).withColumn("near", F.lit(None).cast(joined.schema["near"].dataType)).withColumn("m", F.col("near"))
    return _judged(joined.unionByName(lost))


def _judged(df: DataFrame) -> DataFrame:
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = [(weak(F.col("etag")), weak(F.col("m.etag"))), (F.col("last_modified"), F.col("m.last_modified")), (F.col("digest"), F.col("m.digest"))]
    same = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    outcome = F.when(F.col("m").isNull(), "no_response").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter("m.headers", lambda k, _: ~F.array_contains(F.map_keys(F.col("new")), k))
    df = df.withColumn("outcome", outcome).withColumn("new", new)
    done = F.col("outcome") == "resolved"
    return df.select(
        "record_id", F.col("u").alias("canonical_url"), "outcome", F.col("m.record_id").alias("matched_id"),
        F.when(done, F.col("m.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, F.map_concat(old, "new")).otherwise(F.col("headers")).alias("headers"),
    )
