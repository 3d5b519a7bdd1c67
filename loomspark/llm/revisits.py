"""Not-modified revisits of a web archive resolved to the responses they stand for.

A revisit record says that a URL answered "not modified"; its payload is that of the latest earlier full
response of the same canonical URL. The as-of join finds that response, validators are checked (the entity
tag if both have one, else the modification time, else the payload digest; with none in common the revisit
stays unresolved), and headers are merged: those that a not-modified answer may update come from the revisit, all others
from the response.

Records are range-partitioned by URL and time, so a URL with most of the records spans many tasks: each task
carries the latest response forward inside its range, and the last response of each range and URL (a row
for each) is carried over to the ranges that follow. Payloads do not take part; they are attached by record id afterwards.

Edge cases: null URLs are never resolved; records of one time are ordered by id; a null time is earlier than all;
repeated rows resolve alike; null or empty validators are absent; an empty table gives no rows; extra columns pass through ``attach_payload``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import materialize, shuffle_width

# Headers that a not-modified answer may update: fixed values.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "set-cookie", "vary", "via", "warning")
# Query parameters that do not select content: fixed values.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid)="


def canonical_url(url: Column) -> Column:
    """Lower-case host without www and default port, no scheme, fragment, tracking parameters or final slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def _present(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def merge_headers(response: Column, revisit: Column) -> Column:
    """Lower-case header maps merged."""
    updates = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates)


def resolve(records: DataFrame) -> DataFrame:
    """records (record_id, url, ts, is_revisit, etag, last_modified, digest, headers) to the same plus canonical_url, refers_to, resolved, merged.

    refers_to is the latest earlier response's id (also if validators disagree, with resolved false); both are null for responses.
    """
    tag = F.regexp_replace(_present("etag"), "^W/", "")
    slim = records.select("record_id", "url", "ts", "is_revisit", tag.alias("etag"), _present("last_modified").alias("last_modified"), _present("digest").alias("digest"), "headers", canonical_url(F.col("url")).alias("canonical_url"))
    order = ["canonical_url", "ts", "record_id"]
    ranged = materialize(slim.repartitionByRange(shuffle_width(records.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "revisit-ranges")
    facts = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    full = ~F.col("is_revisit") & F.col("canonical_url").isNotNull()
    ends = ranged.where(full).groupBy("canonical_url", "_part").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    ends = ends.join(ranged.select(F.col("canonical_url").alias("u"), F.col("ts").alias("t"), F.col("record_id").alias("i"), facts.alias("f")), (F.col("canonical_url") == F.col("u")) & F.col("last.ts").eqNullSafe(F.col("t")) & (F.col("last.record_id") == F.col("i")))
    ends = ends.dropDuplicates(["canonical_url", "_part"]).select("canonical_url", "_part", "f")
    # A row for each range and URL: the last response of the ranges before.
    here = ranged.select("canonical_url", "_part").where("canonical_url IS NOT NULL").distinct().join(ends, ["canonical_url", "_part"], "left")
    before = Window.partitionBy("canonical_url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = here.select("canonical_url", "_part", F.last("f", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("_part", "canonical_url").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = ranged.withColumn("latest", F.last(F.when(full, facts), ignorenulls=True).over(inside)).join(carried, ["canonical_url", "_part"], "left")
    a = F.when(F.col("is_revisit") & F.col("canonical_url").isNotNull(), F.coalesce("latest", "carried"))
    found = seen.withColumn("a", a)
    same = F.coalesce(F.col("etag") == F.col("a.etag"), F.col("last_modified") == F.col("a.last_modified"), F.col("digest") == F.col("a.digest"), F.lit(False))
    resolved = F.when(F.col("is_revisit"), F.col("a").isNotNull() & same)
    merged = F.when(resolved, merge_headers(F.col("a.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return found.select("record_id", "url", "canonical_url", "ts", "is_revisit", F.col("a.record_id").alias("refers_to"), resolved.alias("resolved"), merged.alias("headers"))


def attach_payload(resolved: DataFrame, records: DataFrame, payload: str) -> DataFrame:
    """resolved plus the payload: a response's own, or that of the response a resolved revisit stands for; of a repeated id's payloads the least."""
    key = F.when(~F.col("is_revisit"), F.col("record_id")).when(F.col("resolved"), F.col("refers_to"))
    source = records.where("NOT is_revisit").groupBy(F.col("record_id").alias("_id")).agg(F.min(payload).alias(payload))
    return resolved.join(source, key == F.col("_id"), "left").drop("_id")


#: Numbers of a page's records: its response, then conditional fetches by kind.
RESPONSE, SAME_TAG, OTHER_TAG, BY_TIME, NO_VALIDATOR, EARLY = range(6)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Records of an archive that fetched each page once and some of them again: record_id is eight times page_id plus the kind, and so is the time.

    Every page has a full response, whose entity tag and digest are those of the html; its modification time is a number that
    ten pages share. By page_id, conditional fetches of the same address (with a fragment, which canonical form drops) follow: one in three
    repeats the tag as a weak one, one in three sends another, one in three sends no tag but a modification time, right for even ids; one in five
    has no validator at all; one in seven asks with the tag before the page itself was fetched.
    """
    tag, at = F.md5(F.coalesce("html", F.lit(""))), F.col("page_id")
    kinds = F.array(
        F.lit(RESPONSE), *[F.when(at % 3 == i, F.lit(k)) for i, k in enumerate((SAME_TAG, OTHER_TAG, BY_TIME))], F.when(at % 5 == 0, F.lit(NO_VALIDATOR)), F.when(at % 7 == 0, F.lit(EARLY))
    )
    base = pages.select("page_id", "url", tag.alias("tag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"), F.floor(at / 10).cast("string").alias("day"))
    rows = base.withColumn("kind", F.explode(F.array_compact(kinds)))
    k, none = F.col("kind"), F.lit(None).cast("string")
    revisit = k != RESPONSE
    etag = F.when(k.isin(RESPONSE, EARLY), F.col("tag")).when(k == SAME_TAG, F.concat(F.lit("W/"), "tag")).when(k == OTHER_TAG, F.md5("tag"))
    modified = F.when(k == RESPONSE, F.col("day")).when(k == BY_TIME, F.when(at % 2 == 0, F.col("day")).otherwise("later"))
    ts = F.when(k == EARLY, at * 8 - 1).otherwise(at * 8 + k)
    headers = {"date": ts.cast("string"), "etag": etag, "last-modified": modified, "content-length": F.when(revisit, "0").otherwise(F.col("size")), "content-type": F.when(~revisit, "text/html"), "cache-control": F.when(revisit, "max-age=60")}
    given = F.map_filter(F.create_map(*[x for n, v in headers.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    return rows.select(
        (at * 8 + k).alias("record_id"), F.when(revisit, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"), ts.alias("ts"), revisit.alias("is_revisit"),
        etag.alias("etag"), modified.alias("last_modified"), F.when(~revisit, F.col("tag")).otherwise(none).alias("digest"), given.alias("headers"),
    )
