"""Resolution of not-modified revisits in web archives.

A revisit record (an HTTP 304) has no payload.  Its content is that of the
latest earlier full response for the same canonical URL, if their validators
agree; the 304's headers then update the stored ones as far as HTTP caching
permits.  The as-of join works on keys alone: within a stretch of time by a
window, across stretches by the last full response that each one carries over,
so that a URL captured any number of times is spread over the stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.storage import materialize


#: Query parameters that don't select content.
TRACKING = r"utm_[^=&]*|gclid|fbclid|msclkid|ref|sessionid|phpsessid"
#: Header fields that a 304 doesn't update: those that describe the payload as it was sent, and those of one connection.
NOT_MERGED = (
    "connection content-encoding content-length content-md5 content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization te trailer transfer-encoding upgrade"
).split()
#: Seconds of a stretch of time.
STRETCH = 86_400

RECORD = "record_id bigint, url string, captured bigint, status int, headers map<string,string>, payload string"


def canonical_url(url: Column) -> Column:
    """The name that spellings of one address share; null for null.

    Scheme, fragment, user, a leading ``www.``, default ports, a trailing slash
    and tracking parameters go; the host is in lower case and the parameters
    that stay are sorted.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^[^@]*@", ""), r"^www\.|:(?:80|443)$", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.array_sort(F.split(query, "&")), lambda x: (x != "") & ~F.lower(x).rlike(rf"^(?:{TRACKING})(?:=.*)?$"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _field(headers: Column, name: str) -> Column:
    return F.nullif(F.trim(F.element_at(headers, name)), F.lit(""))


def _lower_names(headers: Column) -> Column:
    """Names in lower case; of several spellings of a name the value that sorts last stays, and null values go."""
    entries = F.array_sort(F.transform(F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull()), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(entries, lambda e, i: (i + 1 == F.size(entries)) | (F.get(entries, i + 1)["key"] != e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def agreement(revisit: Column, stored: Column) -> Column:
    """``etag``, ``last-modified`` or ``digest`` for the first validator that both have, if it agrees;
    ``mismatch`` if it doesn't; ``unvalidated`` if they share none."""
    tag = lambda h: F.regexp_replace(_field(h, "etag"), r"^W/", "")
    out = F.lit("unvalidated")
    checks = [("digest", lambda h: _field(h, "warc-payload-digest")), ("last-modified", lambda h: _field(h, "last-modified")), ("etag", tag)]
    for name, of in checks:
        both = of(revisit).isNotNull() & of(stored).isNotNull()
        out = F.when(both, F.when(of(revisit) == of(stored), F.lit(name)).otherwise(F.lit("mismatch"))).otherwise(out)
    return out


def merged_headers(stored: Column, revisit: Column) -> Column:
    """The stored fields, with those of the 304 that may update them."""
    named = F.transform(F.split(F.lower(F.coalesce(_field(revisit, "connection"), F.lit(""))), ","), lambda x: F.trim(x))
    fresh = F.map_filter(revisit, lambda k, v: ~k.isin(NOT_MERGED) & ~k.startswith("warc-") & ~F.array_contains(named, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def latest_full(keys: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(record_id, base_id)`` of every revisit: the last full response before it by (captured, record_id).

    ``keys`` has ``(record_id, key, captured, full)``.
    """
    dealt = materialize(keys.withColumn("stretch", F.floor(F.col("captured") / stretch)), "captures")
    before = Window.partitionBy("key", "stretch").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(F.when(F.col("full"), F.col("record_id")), ignorenulls=True).over(before)).where(~F.col("full"))
    carried = dealt.where("full").groupBy("key", "stretch").agg(F.max(F.struct("captured", "record_id")).alias("last"))
    wanted = near.where(F.col("near").isNull()).select("key", "stretch").distinct()
    marks = carried.select("key", "stretch", "last").unionByName(wanted.select("key", "stretch", F.lit(None).cast(carried.schema["last"].dataType).alias("last")))
    # A row or two for each URL and stretch, however many captures it has.
    earlier = Window.partitionBy("key").orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    over = marks.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).where(F.col("last").isNull()).select("key", "stretch", F.col("far.record_id").alias("far"))
    return near.join(over, ["key", "stretch"], "left").select("record_id", F.coalesce("near", "far").alias("base_id"))


def resolve_revisits(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Every revisit of ``records`` (columns as in ``RECORD``) with the content it stands for.

    ``(record_id, key, captured, base_id, outcome, status, headers, payload)``.
    A record is a revisit if its status is 304 and a full response if it is
    200 and has a payload; others take no part.  ``outcome`` is the validator
    that agreed, ``mismatch``, ``unvalidated``, or ``orphan`` if there is no
    earlier full response; but for the first kind, status, headers and payload
    are the revisit's own.  A mismatch isn't carried on to an older response.
    Records without an id, a URL or a time are orphans or no base.  Where rows
    share an id the earliest stands for them, of equally early ones that of
    the least URL and hash.  Payloads of any length pass through whole; other
    columns are ignored; an empty table has no revisits.
    """
    named = records.select("record_id", canonical_url(F.col("url")).alias("key"), "captured", "status", _lower_names(F.col("headers")).alias("headers"), "payload")
    named = named.withColumn("place", F.struct("captured", "key", F.xxhash64("status", "payload", F.to_json("headers")).alias("tie")))
    full = (F.col("status") == 200) & F.col("payload").isNotNull()
    usable = F.col("record_id").isNotNull() & F.col("key").isNotNull() & F.col("captured").isNotNull()
    revisits = named.where(F.col("status") == 304)
    keys = named.where(usable & (full | (F.col("status") == 304))).groupBy("record_id").agg(F.min(F.struct("place", F.coalesce(full, F.lit(False)).alias("full"))).alias("least"))
    keys = keys.select("record_id", "least.place.key", "least.place.captured", "least.full")
    bases = materialize(latest_full(keys, stretch), "bases")
    heads = named.where(usable & full).select(F.col("record_id").alias("base_id"), F.col("status").alias("base_status"), F.col("headers").alias("base_headers"), F.col("payload").alias("base_payload"), "place")
    used = bases.select("base_id").where("base_id is not null").distinct()
    heads = heads.join(used, "base_id", "left_semi").groupBy("base_id").agg(F.min_by(F.struct("base_status", "base_headers", "base_payload"), "place").alias("base"))
    # Written out, so that adaptive execution may split the revisits of a base that most refer to.
    heads = materialize(heads.select("base_id", "base.*"), "heads")
    met = revisits.join(bases, "record_id", "left").join(heads, "base_id", "left")
    outcome = F.when(F.col("base_id").isNull(), F.lit("orphan")).otherwise(agreement(F.col("headers"), F.col("base_headers")))
    judged = met.withColumn("outcome", outcome)
    good = F.col("outcome").isin("etag", "last-modified", "digest")
    pick = lambda a, b: F.when(good, a).otherwise(b)
    return judged.select(
        "record_id", "key", "captured", "base_id", "outcome",
        pick(F.col("base_status"), F.col("status")).alias("status"),
        pick(merged_headers(F.col("base_headers"), F.col("headers")), F.col("headers")).alias("headers"),
        pick(F.col("base_payload"), F.col("payload")).alias("payload"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl of the ``pages`` table in ``RECORD``'s columns: each page fetched once and, a little later, once more.

    The second fetch spells the address in another way and is answered 304.
    Its entity tag is the page's; every seventh page has got a new one, every
    eleventh answers with a date of modification alone.
    """
    when = F.col("page_id") * 10
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 97).cast("string"))
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", when.alias("captured"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("X-Fetch"), F.lit("1")).alias("headers"),
        F.col("html").alias("payload"),
    )
    second_tag = F.when(F.col("page_id") % 11 == 0, F.lit(None)).when(F.col("page_id") % 7 == 0, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag))
    other = F.concat(F.regexp_replace(F.regexp_replace("url", r"#.*$", ""), "^http://", "https://"), F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_medium=revisit#again"))
    second = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), other.alias("url"), (when + 25).alias("captured"), F.lit(304).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("etag"), second_tag, F.lit("last-modified"), date, F.lit("x-fetch"), F.lit("2")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(second)
