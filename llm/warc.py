"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record has no payload: the server said that the page hasn't changed since an earlier visit.
``resolve`` finds the latest earlier full response with the same canonical URL, checks that the
revisit's validators agree with it, gives the revisit its payload, and merges the headers
a not-modified answer may carry (FRESH) over those of the response.

Validators are the digest of the payload, the entity tag and the date of the last change (header ``last-modified``).  Digests have to be equal
where both records have one; so do entity tags, by weak comparison (``W/"x"`` equals ``"x"``), or, where one record has none, the dates of the
last change.  At least one of the three has to be there on both sides and agree.

The join is two nested windows, so that one URL may hold any part of the rows: within each slice of SLICE
sequence numbers of a URL, and over the slices' last responses.  Records without a URL or sequence number take no part in them.

Order is by sequence number, then record id.  A null URL, a null sequence number, no earlier response or a
validator that differs leave a revisit unresolved, and ``state`` says which.  Repeated rows: each keeps a row.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import table

SLICE = 1 << 12
#: Headers that a not-modified answer may renew.
FRESH = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track visitors.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid"


def canonical(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, default port, fragment, tracking parameters and last slash dropped, other parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    query = F.regexp_replace(F.when(F.locate("?", rest) > 0, F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(""), rf"(^|&)({TRACKING})(=[^&]*)?(?=&|$)", "")
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def resolve(records: DataFrame, slice_: int = SLICE) -> DataFrame:
    """(id, canonical_url, state, ref_id, digest, headers) of each of records.

    records: id, seq, type (response or revisit), url, etag, digest (of the payload; of a revisit the one it
    claims), headers map<string,string> with names in lower case.
    """
    r = records.select("id", F.col("seq").cast("long").alias("seq"), "type", canonical(F.col("url")).alias("canonical_url"), "etag", "digest", "headers")
    placed = F.col("seq").isNotNull() & F.col("canonical_url").isNotNull()
    aside = r.where(~placed)
    r = r.where(placed).withColumn("slice", F.floor(F.col("seq") / slice_))
    full = F.when(F.col("type") == "response", F.struct("id", "etag", "digest", "headers"))
    order = [F.col("seq").asc(), F.col("id").asc_nulls_first()]
    near = W.partitionBy("canonical_url", "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ends = r.groupBy("canonical_url", "slice").agg(F.max_by(full, F.when(full.isNotNull(), F.struct("seq", "id"))).alias("end"))
    far = ends.select(F.col("canonical_url").alias("u"), F.col("slice").alias("s"), F.last("end", ignorenulls=True).over(
        W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("far")).where(F.col("far").isNotNull())
    r = r.withColumn("near", F.last(full, ignorenulls=True).over(near))
    # as far grows with the records, this join is shuffled at every size
    r = r.join(far.hint("merge"), (F.col("canonical_url") == F.col("u")) & (F.col("slice") == F.col("s")), "left")
    r = r.withColumn("ref", F.coalesce("near", "far")).select(*aside.columns, "ref")
    r = r.unionByName(aside.withColumn("ref", F.lit(None).cast(r.schema["ref"].dataType)))
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    same = lambda a, b, weaker: F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(weaker)
    changed = lambda headers: F.element_at(headers, F.lit("last-modified"))
    tags = same(weak(F.col("etag")), weak(F.col("ref.etag")), same(changed(F.col("headers")), changed(F.col("ref.headers")), F.lit(None).cast("boolean")))
    digests = same(F.col("digest"), F.col("ref.digest"), F.lit(None).cast("boolean"))
    agree = F.coalesce(tags & digests, tags, digests, F.lit(False)) & F.coalesce(tags, F.lit(True)) & F.coalesce(digests, F.lit(True))
    state = (F.when(~F.col("type").eqNullSafe("revisit"), F.lit("full")).when(F.col("canonical_url").isNull(), "no_url").when(F.col("ref").isNull(), "no_response")
             .when(agree, "resolved").otherwise("mismatch"))
    r = r.withColumn("state", state)
    resolved = F.col("state") == "resolved"
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*FRESH))
    kept = F.coalesce("ref.headers", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(kept, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(fresh), k), F.lit(False))), fresh)
    return r.select("id", "canonical_url", "state", F.when(resolved, F.col("ref.id")).alias("ref_id"),
                    F.when(resolved, F.col("ref.digest")).when(F.col("state") == "full", F.col("digest")).alias("digest"),
                    F.when(resolved, merged).otherwise(F.col("headers")).alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """A web archive of pages: a full capture of each, and one visit that found it not modified.

    The visit follows the capture, or for every eleventh page comes before it, and spells the URL in another way.  Every third page is one
    and the same URL, every thirteenth has none.  Captures say when they last changed; every seventh has no entity tag and every ninth a weak
    one.  A visit brings the page's digest and entity tag, for every fifth page the tag of a changed one; that of a page without a
    tag brings the date of the last change instead, for every second a wrong one, and every seventeenth visit brings nothing.
    """
    k, none = F.col("page_id"), F.lit(None).cast("string")
    url = F.when(k % 13 == 0, none).when(k % 3 == 1, F.lit("http://hot.example.org/")).otherwise(F.col("url"))
    p = pages.select("page_id", url.alias("url"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    tag = F.left("digest", F.lit(16))
    own = F.when(k % 7 == 0, none).when(k % 9 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    day = F.concat(F.lit("day "), (k % 3).cast("string"))
    seen = F.when((k % 7 == 0) | (k % 17 == 0), none).when(k % 5 == 0, F.concat(tag, F.lit("-2"))).otherwise(tag)
    changed = F.when((k % 7 == 0) & (k % 17 != 0), F.when(k % 2 == 0, day).otherwise("day 9"))
    claimed = F.when((k % 7 == 0) | (k % 17 == 0), none).otherwise(F.col("digest"))
    some = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(x).alias("key"), v.alias("value")) for x, v in pairs]), lambda e: e["value"].isNotNull()))
    full = F.struct((2 * k).alias("seq"), F.lit("response").alias("type"), F.col("url"), own.alias("etag"), F.col("digest").alias("digest"),
                    some(("etag", own), ("date", F.lit("day one")), ("content-type", F.lit("text/html")), ("last-modified", day)).alias("headers"))
    again = F.struct((2 * k + F.when(k % 11 == 0, -1).otherwise(1)).alias("seq"), F.lit("revisit").alias("type"),
                     F.concat(F.regexp_replace("url", r"^https?://(www\.)?", "HTTP://"), F.lit("#top")).alias("url"), seen.alias("etag"), claimed.alias("digest"),
                     some(("etag", seen), ("date", F.lit("day two")), ("x-cache", F.lit("hit")), ("last-modified", changed)).alias("headers"))
    p = p.select("page_id", F.explode(F.array(full, again)).alias("r"))
    return p.select(F.struct("page_id", "r.type").alias("id"), "r.seq", "r.type", "r.url", "r.etag", "r.digest", "r.headers")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resolve(records_of(table(spark, sf_dir, "pages")))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return d.select(F.col("id.page_id").alias("page_id"), F.col("id.type").alias("type"), "canonical_url", "state",
                    F.col("ref_id.page_id").alias("ref_page_id"), "digest", pairs.alias("headers"))


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'http://hot.example.org/' ELSE url END AS url, md5(coalesce(html, '')) AS digest FROM pages),
x AS (
  SELECT page_id, 2 * page_id AS seq, 'response' AS type, url, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 9 = 0 THEN 'W/' || left(digest, 16) ELSE left(digest, 16) END AS etag, digest,
    'day ' || (page_id % 3) AS changed FROM p
  UNION ALL
  SELECT page_id, 2 * page_id + CASE WHEN page_id % 11 = 0 THEN -1 ELSE 1 END, 'revisit', regexp_replace(url, '^https?://(www\.)?', 'HTTP://') || '#top',
    CASE WHEN page_id % 7 = 0 OR page_id % 17 = 0 THEN NULL ELSE left(digest, 16) || CASE WHEN page_id % 5 = 0 THEN '-2' ELSE '' END END,
    CASE WHEN page_id % 7 = 0 OR page_id % 17 = 0 THEN NULL ELSE digest END,
    CASE WHEN page_id % 7 = 0 AND page_id % 17 <> 0 THEN CASE WHEN page_id % 2 = 0 THEN 'day ' || (page_id % 3) ELSE 'day 9' END END FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM x),
v AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(u, '^[^/?]*', '') AS rest FROM u),
w AS (
  SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(CASE WHEN rest LIKE '%?%' THEN regexp_replace(rest, '^[^?]*\?', '') ELSE '' END, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM v),
c AS (SELECT page_id, seq, type, etag, digest, changed, CASE WHEN url IS NULL THEN NULL ELSE host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url FROM w),
r AS (
  SELECT a.*, b.page_id AS ref_id, b.etag AS ref_etag, b.digest AS ref_digest, b.changed AS ref_changed
  FROM c a ASOF LEFT JOIN (SELECT * FROM c WHERE type = 'response' AND canonical_url IS NOT NULL) b ON a.canonical_url = b.canonical_url AND a.seq > b.seq),
t AS (
  SELECT *, CASE WHEN etag IS NOT NULL AND ref_etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(ref_etag, '^W/', '')
    WHEN changed IS NOT NULL AND ref_changed IS NOT NULL THEN changed = ref_changed END AS tags,
    CASE WHEN digest IS NOT NULL AND ref_digest IS NOT NULL THEN digest = ref_digest END AS digests FROM r),
s AS (
  SELECT *, CASE WHEN type = 'response' THEN 'full' WHEN canonical_url IS NULL THEN 'no_url' WHEN ref_id IS NULL THEN 'no_response'
    WHEN coalesce(tags, digests, FALSE) AND coalesce(tags, TRUE) AND coalesce(digests, TRUE) THEN 'resolved' ELSE 'mismatch' END AS state FROM t),
m AS (
  SELECT *, CASE WHEN state = 'resolved' THEN coalesce(etag, ref_etag) ELSE etag END AS new_etag, CASE WHEN state = 'resolved' THEN coalesce(changed, ref_changed) ELSE changed END AS new_changed FROM s)
SELECT page_id, type, canonical_url, state, CASE WHEN state = 'resolved' THEN ref_id END AS ref_page_id,
  CASE state WHEN 'resolved' THEN ref_digest WHEN 'full' THEN digest END AS digest,
  CASE WHEN state IN ('resolved', 'full') THEN 'content-type=text/html;' ELSE '' END || CASE WHEN type = 'revisit' THEN 'date=day two' ELSE 'date=day one' END
    || coalesce(';etag=' || new_etag, '') || coalesce(';last-modified=' || new_changed, '') || CASE WHEN state IN ('resolved', 'full') THEN '' ELSE ';x-cache=hit' END AS headers
FROM m
"""
