"""Operator 7: URL filters by a temporal list join.

Dated list entries become validity intervals, each until the next entry for the same target.
A capture is looked up under all its targets (domains of its host, path prefixes), and an
as-of join takes for each the entry active at the fetch time; the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidencelake.scratch import is_small

MAX_BROADCAST_INTERVALS = 200_000
#: Days in a bucket of time, and tasks that a target's captures of one bucket are spread over.
BUCKET_DAYS, SALT = 30, 8
#: Of several entries for one target and time, the strongest action holds.
STRENGTH = {"remove": 0, "allow": 1, "block": 2}


def intervals(entries: DataFrame) -> DataFrame:
    """``target, action, since, until`` from dated entries ``target, action, listed_at``.

    An entry holds from its date until the target's next one (``until`` null: still). ``remove``
    ends the entry before it. Entries with a null or unknown field are ignored; repeats are one.
    """
    strength = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    known = entries.where("target is not null and listed_at is not null").withColumn("rank", strength[F.col("action")]).where("rank is not null")
    one = known.groupBy("target", "listed_at").agg(F.max(F.struct("rank", "action")).alias("top"))
    until = F.lead("listed_at").over(Window.partitionBy("target").orderBy("listed_at"))
    return one.select("target", F.col("top.action").alias("action"), F.col("listed_at").alias("since"), until.alias("until")).where("action <> 'remove'")


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def targets(url: Column) -> Column:
    """All list targets that cover a URL, as ``target, specificity``.

    ``example.org`` covers the host and its subdomains, ``example.org/a/b`` paths from there
    down. More labels are more specific, any path more than a domain, a longer path more than a shorter one.
    """
    labels = F.split(host_of(url), r"\.")
    steps = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice(labels, n - k + 1, k), ".").alias("target"), k.alias("specificity")))
    none = F.array().cast("array<struct<target:string,specificity:int>>")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda k: F.struct(F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")).alias("target"), (k + 1000).alias("specificity")),
    )
    return F.when(host_of(url) == "", none).otherwise(F.concat(domains, F.when(F.size(steps) > 0, prefixes).otherwise(none)))


def bucket(time: Column) -> Column:
    """The bucket of time of a date or timestamp."""
    return F.floor(F.unix_date(time.cast("date")) / BUCKET_DAYS)


def spans_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``intervals`` once for each bucket of time that they touch between the first capture and the last."""
    fetched = F.broadcast(captures.agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last")))  # one row
    spans = intervals(entries).crossJoin(fetched).where("since <= last and (until is null or until > first)")
    begin, end = F.greatest("since", "first"), F.least(F.coalesce("until", "last"), "last")  # no bucket before or after all captures
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(begin), bucket(end)))).drop("first", "last")
    return spans


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture ``page_id, url, fetched_at`` with the entry that decides: adds ``action, target, since``.

    ``action`` is ``none`` where no entry is active (then ``target`` and ``since`` are null), so
    for a null or unparsable URL or a null time. Captures of one page at different times, or of different URLs under one id (null
    ids too), are judged each; rows equal in all three columns are one capture. Extra columns are not read. A capture meets
    only intervals that touch its own bucket of time, so a target with a long history does not multiply its
    captures, and an interval lies in the buckets from the first capture to the last only. Intervals are broadcast if few by count; else captures are salted, so that a host with most captures is
    spread over SALT tasks for each bucket.
    """
    key = ["page_id", "url", "fetched_at"]
    spans = spans_of(captures, entries)
    keys = captures.select(*key, bucket(F.col("fetched_at")).alias("bucket"), F.explode(targets(F.col("url"))).alias("t")).select(*key, "bucket", "t.*")
    active = (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    if is_small(spans, MAX_BROADCAST_INTERVALS):
        found = keys.join(F.broadcast(spans), ["target", "bucket"]).where(active)
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = keys.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALT)).cast("int")).join(salted, ["target", "bucket", "salt"]).where(active)
    top = F.struct("specificity", "target", "action", "since")
    every = captures.select(*key, F.lit(None).cast(found.select(top.alias("top")).schema["top"].dataType).alias("top"))
    best = found.select(*key, top.alias("top")).unionByName(every).groupBy(key).agg(F.max("top").alias("top"))
    return best.select(*key, F.coalesce("top.action", F.lit("none")).alias("action"), F.col("top.target").alias("target"), F.col("top.since").alias("since"))


def _day(x: str) -> str:
    return f"conv(substr(md5({x}), 1, 7), 16, 10) % "


def captures_of(pages: DataFrame) -> DataFrame:
    """A fetch date in 2024 for each page, from its URL's hash: the table has none."""
    return pages.select("page_id", "url", F.expr(f"date_add(date'2024-01-01', int({_day('url')} 365))").alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """List entries derived from the pages' own hosts, domains and first path steps, dated by hashes."""
    parts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    hosts = parts.select(F.col("host").alias("target")).distinct().withColumn("m", F.expr(_day("target") + "1000"))
    domains = parts.select(F.expr(r"regexp_extract(host, '[^.]+[.][^.]+$', 0)").alias("target")).where("target <> ''").distinct().withColumn("m", F.expr(_day("target") + "1000"))
    firsts = parts.select(F.expr(r"concat(host, regexp_extract(path, '^/[^/]+', 0))").alias("target")).where("target like '%/%'").distinct().withColumn("m", F.expr(_day("target") + "1000"))
    dated = lambda df, when, shift, action: df.where(when).select("target", F.lit(action).alias("action"), F.expr(f"date_add(date'2024-01-01', int(m % 200 + {shift}))").alias("listed_at"))
    return (
        dated(hosts, "m % 3 = 0", 0, "block").unionByName(dated(hosts, "m % 6 = 0", 60, "remove")).unionByName(dated(hosts, "m % 12 = 0", 90, "block"))
        .unionByName(dated(domains, "true", 0, "allow")).unionByName(dated(domains, "m % 2 = 0", 100, "block")).unionByName(dated(firsts, "m % 5 = 0", 30, "allow"))
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the list derived from all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(captures_of(pages), entries_of(pages))


def _sql_day(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 7) AS BIGINT) % "


ORACLE = rf"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST({_sql_day("url")} 365 AS INT) AS fetched_at,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host AS target FROM c WHERE host <> ''),
d AS (SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+$') AS target FROM c WHERE regexp_extract(host, '[^.]+[.][^.]+$') <> ''),
f AS (SELECT DISTINCT host || regexp_extract(path, '^/[^/]+') AS target FROM c WHERE host <> '' AND path SIMILAR TO '/[^/]+.*'),
m AS (SELECT 'h' AS k, target, {_sql_day("target")} 1000 AS m FROM h UNION ALL SELECT 'd', target, {_sql_day("target")} 1000 FROM d UNION ALL SELECT 'f', target, {_sql_day("target")} 1000 FROM f),
e AS (SELECT target, m % 200 AS day, 'block' AS action FROM m WHERE k = 'h' AND m % 3 = 0 UNION ALL SELECT target, m % 200 + 60, 'remove' FROM m WHERE k = 'h' AND m % 6 = 0
  UNION ALL SELECT target, m % 200 + 90, 'block' FROM m WHERE k = 'h' AND m % 12 = 0 UNION ALL SELECT target, m % 200, 'allow' FROM m WHERE k = 'd'
  UNION ALL SELECT target, m % 200 + 100, 'block' FROM m WHERE k = 'd' AND m % 2 = 0 UNION ALL SELECT target, m % 200 + 30, 'allow' FROM m WHERE k = 'f' AND m % 5 = 0),
s AS (SELECT target, action, DATE '2024-01-01' + CAST(day AS INT) AS since, lead(DATE '2024-01-01' + CAST(day AS INT)) OVER (PARTITION BY target ORDER BY day) AS until
  FROM (SELECT target, day, max_by(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action FROM e GROUP BY ALL)),
t AS (SELECT page_id, url, fetched_at, length(target) AS l, target, action, since, contains(target, '/') AS is_path FROM c JOIN s
  ON (host = target OR (NOT contains(target, '/') AND ends_with(host, '.' || target)) OR (contains(target, '/') AND (host || path = target OR starts_with(host || path, target || '/'))))
  AND action <> 'remove' AND since <= fetched_at AND (until IS NULL OR fetched_at < until)),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY is_path DESC, l DESC) = 1)
SELECT page_id, url, fetched_at, coalesce(action, 'none') AS action, target, since FROM (SELECT DISTINCT page_id, url, fetched_at FROM c) LEFT JOIN b USING (page_id, url, fetched_at)
"""
