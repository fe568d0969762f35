"""URL filters as a temporal list join (operator 7).

Lists are dated: an entry says that from a day on a rule is listed, or no longer
listed. Per rule, consecutive entries become validity intervals [from, to). A
capture is judged by the rules in force on the day it was fetched (as-of join),
not by today's lists.

Rules name a domain (it covers its subdomains) or a URL prefix of whole path
segments. A capture has one key per parent domain and per path prefix, so
matching is an equality join; its time condition is kept small by month bins
that an interval is spread over. Distinct (key, day) pairs are joined, not
captures: a host that a third of all captures share costs one row per day
before any list is consulted, and no pair of captures ever meets.

The most specific matching rule decides (the longest key; on a tie a prefix
before a domain, an allowing list before a blocking one, then list name).

Defined results: null or unusable URLs and null days match nothing ('none');
several entries of one rule on one day count as a removal if any removes it;
entries without list, rule or day are ignored; an interval without an end is in
force from its day on; repeated captures are judged each; empty tables give
'none' or no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

AUTHORITY = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lowercase host without port, user or a final dot; empty if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), AUTHORITY, 1), F.lit("."))


def domain_keys(host: Column) -> Column:
    """The host and its parents of at least two labels."""
    parts = F.split(host, r"\.")
    ends = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    keys = F.transform(ends, lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def prefix_keys(url: Column, host: Column) -> Column:
    """Host and every run of leading path segments; scheme and host in lower case, the path as it is."""
    lead = F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)" + PATH, 1)
    segments = F.array_remove(F.split(lead, "/"), "")
    ends = F.sequence(F.lit(1), F.size(segments))
    keys = F.transform(ends, lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    return F.when((host != "") & (F.size(segments) > 0), keys).otherwise(F.array().cast("array<string>"))


def rule_key(kind: Column, value: Column) -> Column:
    return F.when(kind == "domain", F.concat(F.lit("d:"), F.lower(value))).when(kind == "prefix", F.concat(F.lit("p:"), value))


def validity(entries: DataFrame) -> DataFrame:
    """Entries (list, action, kind, value, day, listed) -> intervals (list, action, key, from_day, to_day or null)."""
    known = entries.select("list", "action", rule_key(F.col("kind"), F.col("value")).alias("key"), F.col("day").cast("date").alias("day"), "listed")
    known = known.where("list is not null and action is not null and key is not null and day is not null and listed is not null")
    daily = known.groupBy("list", "action", "key", "day").agg(F.min("listed").alias("listed"))
    following = F.lead("day").over(Window.partitionBy("list", "action", "key").orderBy("day"))
    return daily.withColumn("to_day", following).where("listed").select("list", "action", "key", F.col("day").alias("from_day"), "to_day")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(url, day, matches, verdict, rule, list) for every distinct (url, day) of ``captures`` with a match."""
    seen = captures.select(F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day")).where("url is not null and day is not null")
    keyed = seen.distinct().withColumn("host", host_of(F.col("url")))
    keyed = keyed.select("url", "day", F.explode(F.concat(domain_keys(F.col("host")), prefix_keys(F.col("url"), F.col("host")))).alias("key"))
    keyed = written(keyed, "capture-keys")
    asked = keyed.select("key", "day").distinct().withColumn("month", F.trunc("day", "MM"))

    last = keyed.agg(F.max("day")).first()[0]
    until = F.least(F.coalesce(F.date_sub("to_day", 1), F.lit(last)), F.lit(last).cast("date"))
    spread = validity(entries).where(F.col("from_day") <= F.lit(last).cast("date")).withColumn("until", until).where("until >= from_day")
    months = F.sequence(F.trunc("from_day", "MM"), F.trunc("until", "MM"), F.expr("interval 1 month"))
    spread = spread.withColumn("month", F.explode(months))
    in_force = (F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day")))
    rules = F.struct(
        F.length("key").alias("size"), F.col("key").startswith("p:").alias("prefix"), (F.col("action") == "allow").alias("allows"),
        F.col("action").alias("action"), F.col("key").alias("key"), F.col("list").alias("list"),
    )
    better = F.struct(-F.length("key"), ~F.col("key").startswith("p:"), F.col("action") != "allow", "list", "key")
    per_key = asked.join(spread, ["key", "month"]).where(in_force).groupBy("key", "day").agg(
        F.count("*").alias("n"), F.min_by(rules, better).alias("best")
    )
    hits = keyed.join(per_key, ["key", "day"])
    order = F.struct(-F.col("best.size"), ~F.col("best.prefix"), ~F.col("best.allows"), F.col("best.list"), F.col("best.key"))
    return hits.groupBy("url", "day").agg(F.sum("n").alias("matches"), F.min_by("best", order).alias("best")).select(
        "url", "day", "matches", F.col("best.action").alias("verdict"), F.col("best.key").alias("rule"), F.col("best.list").alias("list")
    )


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(id, url, fetched_on, matches, verdict, rule, list) for every row of ``captures``."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), F.col(day_col).cast("date").alias("d"))
    found = judge(captures, entries, url_col, day_col)
    joined = rows.join(found, (rows["u"] == found["url"]) & (rows["d"] == found["day"]), "left")
    return joined.select(
        F.col("id").alias(id_col), F.col("u").alias("url"), F.col("d").alias("fetched_on"), F.coalesce("matches", F.lit(0)).alias("matches"),
        F.coalesce("verdict", F.lit("none")).alias("verdict"), "rule", "list",
    )


def fetched(pages: DataFrame) -> DataFrame:
    """The given pages have no fetch day; every page gets one of 366 by its id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id * 7919, 366) as int))").alias("fetched_on"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """List entries derived from all pages: per host, parent domain and first path segment, dated by the smallest page id.

    Blocking lists take every second domain and third prefix; some entries are lifted after 60 days and some of
    those listed again 30 days later. An allowing list names every fifth host.
    """
    hosts = pages.select("page_id", "url", host_of(F.col("url")).alias("host")).where("host <> '' and page_id is not null")
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    first = F.get(F.filter(prefix_keys(F.col("url"), F.col("host")), lambda k: F.lit(True)), F.lit(0))
    named = hosts.select("page_id", F.col("host").alias("value"), F.lit("domain").alias("kind"))
    named = named.unionByName(hosts.select("page_id", parent.alias("value"), F.lit("domain").alias("kind")).where("value <> ''"))
    named = named.unionByName(hosts.select("page_id", F.substring(first, 3, 1 << 30).alias("value"), F.lit("prefix").alias("kind")).where("value is not null"))
    rules = named.groupBy("kind", "value").agg(F.min("page_id").alias("m"))
    start = F.expr("date_add(DATE'2023-12-01', cast(pmod(m * 31, 300) as int))")
    block = rules.where("(kind = 'domain' and m % 2 = 0) or (kind = 'prefix' and m % 3 = 0)").select(
        F.concat(F.lit("block-"), "kind").alias("list"), F.lit("block").alias("action"), "kind", "value", "m", start.alias("day")
    )
    allow = rules.where("kind = 'domain' and m % 5 = 0").select(F.lit("trusted").alias("list"), F.lit("allow").alias("action"), "kind", "value", "m", start.alias("day"))
    listed = block.unionByName(allow)
    steps = F.array(
        F.struct(F.col("day").alias("day"), F.lit(True).alias("listed")),
        F.when(F.col("m") % 4 == 0, F.struct(F.date_add("day", 60).alias("day"), F.lit(False).alias("listed"))),
        F.when(F.col("m") % 8 == 0, F.struct(F.date_add("day", 90).alias("day"), F.lit(True).alias("listed"))),
    )
    return listed.select("list", "action", "kind", "value", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("x")).select(
        "list", "action", "kind", "value", "x.day", "x.listed"
    )


def pages_through_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_captures(fetched(pages), dated_lists(pages))


#: DuckDB statement of the registered query.
ORACLE = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched_on,
         rtrim(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS seg
  FROM pages),
k AS (
  SELECT page_id, fetched_on, 'd:' || array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM (SELECT *, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM c WHERE host <> '')
  UNION ALL
  SELECT page_id, fetched_on, 'p:' || host || '/' || array_to_string(seg[1:i], '/') AS key
  FROM (SELECT *, unnest(generate_series(1, len(seg))) AS i FROM c WHERE host <> '')),
named AS (
  SELECT page_id, 'domain' AS kind, host AS value FROM c WHERE host <> ''
  UNION ALL SELECT page_id, 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c WHERE host <> '' AND regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
  UNION ALL SELECT page_id, 'prefix', host || '/' || seg[1] FROM c WHERE host <> '' AND len(seg) > 0),
rules AS (SELECT kind, value, min(page_id) AS m, DATE '2023-12-01' + CAST((min(page_id) * 31) % 300 AS INTEGER) AS day FROM named GROUP BY kind, value),
listed AS (
  SELECT 'block-' || kind AS list, 'block' AS action, kind, value, m, day FROM rules WHERE (kind = 'domain' AND m % 2 = 0) OR (kind = 'prefix' AND m % 3 = 0)
  UNION ALL SELECT 'trusted', 'allow', kind, value, m, day FROM rules WHERE kind = 'domain' AND m % 5 = 0),
entries AS (
  SELECT list, action, left(kind, 1) || ':' || value AS key, day, true AS on_list FROM listed
  UNION ALL SELECT list, action, left(kind, 1) || ':' || value, day + 60, false FROM listed WHERE m % 4 = 0
  UNION ALL SELECT list, action, left(kind, 1) || ':' || value, day + 90, true FROM listed WHERE m % 8 = 0),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, action, key ORDER BY day) AS to_day FROM entries),
m AS (
  SELECT page_id, key, list, action, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, key LIKE 'p:%' DESC, action = 'allow' DESC, list, key) AS r,
         count(*) OVER (PARTITION BY page_id) AS matches
  FROM k JOIN spans USING (key) WHERE on_list AND fetched_on >= day AND (to_day IS NULL OR fetched_on < to_day))
SELECT c.page_id, url, fetched_on, coalesce(matches, 0)::BIGINT AS matches, coalesce(action, 'none') AS verdict, key AS rule, list
FROM c LEFT JOIN m ON m.page_id = c.page_id AND r = 1
"""
