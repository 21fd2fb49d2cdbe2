"""URL filters as a temporal list join.

Block lists are dated: an entry is added on one day and may be removed on another.  Dated events of
an entry become half-open validity intervals, and an as-of join evaluates every capture against the
entries that were valid when it was fetched.  Entries name a domain (with all its subdomains) or a
host and path prefix.  Everything is DataFrame functions: no Python runs on the executors.

The join is an equi-join on (kind, key, period): intervals are spread over periods of
``period_days``, and lookups are distinct (kind, key, day) triples, so a host with a third of all
captures is looked up once a day.  No list is broadcast by hand.

Defined results: a null url, a url without host and a null fetch day match nothing; an empty list
matches nothing; of events of one entry on one day a removal wins; repeated events and repeated
captures count once, captures come back as often as they are; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 128


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_to) from ``events(list, kind, key, day, action)``.

    ``action`` is 'add' or 'remove'; valid_to is exclusive and null while the entry is still valid.
    """
    day = events.groupBy("list", "kind", "key", "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("gone"))
    order = Window.partitionBy("list", "kind", "key").orderBy("day")
    turns = day.withColumn("before", F.lag("gone", 1, 1).over(order)).where("gone <> before")
    return turns.withColumn("valid_to", F.lead("day").over(order)).where("gone = 0").select("list", "kind", "key", F.col("day").alias("valid_from"), "valid_to")


def with_keys(df: DataFrame, url_col: str, depth: int) -> DataFrame:
    """``df`` with ``host`` and ``lookups``: the (kind, key) pairs under which an entry may name the url.

    ``depth`` is the number of path parts of the deepest prefix on any list.
    """
    url = F.trim(F.col(url_col).cast("string"))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rows = df.withColumn("host", F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))).withColumn("_p", F.filter(F.split(path, "/"), lambda x: x != "")).withColumn("_l", F.split("host", "\\."))
    domains = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("_l", i, F.size("_l")), ".").alias("key")))
    deepest = F.least(F.size("_p"), F.lit(depth))
    prefix = lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.col("host"), F.array_join(F.slice("_p", F.lit(1), i), "/")).alias("key"))
    prefixes = F.when(deepest > 0, F.transform(F.sequence(F.lit(1), deepest), prefix)).otherwise(F.expr("array()").cast("array<struct<kind:string,key:string>>"))
    return rows.withColumn("lookups", F.when(F.col("host").isNotNull(), F.concat(domains, prefixes))).drop("_p", "_l")


def evaluate(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetched", period_days: int = PERIOD_DAYS) -> DataFrame:
    """``captures`` with ``host`` and ``lists``: the sorted names of the lists that block the capture.

    Columns of ``captures`` that already have these two names are replaced.
    """
    valid = intervals(events)
    depth = valid.where("kind = 'prefix'").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    period = lambda c: F.floor(F.unix_date(c) / period_days)
    last = captures.agg(F.max(F.col(day_col).cast("date"))).first()[0]
    horizon = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
    spread = valid.where(F.col("valid_from") <= F.lit(last)).withColumn("period", F.explode(F.sequence(period(F.col("valid_from")), period(horizon))))
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns if c not in ("host", "lists")]).alias("_row"), F.col(url_col).cast("string").alias("_url"), F.col(day_col).cast("date").alias("_day"))
    keyed = with_keys(rows.select("_url", "_day").where("_day IS NOT NULL").distinct(), "_url", depth)
    probes = keyed.select("_url", "_day", F.explode("lookups").alias("x")).select("_url", "_day", "x.*")
    asked = probes.select("kind", "key", "_day").distinct().withColumn("period", period(F.col("_day")))
    active = asked.join(spread, ["kind", "key", "period"]).where("_day >= valid_from AND (valid_to IS NULL OR _day < valid_to)").select("kind", "key", "_day", "list")
    found = probes.join(active, ["kind", "key", "_day"]).groupBy("_url", "_day").agg(F.array_sort(F.collect_set("list")).alias("_lists"))
    out = with_keys(rows, "_url", 0).drop("lookups").join(found, ["_url", "_day"], "left")
    return out.select("_row.*", F.col("host"), F.coalesce("_lists", F.expr("array()").cast("array<string>")).alias("lists"))


def fetch_day(id_col: str = "page_id") -> F.Column:
    """The test tables carry no fetch times: a day in 2023 or 2024 by rule from the id."""
    return F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col(id_col) * 37, F.lit(730)).cast("int"))


def host_events(pages: DataFrame) -> DataFrame:
    """The test tables carry no lists: dated entries by rule from the hosts and first path parts.

    By the MD5 of its key an entry is on a list or not, its dates likewise; every second one is
    removed after 90 to 345 days.
    """
    keyed = with_keys(pages.select("url"), "url", 1).where("host IS NOT NULL").select(F.explode("lookups").alias("x")).select("x.*").where("key LIKE '%.%.%' OR kind = 'prefix'").distinct()
    number = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 4), 16, 10).cast("bigint")
    listed = keyed.withColumn("a", number(1)).withColumn("b", number(5)).withColumn("c", number(9)).where(F.when(F.col("kind") == "domain", F.col("a") % 4 == 0).otherwise(F.col("a") % 6 == 0))
    name = F.when(F.col("kind") == "prefix", F.lit("spam")).when(F.col("b") % 3 == 0, F.lit("adult")).otherwise(F.lit("malware"))
    start = F.date_add(F.lit("2022-10-01").cast("date"), (F.col("b") % 600).cast("int"))
    added = listed.select(name.alias("list"), "kind", "key", start.alias("day"), F.lit("add").alias("action"))
    removed = listed.where("c % 2 = 0").select(name.alias("list"), "kind", "key", F.date_add(start, (F.col("c") % 256 + 90).cast("int")).alias("day"), F.lit("remove").alias("action"))
    return added.union(removed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = evaluate(pages.withColumn("fetched", fetch_day()), host_events(pages))
    return out.select("page_id", F.col("fetched").cast("string").alias("fetched"), "host", F.size("lists").cast("bigint").alias("n_lists"), F.array_join("lists", ",").alias("lists"), (F.size("lists") > 0).alias("blocked"))


SQL = r"""
WITH u AS (SELECT page_id, DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INT) AS fetched, trim(url) AS url FROM pages),
h AS (SELECT page_id, fetched, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host,
      list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM u),
k AS (SELECT page_id, fetched, 'domain' AS kind, array_to_string(l[i:], '.') AS key FROM (SELECT page_id, fetched, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(host, '.') AS l FROM h WHERE host IS NOT NULL))
      UNION ALL SELECT page_id, fetched, 'prefix', host || '/' || p[1] FROM h WHERE host IS NOT NULL AND len(p) > 0),
n AS (SELECT kind, key, ('0x' || substr(md5(key), 1, 4))::BIGINT AS a, ('0x' || substr(md5(key), 5, 4))::BIGINT AS b, ('0x' || substr(md5(key), 9, 4))::BIGINT AS c
      FROM (SELECT DISTINCT kind, key FROM k WHERE key LIKE '%.%.%' OR kind = 'prefix')),
v AS (SELECT kind, key, CASE WHEN kind = 'prefix' THEN 'spam' WHEN b % 3 = 0 THEN 'adult' ELSE 'malware' END AS list,
      DATE '2022-10-01' + CAST(b % 600 AS INT) AS valid_from, CASE WHEN c % 2 = 0 THEN DATE '2022-10-01' + CAST(b % 600 + c % 256 + 90 AS INT) END AS valid_to
      FROM n WHERE CASE WHEN kind = 'domain' THEN a % 4 = 0 ELSE a % 6 = 0 END),
m AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(DISTINCT list) AS n_lists
      FROM k JOIN v USING (kind, key) WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) GROUP BY page_id)
SELECT page_id, CAST(fetched AS VARCHAR) AS fetched, host, CAST(coalesce(n_lists, 0) AS BIGINT) AS n_lists, coalesce(lists, '') AS lists, coalesce(n_lists, 0) > 0 AS blocked FROM h LEFT JOIN m USING (page_id)
"""
