"""URL filters as a temporal list join, in DataFrame operations alone.

List entries are dated: (key, action, since), where action is deny, allow or remove. Each entry holds until the next one of its key,
so entries become intervals. A capture has the keys of its URL: the host and each parent domain ("host.example.org", "example.org",
"org"), each path prefix of the host ("host/a", "host/a/b", ending in "/" where a segment does), and all URLs ("*"). It meets the entries that held when it was
fetched; the most specific decides. Captures without one pass.

The list is joined by key with the interval as a condition; Spark may split skewed keys, or broadcast the list if its written size
is small. Matches go back by (id, url, time).

Defined results: a null url has only the key "*"; a null time meets nothing; of entries with equal key and time the last in the order
allow, deny, remove holds; rows equal in id, url and time get equal results; empty tables work; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramframe.llm.common import cut, once, sized


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of deny and allow entries; until is null for those that still hold."""
    rows = entries.where("key is not null and since is not null").groupBy(F.lower("key").alias("key"), "since").agg(F.max("action").alias("action"))
    next_one = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return rows.withColumn("until", next_one).where("action in ('deny', 'allow')").select("key", "action", "since", "until")


def keys(url: Column) -> Column:
    """All keys of a URL."""
    text = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)

    def all_keys(of: Column) -> Column:
        host, path, labels, parts = (of[c] for c in ("host", "path", "labels", "parts"))
        domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        prefixes = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
        return F.when(host == "", F.array(F.lit("*"))).otherwise(F.array_distinct(F.concat(F.array(F.lit("*")), domains, prefixes, F.array(F.concat(host, path)))))

    split = lambda of: F.struct(of["host"].alias("host"), of["path"].alias("path"), F.split(of["host"], r"\.").alias("labels"), F.split(of["path"], "/").alias("parts"))
    return once(F.struct(host.alias("host"), path.alias("path")), lambda of: once(split(of), all_keys))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "time") -> DataFrame:
    """(id, url, time, matched_key, matched_action, since, blocked) of each capture."""
    lists = cut(intervals(entries), "intervals")
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("time"))
    asked = rows.where("time is not null").select("id", "url", "time", F.explode(keys(F.col("url"))).alias("key"))
    held = (F.col("since") <= F.col("time")) & (F.col("until").isNull() | (F.col("time") < F.col("until")))
    met = asked.join(sized(lists), "key").where(held)
    best = met.groupBy("id", "url", "time").agg(F.max(F.struct(F.when(F.col("key") == "*", 0).otherwise(F.length("key")).alias("n"), "key", "action", "since")).alias("best"))
    best = best.select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("time").alias("t"), "best")
    joined = rows.join(best, rows["id"].eqNullSafe(F.col("i")) & rows["url"].eqNullSafe(F.col("u")) & (rows["time"] == F.col("t")), "left")
    return joined.select("id", rows["url"], rows["time"], F.col("best.key").alias("matched_key"), F.col("best.action").alias("matched_action"), F.col("best.since").alias("since"), F.coalesce(F.col("best.action") == "deny", F.lit(False)).alias("blocked"))


#: A dated list for the query: domains and paths of the synthetic pages; seconds since 1970.
ENTRIES = """VALUES
 ('spam-farm.example.org', 'deny', 1704067200), ('spam-farm.example.org', 'remove', 1719792000), ('spam-farm.example.org', 'deny', 1725148800),
 ('example.net', 'deny', 1709251200), ('example.net', 'remove', 1711929600), ('tionsh.example.net', 'allow', 1709510400), ('tionsh.example.net', 'deny', 1714521600), ('tionsh.example.net', 'remove', 1717200000),
 ('ththth.example.org', 'deny', 1706745600), ('blog.ththth.example.org', 'allow', 1709251200), ('blog.ththth.example.org', 'remove', 1712000000),
 ('tionsh.example.net/de/', 'deny', 1704067200), ('tionsh.example.net/en/', 'deny', 1730419200), ('blog.tionsh.example.net/es/', 'deny', 1720000000), ('blog.tionsh.example.net/es/', 'allow', 1728000000),
 ('tiontion.example.com', 'deny', 1722470400), ('m.tiontion.example.com', 'allow', 1725148800), ('*', 'deny', 1735000000)"""


def query(spark, sf_dir: str) -> DataFrame:
    """The entry that decides on each page as of its time of capture, a second of 2024 fixed by the id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", (F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(31622400))).cast("long").alias("time"))
    entries = spark.sql(f"SELECT col1 AS key, col2 AS action, CAST(col3 AS BIGINT) AS since FROM {ENTRIES}")
    return evaluate(pages, entries).withColumnsRenamed({"id": "page_id", "time": "fetch_time"})


ORACLE_SQL = f"""
WITH e AS (SELECT col0 AS key, col1 AS action, CAST(col2 AS BIGINT) AS since FROM ({ENTRIES})),
i AS (SELECT key, action, since, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM e),
p AS (SELECT page_id, url, CAST(1704067200 + (page_id * 7919) % 31622400 AS BIGINT) AS fetch_time,
  regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.*, i.key, i.action, i.since, row_number() OVER (PARTITION BY page_id, url ORDER BY CASE WHEN key = '*' THEN 0 ELSE length(key) END DESC) AS rank
  FROM p JOIN i ON i.action IN ('deny', 'allow') AND i.since <= fetch_time AND (until IS NULL OR fetch_time < until)
   AND (key = '*' OR host = key OR ends_with(host, '.' || key) OR (contains(key, '/') AND starts_with(host || path, key) AND (ends_with(key, '/') OR host || path = key))))
SELECT p.page_id, p.url, p.fetch_time, m.key AS matched_key, m.action AS matched_action, m.since, coalesce(m.action = 'deny', false) AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url IS NOT DISTINCT FROM m.url AND rank = 1
"""
