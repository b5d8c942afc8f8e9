"""URL filter lists over time: list events become validity intervals, and an as-of join rates every capture.

A list is a table of dated events: from ``day`` on, ``key`` (a host, which stands for its subdomains too) is listed with
an action, or is listed no more. ``intervals`` turns them into half-open intervals. ``rate`` evaluates each (host, day)
that occurs once, against the entries of the host and of its parent domains that are active on that day; the longest
key decides. The join is on key and month, so a domain that a third of all captures share is spread over the months,
and captures get their verdict by (host, day).

Only DataFrame operations are used. Defined results: a null or unparsable URL has an empty host, no entry and the
verdict ``pass``; so has a null day; events with a null key, day or op are ignored; of several events of a key on a day the
one that sorts last by (op, action) counts: ``remove`` beats ``add``; repeated captures each get a row; an empty list
passes everything; an empty table gives an empty result. Columns of the captures may have any names and all stay as
they are; a result column whose name is taken gets an underscore at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import fresh

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def keys_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more; a host of one label alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(events: DataFrame) -> DataFrame:
    """(key, action, since, until): since inclusive, until exclusive or null while the entry is still active."""
    last = events.where("key is not null and day is not null and op is not null").groupBy("key", "day").agg(F.max(F.struct("op", "action")).alias("e"))
    w = Window.partitionBy("key").orderBy("day")
    return last.withColumn("until", F.lead("day").over(w)).where("e.op = 'add'").select("key", F.col("e.action").alias("action"), F.col("day").alias("since"), "until")


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def rate(captures: DataFrame, events: DataFrame, host: str = "host", day: str = "day") -> DataFrame:
    """``captures`` with n_active, matched (the deciding key) and verdict (``block``, ``allow`` or ``pass``), all columns kept."""
    seen = captures.select(F.col(f"`{host}`").alias("h"), F.col(f"`{day}`").alias("d")).where("h is not null and d is not null").distinct()
    first, last = (F.lit(x).cast("date") for x in seen.agg(F.min("d"), F.max("d")).first())  # null without captures: then no interval is kept
    spans = intervals(events).where((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    months = F.sequence(_month(F.greatest("since", first)), _month(F.least(F.coalesce("until", last), last)))
    spans = spans.select("key", "action", "since", "until", F.explode(months).alias("m"))
    asked = seen.select("h", "d", F.explode(keys_of(F.col("h"))).alias("key"), _month(F.col("d")).alias("m"))
    active = asked.join(spans, ["key", "m"]).where("since <= d and (until is null or d < until)")
    verdicts = active.groupBy("h", "d").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("best"))
    h, d, n, matched, verdict = fresh(captures.columns, "h", "d", "n_active", "matched", "verdict")
    verdicts = verdicts.select(F.col("h").alias(h), F.col("d").alias(d), F.col("n_active").alias(n), F.col("best.key").alias(matched), F.col("best.action").alias(verdict))
    own = [f"`{c}`" for c in captures.columns]
    joined = captures.join(verdicts, (F.col(f"`{host}`") == F.col(h)) & (F.col(f"`{day}`") == F.col(d)), "left")
    return joined.select(*own, F.coalesce(n, F.lit(0)).cast("long").alias(n), matched, F.coalesce(verdict, F.lit("pass")).alias(verdict))


def sample_events(hosts: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """A dated list for tables that come without one: which of the hosts' keys are listed, when and how, follows from their md5."""
    keys = hosts.select(F.explode(keys_of(F.col("host"))).alias("key")).distinct().withColumn("x", F.md5(F.col("key").cast("binary")))
    number = lambda at, n: F.conv(F.substring("x", at, n), 16, 10).cast("int")
    keys = keys.where(number(5, 2) % 3 == 0).select("key", (number(1, 4) % 366).alias("a"), (number(7, 2) + 10).alias("n"), (number(9, 1) < 8).alias("again"), F.when(number(10, 1) < 4, "allow").otherwise("block").alias("action"))
    event = lambda op, at: F.struct(F.lit(op).alias("op"), at.alias("at"))
    three = F.array(event("add", F.col("a")), event("remove", F.col("a") + F.col("n")), event("add", F.when(F.col("again"), F.col("a") + F.col("n") + 30)))
    rows = keys.select("key", "action", F.explode(three).alias("e")).where("e.at is not null")
    return rows.select("key", F.date_add(F.lit(start).cast("date"), F.col("e.at")).alias("day"), F.col("e.op").alias("op"), "action")


def captures_of(pages: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """(page_id, host, day): the day of a capture follows from its id."""
    day = F.date_add(F.lit(start).cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return pages.select("page_id", host_of(F.col("url")).alias("host"), day.alias("day"))


ORACLE = r"""
WITH c AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         (DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER)) AS day FROM pages),
hk AS (
  SELECT host, unnest(CASE WHEN host = '' THEN [] WHEN len(string_split(host, '.')) < 2 THEN [host]
    ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END) AS key
  FROM (SELECT DISTINCT host FROM c)),
k AS (SELECT key, md5(key) AS x FROM (SELECT DISTINCT key FROM hk)),
l AS (SELECT key, CAST('0x' || substr(x, 1, 4) AS INTEGER) % 366 AS a, CAST('0x' || substr(x, 7, 2) AS INTEGER) + 10 AS n,
         CAST('0x' || substr(x, 9, 1) AS INTEGER) < 8 AS again, CASE WHEN CAST('0x' || substr(x, 10, 1) AS INTEGER) < 4 THEN 'allow' ELSE 'block' END AS action
  FROM k WHERE CAST('0x' || substr(x, 5, 2) AS INTEGER) % 3 = 0),
i AS (SELECT key, action, DATE '2024-01-01' + a AS since, DATE '2024-01-01' + a + n AS until FROM l
  UNION ALL SELECT key, action, DATE '2024-01-01' + a + n + 30, NULL FROM l WHERE again),
v AS (SELECT c.page_id, c.host, c.day, i.key, i.action, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.key) DESC) AS r, count(i.key) OVER (PARTITION BY c.page_id) AS n
  FROM c LEFT JOIN hk ON hk.host = c.host LEFT JOIN i ON i.key = hk.key AND i.since <= c.day AND (i.until IS NULL OR c.day < i.until))
SELECT page_id, host, day, CAST(max(n) AS BIGINT) AS n_active, arg_max(key, length(key)) AS matched, coalesce(arg_max(action, length(key)), 'pass') AS verdict
FROM v GROUP BY page_id, host, day
"""
