"""Queries over the upkeep of a library."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import scalars as S
from folioscan.operators import library as L
from folioscan.operators import relational as R
from folioscan.plans.core import QUERIES, query
from folioscan.sources import metadata
from folioscan.sources.tables import load

__all__ = ["QUERIES"]


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), '') AS title, 'webpage' AS entry_type FROM pages")
def web_clip_entries(spark, d):
    """Entries of web pages that name no identifier."""
    clips = metadata.web_clip(load(spark, d, "pages"))
    return clips.select("page_id", "title", F.when(F.col("arxiv_id").isNotNull(), "preprint").otherwise("webpage").alias("entry_type"))


_IDS = "(SELECT p_partkey AS id, p_size % 7 = 0 AS trashed, 'doi:10.1/' || p_brand || p_size AS doi FROM part)"


@query(f"SELECT s_suppkey AS clip, min(id) AS duplicate FROM supplier JOIN {_IDS} p ON NOT p.trashed AND p.doi = 'doi:10.1/Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) || (s_suppkey % 50 + 1) GROUP BY s_suppkey")
def duplicate_entry(spark, d):
    """The smallest live entry with the same canonical identifier."""
    none = F.lit(None).cast("string")
    text = lambda *c: F.concat(*(x.cast("string") for x in c))
    entries = load(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 == 0).alias("trashed"), text(F.lit("doi:10.1/"), F.col("p_brand"), F.col("p_size")).alias("doi"), none.alias("arxiv_id"), none.alias("isbn"))
    clips = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text(F.lit("https://doi.org/10.1/Brand#"), F.col("s_suppkey") % 5 + 1, F.col("s_nationkey") % 5 + 1, F.col("s_suppkey") % 50 + 1).alias("doi"), none.alias("arxiv_id"), none.alias("isbn"))
    return L.find_duplicates(clips, entries)


@query("SELECT l_orderkey AS entry_id, CASE WHEN l_suppkey = 3 THEN 5 ELSE l_suppkey END AS author_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2")
def author_merge(spark, d):
    """Links after one author became another."""
    links = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_suppkey").alias("author_id"), F.col("l_linenumber").alias("position"))
    return L.merge_authors(links, 3, 5).select("entry_id", F.col("author_id").cast("long").alias("author_id"), "position")


@query("SELECT min(o_orderkey) AS position, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS key, any_value(c_custkey) AS id, any_value(c_custkey) IS NOT NULL AS found FROM orders LEFT JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') GROUP BY 2")
def key_lookup(spark, d):
    """Keys in the order they were asked for, with what they name."""
    asked = load(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("key"))
    return L.key_lookup(asked, load(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("id")))


@query("SELECT user_id AS node_id, arg_max(event_id, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 100000000000 + event_id) AS id FROM events GROUP BY user_id")
def preferred_alt_text(spark, d):
    """The user's text before generated ones, then the latest."""
    texts = load(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "user").otherwise("generated").alias("origin"))
    return L.preferred_alt_text(texts).select("node_id", "id")


@query("SELECT o_orderkey, o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1997-01-01' OR epoch(TIMESTAMP '1997-01-01') - epoch(o_orderdate) >= 86400 * 365 AS due FROM orders")
def interval_gate(spark, d):
    """Jobs that are due: a year old, or recorded in the future."""
    return load(spark, d, "orders").select("o_orderkey", S.interval_due(F.col("o_orderdate"), F.lit("1997-01-01").cast("timestamp"), 86400 * 365).alias("due"))


@query("SELECT CASE WHEN l_discount > 0.09 THEN 'drop' WHEN l_returnflag = 'R' OR l_tax > 0.06 THEN 'partial' ELSE 'sealed' END AS state, count(*) AS n FROM lineitem GROUP BY 1")
def save_rules(spark, d):
    """What runs leave behind."""
    li = load(spark, d, "lineitem")
    state = L.save_rule(F.col("l_returnflag") == "R", F.col("l_tax") > 0.06, F.when(F.col("l_discount") > 0.09, 0).otherwise(1))
    return li.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, before FROM (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(coalesce(sum(length(l_linestatus || l_returnflag)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lineitem) WHERE before < 20")
def table_listing_budget(spark, d):
    """Rows of each key until a budget is spent, in a total order."""
    rows = load(spark, d, "lineitem").withColumn("t", F.concat("l_linestatus", "l_returnflag")).withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return R.budget(rows, "l_suppkey", "o", "t", 20).select("l_suppkey", "l_orderkey", "before")
