"""Filters, joins, aggregates, order and set operations over library datasets, parametrised by column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compound_filter(entries: DataFrame, types: Sequence[str] = (), low: int | None = None, high: int | None = None, starred: bool | None = None, with_rows: DataFrame | None = None, without_rows: DataFrame | None = None, size: str = "size") -> DataFrame:
    """The AND of all axes that are given; a null size fails a range. ``with_rows`` and ``without_rows`` hold ids."""
    out = entries
    if types:
        out = out.where(F.col("entry_type").isin(*types))
    if low is not None:
        out = out.where(F.col(size) >= low)
    if high is not None:
        out = out.where(F.col(size) <= high)
    if starred is not None:
        out = out.where(F.col("starred") if starred else ~F.col("starred"))
    if with_rows is not None:
        out = out.join(with_rows, "id", "left_semi")
    if without_rows is not None:
        out = out.join(without_rows, "id", "left_anti")
    return out


def tagged(entries: DataFrame, tags: DataFrame, wanted: Sequence[str], match_all: bool) -> DataFrame:
    """Entries with any, or with every, of the tags; ``tags`` is (entry_id, tag)."""
    hits = tags.where(F.col("tag").isin(*wanted))
    if match_all:
        hits = hits.groupBy("entry_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(wanted)))
    return entries.join(hits.select(F.col("entry_id").alias("id")), "id", "left_semi")


def scoped(entries: DataFrame, view: str, tags: DataFrame | None = None) -> DataFrame:
    """The view ``live``, ``trash``, ``starred`` or ``unfiled`` (live without a tag)."""
    if view == "trash":
        return entries.where("trashed")
    live = entries.where("not trashed")
    if view == "starred":
        return live.where("starred")
    if view == "unfiled":
        return live.join(tags.select(F.col("entry_id").alias("id")), "id", "left_anti")
    return live


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row with the largest version."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), version).alias("r")).select("r.*")


def best(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row in ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def conflict_pairs(rows: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """Pairs of rows that share a value of any of ``keys``, without nulls: the keys become rows and join on equality."""
    each = rows.select(F.col(ident).alias("id"), F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), F.col(k).cast("string").alias("value")) for k in keys))).alias("k")).where("k.value is not null").select("id", "k.scheme", "k.value").distinct()
    a, b = each.withColumnRenamed("id", "a"), each.withColumnRenamed("id", "b")
    return a.join(b, ["scheme", "value"]).where("a < b").select("a", "b").distinct()


def undirected(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Every edge from both of its ends: (node, other, direction)."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("other"), F.lit("out").alias("direction"))
    return out.union(edges.select(F.col(target), F.col(source), F.lit("in")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it doesn't have."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def budget(rows: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Of each key the rows, in order, before which fewer than ``most`` characters stand."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(F.char_length(text)).over(ahead), F.lit(0)).cast("long")).where(F.col("before") < most)


def tree_paths(nodes: DataFrame, ident: str, parent: str, name: str, most_depth: int = 32) -> DataFrame:
    """(id, name, path, depth) of a forest: a node without a parent in ``nodes`` is a root, and a cycle has no path.

    Level by level joins; as deep as the tree is, ``most_depth`` at most.
    """
    n = nodes.select(F.col(ident).alias("id"), F.col(parent).alias("parent"), F.col(name).alias("name"))
    level = n.join(n.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "name", F.col("name").alias("path"), F.lit(0).alias("depth"))
    out = level
    for _ in range(most_depth):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"), "depth")
        level = n.join(up, "parent").select("id", "name", F.concat_ws("/", "above", "name").alias("path"), (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"the tree is deeper than {most_depth}")


def positions(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``position`` of each row in its group, from 0."""
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
