"""Writes and listings of a library as rewrites of datasets: keys, links, alternative texts, garbage, settings, exports, tool results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import scalars as S


def key_available(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(row, available) for (row, key, exclude): no other entry has the sanitised key; a key of which nothing is left is free."""
    wanted = asked.select("row", S.sanitize_citation_key("key").alias("k"), "exclude")
    taken = entries.where("citation_key is not null").select(F.col("citation_key").alias("k"), "id")
    hit = wanted.join(taken, "k").where("exclude is null or id <> exclude").select("row").distinct().withColumn("hit", F.lit(True))
    return wanted.join(hit, "row", "left").select("row", F.col("hit").isNull().alias("available"))


def author_links(inputs: DataFrame, known: DataFrame, resolve: DataFrame) -> DataFrame:
    """(entry_id, author_id, position) for (entry_id, authors, author_ids, names): structured people go before ids before names.

    ``resolve`` is (name, author_id) for everyone named, ``known`` (id) the authors there are; ids that don't exist are passed
    over and leave no gap.
    """
    use_ids = F.col("authors").isNull() & (F.size(F.coalesce("author_ids", F.array().cast("array<bigint>"))) > 0)
    by_id = inputs.where(use_ids).select("entry_id", F.posexplode("author_ids").alias("at", "author_id")).join(known.select(F.col("id").alias("author_id")), "author_id", "left_semi")
    by_name = inputs.where(~use_ids).select("entry_id", F.posexplode(F.coalesce("authors", "names")).alias("at", "name")).join(resolve, "name")
    rows = by_id.select("entry_id", "at", "author_id").unionByName(by_name.select("entry_id", "at", "author_id"))
    return rows.select("entry_id", "author_id", (F.row_number().over(Window.partitionBy("entry_id").orderBy("at")) - 1).cast("long").alias("position"))


def latest_done(versions: DataFrame) -> DataFrame:
    """(attachment_id, version): of each attachment the latest version that was completed, with warnings or without."""
    return versions.where(F.col("status").isin("completed", "completed_with_warnings")).groupBy("attachment_id").agg(F.max("version").alias("version"))


def insert_if_latest(texts: DataFrame, versions: DataFrame, assets: DataFrame) -> DataFrame:
    """The alternative texts (version, sha256, …) whose version is still the latest of its attachment and still has that image."""
    return texts.join(latest_done(versions).select("version"), "version", "left_semi").join(assets.select("version", "sha256"), ["version", "sha256"], "left_semi")


def prune_carried(texts: DataFrame, versions: DataFrame, assets: DataFrame, keep: DataFrame) -> DataFrame:
    """``texts`` without generated ones of other versions of an attachment whose image the version to ``keep`` (attachment_id, version) has."""
    held = keep.join(assets.select("version", "sha256"), "version").select("attachment_id", F.col("version").alias("kept"), "sha256").distinct()
    owner = versions.select("version", "attachment_id")
    gone = texts.where("origin = 'generated'").join(owner, "version").join(held, ["attachment_id", "sha256"]).where("version <> kept").select("id").distinct()
    return texts.join(gone, "id", "left_anti")


def collect_garbage(versions: DataFrame, texts: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions and children after a sweep. A version goes if it is superseded, an attachment's completed sibling lives on, no alternative
    text hangs on it, and it has children left; one that texts were carried from stays as a ``tombstone`` without children."""
    live = latest_done(versions).select("attachment_id").distinct()
    held = texts.select("version").distinct()
    targets = versions.where("status = 'superseded'").join(live, "attachment_id", "left_semi").join(held, "version", "left_anti").join(children.select("version").distinct(), "version", "left_semi").select("version")
    source = texts.where("carried_from is not null").select(F.col("carried_from").alias("version"), F.lit(True).alias("source")).distinct()
    marked = versions.join(targets.withColumn("gone", F.lit(True)), "version", "left").join(source, "version", "left")
    kept = marked.where("gone is null or source").withColumn("status", F.when(F.col("gone"), "tombstone").otherwise(F.col("status"))).select(*versions.columns)
    return kept, children.join(targets, "version", "left_anti")


def restore(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, outcome) for each asked id: ``restored``, ``conflict`` where a live entry has its key, ``not_trashed`` or ``unknown``.

    Of several that would restore the same key the smallest id gets it.
    """
    live = entries.where("not trashed and citation_key is not null").select("citation_key", F.lit(True).alias("taken")).distinct()
    rows = asked.select("id").distinct().join(entries.select("id", "citation_key", "trashed"), "id", "left").join(live, "citation_key", "left")
    first = F.row_number().over(Window.partitionBy("citation_key", "trashed").orderBy("id"))
    outcome = F.when(F.col("trashed").isNull(), "unknown").when(~F.col("trashed"), "not_trashed").when(F.col("taken") | (F.col("citation_key").isNotNull() & (F.col("n") > 1)), "conflict").otherwise("restored")
    return rows.withColumn("n", first).select("id", outcome.alias("outcome"))


def set_settings(old: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``old`` (key, value) with all pairs, the last of a key winning; with a null key or value nothing is written at all."""
    if any(k is None or v is None for k, v in pairs):
        raise ValueError("a setting needs a key and a value")
    new = old.sparkSession.createDataFrame(sorted(dict(pairs).items()), "key string, value string")
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def replace_identifiers(old: DataFrame, new: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identifiers (author_id, scheme, value) and authors after a full replacement for the authors that ``new`` names.

    Blank schemes and values are skipped; an author's ORCID column follows its identifier of that scheme.
    """
    good = new.where("trim(scheme) <> '' and trim(value) <> ''").select("author_id", F.lower(F.trim("scheme")).alias("scheme"), F.trim("value").alias("value"))
    good = good.groupBy("author_id", "scheme").agg(F.max("value").alias("value"))
    touched = new.select("author_id").distinct()
    ids = old.join(touched, "author_id", "left_anti").unionByName(good)
    orcid = touched.join(good.where("scheme = 'orcid'").select("author_id", S.normalize_orcid("value").alias("o")), "author_id", "left").select(F.col("author_id").alias("id"), "o", F.lit(True).alias("t"))
    changed = authors.join(orcid, "id", "left").withColumn("orcid", F.when(F.col("t"), F.col("o")).otherwise(F.col("orcid"))).select(*authors.columns)
    return ids, changed


def highlights(rows: DataFrame, owner: str, value: int) -> DataFrame:
    """Highlights of an entry or attachment by page, from the top of the page down, then by id."""
    return rows.where(F.col(owner) == value).orderBy("page", F.desc("y"), "id")


def node_regions(nodes: DataFrame, versions: DataFrame, fragments: DataFrame) -> DataFrame:
    """(node, attachment_id, source, page, x, y, w, h): where each node stands, by its primary fragment; null without one."""
    first = fragments.groupBy("node").agg(F.min(F.struct((~F.col("primary")).alias("p"), "reading_order", "id", "page", "x", "y", "w", "h")).alias("f"))
    out = nodes.select("node", "version").join(versions.select("version", "attachment_id", "source"), "version").join(first, "node", "left")
    return out.select("node", "attachment_id", "source", "f.page", "f.x", "f.y", "f.w", "f.h")


def of_version(children: DataFrame, nodes: DataFrame, version: int, order: Sequence[str]) -> DataFrame:
    """Rows that hang on the nodes of a version, in a stable order."""
    return children.join(nodes.where(F.col("version") == version).select("node"), "node", "left_semi").orderBy(*order)


def export_by_keys(keyed: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (key, …, place) with an asked key in the library's order, and (position, key, found) for each different key."""
    first = asked.groupBy("key").agg(F.min("position").alias("position"))
    found = first.join(keyed.select("key", F.lit(True).alias("f")), "key", "left").select("position", "key", F.coalesce("f", F.lit(False)).alias("found"))
    return keyed.join(first.select("key"), "key", "left_semi").orderBy("place"), found


def library_json(entries: DataFrame, links: DataFrame, authors: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, json) of all entries, trashed ones too, with their people in order and tags; to be written by id."""
    people = links.join(authors.select(F.col("id").alias("author_id"), "name"), "author_id").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("authors"))
    named = tags.groupBy("entry_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    out = entries.withColumn("entry_id", F.col("id")).join(people, "entry_id", "left").join(named, "entry_id", "left")
    none = F.array().cast("array<string>")
    fields = [F.col(c) for c in entries.columns] + [F.coalesce(F.transform("authors", lambda a: a["name"]), none).alias("authors"), F.coalesce("tags", none).alias("tags")]
    return out.select("id", F.to_json(F.struct(*fields)).alias("json")).orderBy("id")


def replace_text(rows: DataFrame, column: str, order: str, path: str) -> None:
    """Replace the text file at ``path`` in whole: it is written beside it and then renamed, so readers see the old or the new one."""
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.orderBy(order).select(F.col(column).alias("value")).write.text(staged)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(staged + ".old")
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        raise OSError(f"{staged} could not be renamed to {path}")
    fs.delete(aside, True)


def read_log(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The latest ``n`` rows of an append-only log, the newest first."""
    return spark.read.parquet(path).orderBy(F.desc("id")).limit(n)


def add_tags(tags: DataFrame, entries: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags (entry_id, tag) after (entry_id, tag) were asked for, and (outcome, n): added, already there, no such live entry."""
    live = entries.where("not trashed").select(F.col("id").alias("entry_id"), F.lit(True).alias("live"))
    rows = asked.distinct().join(live, "entry_id", "left").join(tags.withColumn("there", F.lit(True)).distinct(), ["entry_id", "tag"], "left")
    rows = rows.withColumn("outcome", F.when(F.col("live").isNull(), "skipped_missing").when(F.col("there"), "skipped_present").otherwise("added"))
    out = tags.unionByName(rows.where("outcome = 'added'").select("entry_id", "tag"))
    return out, rows.groupBy("outcome").agg(F.count("*").alias("n"))


def heal_assets(assets: DataFrame, rewritten: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets (id, version, sha256) with the fingerprints of ``rewritten`` (id, sha256), and the texts of old fingerprints of the version moved along."""
    change = assets.join(rewritten.select("id", F.col("sha256").alias("now")), "id").where("now <> sha256").select("id", "version", F.col("sha256").alias("was"), "now")
    healed = assets.join(change.select("id", "now"), "id", "left").withColumn("sha256", F.coalesce("now", "sha256")).select(*assets.columns)
    map_ = change.groupBy("version", F.col("was").alias("sha256")).agg(F.min("now").alias("now"))
    moved = texts.join(map_, ["version", "sha256"], "left").withColumn("sha256", F.coalesce("now", "sha256")).select(*texts.columns)
    return healed, moved


def compact(rows: DataFrame, key: str, columns: Sequence[str], to: str = "json") -> DataFrame:
    """The key and a compact JSON object of some columns, nulls left out: what a tool returns."""
    return rows.select(key, F.to_json(F.struct(*columns)).alias(to))


def calibrate(boxes: DataFrame, transforms: DataFrame) -> DataFrame:
    """(object, transform) for boxes (object, x, y, w, h, page_w, page_h) and transforms (object, transform, a, d, e, f): the one that
    puts most boxes on the page, of equal ones the first."""
    x, y = F.col("a") * F.col("x") + F.col("e"), F.col("d") * F.col("y") + F.col("f")
    inside = (x >= 0) & (y >= 0) & (x + F.col("a") * F.col("w") <= F.col("page_w")) & (y + F.col("d") * F.col("h") <= F.col("page_h"))
    fit = boxes.join(transforms, "object").groupBy("object", "transform").agg(F.count_if(inside).alias("n"))
    return fit.groupBy("object").agg(F.max_by("transform", F.struct("n", -F.col("transform"))).alias("transform"))
