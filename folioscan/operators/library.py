"""Entity resolution and upkeep of a library: authors, duplicates, key lookups, alternative texts, conversations, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import scalars as S
from folioscan.functions.text import name_key


def canonical_ids(entries: DataFrame) -> DataFrame:
    """(id, scheme, value) of every canonical identifier of live entries; null ones have no row."""
    forms = {"doi": S.canonical_doi("doi"), "arxiv": S.canonical_arxiv("arxiv_id"), "isbn": S.canonical_isbn("isbn")}
    each = F.array(*(F.struct(F.lit(k).alias("scheme"), v.alias("value")) for k, v in forms.items()))
    return entries.where("not trashed").select("id", F.explode(each).alias("k")).select("id", "k.scheme", "k.value").where("value is not null")


def find_duplicates(clips: DataFrame, entries: DataFrame) -> DataFrame:
    """(clip, duplicate): the smallest live entry that shares any canonical identifier with a clip (id, doi, arxiv_id, isbn)."""
    asked = canonical_ids(clips.withColumn("trashed", F.lit(False))).withColumnRenamed("id", "clip")
    return asked.join(canonical_ids(entries), ["scheme", "value"]).groupBy("clip").agg(F.min("id").alias("duplicate"))


def clip_plan(clips: DataFrame, entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """What a clip leads to: ``create``, or the entry it duplicates and which files of an arXiv entry are missing."""
    have = attachments.groupBy(F.col("entry_id").alias("duplicate")).agg(F.max(F.contains("mime_type", F.lit("pdf"))).alias("pdf"), F.max(F.contains("mime_type", F.lit("gzip"))).alias("tex"))
    arxiv = entries.select(F.col("id").alias("duplicate"), S.canonical_arxiv("arxiv_id").alias("arxiv"))
    out = clips.select(F.col("id").alias("clip")).join(find_duplicates(clips, entries), "clip", "left").join(arxiv, "duplicate", "left").join(have, "duplicate", "left")
    lacks = lambda c: F.col("arxiv").isNotNull() & ~F.coalesce(F.col(c), F.lit(False))
    return out.select("clip", "duplicate", F.when(F.col("duplicate").isNull(), "create").otherwise("duplicate").alias("action"), lacks("pdf").alias("missing_pdf"), lacks("tex").alias("missing_tex"))


def resolve_authors(new: DataFrame, authors: DataFrame) -> DataFrame:
    """(row, author_id): of each new (row, name, orcid) the author with its ORCID, else, if it has none, with its name; else
    a new id, the same for all rows of the batch that would meet it. New ids follow the largest known."""
    n = new.withColumn("orcid", S.normalize_orcid("orcid")).withColumn("key", name_key("name"))
    known = authors.withColumn("orcid", S.normalize_orcid("orcid")).withColumn("key", name_key("name"))
    by_orcid = known.where("orcid is not null").groupBy("orcid").agg(F.min("id").alias("a"))
    by_name = known.groupBy("key").agg(F.min("id").alias("b"))
    found = n.join(by_orcid, "orcid", "left").join(by_name, "key", "left").withColumn("author_id", F.coalesce("a", F.when(F.col("orcid").isNull(), F.col("b"))))
    lost = found.where("author_id is null").withColumn("ident", F.coalesce("orcid", "key"))
    top = authors.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    first = lost.groupBy("ident").agg(F.min("row").alias("first"))
    made = lost.join(first, "ident").select("row", (F.lit(top) + 1 + F.col("first")).alias("author_id"))
    return found.where("author_id is not null").select("row", "author_id").union(made)


def merge_authors(links: DataFrame, source: int, target: int) -> DataFrame:
    """``links`` (entry_id, author_id, position) with ``source`` as ``target``; of two links of an entry the earlier stays."""
    moved = links.withColumn("author_id", F.when(F.col("author_id") == source, target).otherwise(F.col("author_id")))
    return moved.groupBy("entry_id", "author_id").agg(F.min("position").alias("position"))


def merge_identifiers(identifiers: DataFrame, source: int, target: int) -> DataFrame:
    """``identifiers`` (author_id, scheme, value) after a merge: the target's own value of a scheme goes first."""
    own = identifiers.withColumn("own", F.col("author_id") == target).withColumn("author_id", F.when(F.col("author_id") == source, target).otherwise(F.col("author_id")))
    return own.groupBy("author_id", "scheme").agg(F.max_by("value", F.struct("own", "value")).alias("value"))


def key_lookup(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """Each different key of ``asked`` (position, key), at its first position, with its entry and whether it was found."""
    first = asked.groupBy("key").agg(F.min("position").alias("position"))
    return first.join(keyed.select("key", "id"), "key", "left").select("position", "key", "id", F.col("id").isNotNull().alias("found"))


def carry_alt_texts(old: DataFrame, images: DataFrame) -> DataFrame:
    """(node_id, sha256, text, from_id): the latest generated text of the same image for nodes of a new version."""
    latest = old.where("origin = 'generated'").groupBy("sha256").agg(F.max_by(F.struct("text", "id"), "id").alias("t"))
    return images.join(latest, "sha256").select("node_id", "sha256", F.col("t.text").alias("text"), F.col("t.id").alias("from_id"))


def preferred_alt_text(texts: DataFrame) -> DataFrame:
    """Of each node the user's text, else the latest generated one."""
    w = Window.partitionBy("node_id").orderBy(F.desc(F.col("origin") == "user"), F.desc("id"))
    return texts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def figures_without_alt_text(figures: DataFrame, texts: DataFrame, least_side: int = 200) -> DataFrame:
    """Figures (node_id, asset_id, width, height) without a text, by their first crop that is large enough."""
    large = figures.where((F.col("width") >= least_side) & (F.col("height") >= least_side))
    first = large.groupBy("node_id").agg(F.min("asset_id").alias("asset_id"))
    return first.join(texts.select("node_id"), "node_id", "left_anti")


def provenance(results: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` sources (node, kind, page) that a tool's JSON result names, in order."""
    items = F.from_json("result", "struct<blocks:array<struct<node_id:bigint,kind:string,page:int>>>")["blocks"]
    return results.select("message_id", F.posexplode(items).alias("at", "b")).where(F.col("at") < most).select("message_id", "at", "b.*")


def reconcile(messages: DataFrame) -> DataFrame:
    """Conversations in which every call of an assistant turn has a result, before the next turn that is no result.

    ``messages`` is (session, position, role, calls array<string>, call_id); a run of results belongs to the last turn that isn't one.
    """
    turn = F.sum(F.when(F.col("role") != "tool", 1).otherwise(0)).over(Window.partitionBy("session").orderBy("position"))
    rows = messages.withColumn("turn", turn)
    wanted = rows.where("role = 'assistant' and size(calls) > 0").select("session", "turn", F.explode("calls").alias("call_id"))
    last = rows.groupBy("session", "turn").agg(F.max("position").alias("position"))
    missing = wanted.join(rows.where("role = 'tool'").select("session", "turn", "call_id"), ["session", "turn", "call_id"], "left_anti").join(last, ["session", "turn"])
    return rows.select("session", "position", "role", "call_id", F.lit(False).alias("filled")).union(missing.select("session", "position", F.lit("tool"), "call_id", F.lit(True)))


def save_rule(explicit_pages: Column, stopped: Column, saved: Column) -> Column:
    """What a run of page readings leaves: ``drop`` when nothing was saved, ``partial`` or ``sealed``."""
    return F.when(saved == 0, "drop").when(explicit_pages | stopped, "partial").otherwise("sealed")


def symbol_lookup(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols of that very surface, or with the text in surface, normal form or description, whatever the case."""
    low = F.lit(query.lower())
    hit = F.col("surface") == query
    for c in ("surface", "normal", "description"):
        hit = hit | F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    return symbols.where(hit)


def incident_relations(edges: DataFrame, kinds: list[str], node: int | None = None, most: int = 300) -> DataFrame:
    """Edges of some kinds that touch a node, capped."""
    out = edges.where(F.col("relation").isin(*kinds)) if kinds else edges
    if node is not None:
        out = out.where((F.col("source") == node) | (F.col("target") == node))
    return out.orderBy("version", "source", "relation", "target").limit(most)
