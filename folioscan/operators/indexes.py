"""Full-text indexes: what is indexed of entries, pages and blocks, who may replace what, and trigram postings for ranked search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.search import B, K1, LEAST_IDF, matches

#: Kinds that hold others and are not indexed themselves (fixed values).
CONTAINERS = ("document", "page", "line")


def _joined(rows: DataFrame, key: str, order: str, value: Column, to: str) -> DataFrame:
    """Values of each key in order, with a space between."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["v"]), " ").alias(to))


def entry_index(entries: DataFrame, links: DataFrame, authors: DataFrame, tags: DataFrame) -> DataFrame:
    """One row an entry: title, all spellings of its authors, tags, abstract, identifiers with the year; nothing is null.

    ``links`` is (entry_id, author_id, position); names come in their order, tags in that of the alphabet.
    """
    spelled = F.trim(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("name", "name_original", "reading_family", "reading_given"))))
    people = _joined(links.join(authors.withColumnRenamed("id", "author_id"), "author_id"), "entry_id", "position", spelled, "authors_text")
    named = _joined(tags, "entry_id", "tag", F.col("tag"), "tags_text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = entries.withColumn("entry_id", F.col("id")).join(people, "entry_id", "left").join(named, "entry_id", "left")
    return out.select("id", blank("title").alias("title"), blank("authors_text").alias("authors_text"), blank("tags_text").alias("tags_text"), blank("abstract").alias("abstract_text"), F.trim(F.concat_ws(" ", *(blank(c) for c in ("doi", "isbn", "arxiv_id", "year")))).alias("identifiers"))


def block_index(nodes: DataFrame, fragments: DataFrame) -> DataFrame:
    """(version, node, kind, body, page) of nodes with text that are no containers; the page is the first, or 0."""
    first = fragments.groupBy("node").agg(F.min("page").alias("page"))
    shown = nodes.where(~F.col("kind").isin(*CONTAINERS) & (F.trim("text") != ""))
    return shown.join(first, "node", "left").select("version", "node", "kind", F.col("text").alias("body"), F.coalesce("page", F.lit(0)).alias("page"))


def _outcome(new: DataFrame, old: DataFrame, sources: DataFrame, rule: Column) -> DataFrame:
    """(attachment_id, outcome) for attachments with new pages; a rule sees ``source``, ``old_pages`` and ``full`` (new pages with text)."""
    given = new.groupBy("attachment_id").agg(F.count_if(F.trim("content") != "").alias("full"))
    had = old.groupBy("attachment_id").agg(F.count("*").alias("n"))
    known = given.join(sources, "attachment_id", "left").join(had, "attachment_id", "left").withColumn("old_pages", F.coalesce("n", F.lit(0)))
    return known.select("attachment_id", rule.alias("outcome"))


def structure_outcomes(old: DataFrame, new: DataFrame, sources: DataFrame, protect_unrecorded: bool) -> DataFrame:
    """What pages from a structured document do: give way to ``ocr``, or to text of unknown origin, or ``replace``."""
    rule = F.when(F.col("source") == "ocr", "skipped_ocr")
    if protect_unrecorded:
        rule = rule.when(F.col("source").isNull() & (F.col("old_pages") > 0), "skipped_unrecorded")
    return _outcome(new, old, sources, rule.otherwise("replaced"))


def extraction_outcomes(old: DataFrame, new: DataFrame, sources: DataFrame, replace_structure: bool) -> DataFrame:
    """What pages from plain extraction do: give way to ``ocr`` and to structure, and never replace text by nothing."""
    protected = (F.col("source") == "ocr") if replace_structure else F.col("source").isin("ocr", "structure")
    rule = F.when(protected, "skipped_protected").when((F.col("full") == 0) & (F.col("old_pages") > 0), "skipped_empty")
    return _outcome(new, old, sources, rule.otherwise("replaced"))


def page_index(old: DataFrame, new: DataFrame, outcomes: DataFrame, keep_uncovered: bool, clean: Column | None = None) -> DataFrame:
    """(attachment_id, page, content) after a write; ``keep_uncovered``: old pages that new ones don't cover stay, cleaned.

    Attachments that are skipped, or have no new pages, stay as they are. Blank pages are not indexed.
    """
    done = outcomes.where("outcome = 'replaced'").select("attachment_id")
    names = ["attachment_id", "page", "content"]
    out = old.select(*names).join(done, "attachment_id", "left_anti").unionByName(new.select(*names).join(done, "attachment_id", "left_semi"))
    if keep_uncovered:
        left = old.join(done, "attachment_id", "left_semi").join(new.select("attachment_id", "page"), ["attachment_id", "page"], "left_anti")
        out = out.unionByName(left.withColumn("content", clean if clean is not None else F.col("content")).select(*names))
    return out.where(F.trim("content") != "")


def sweep_orphans(index: DataFrame, key: str, owners: DataFrame) -> DataFrame:
    """Index rows whose owner (one column) still exists."""
    return index.join(owners.toDF(key).distinct(), key, "left_semi")


def postings(index: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(gram, key): the different trigrams of each row's folded text, to be stored sorted by gram; and (key, dl, text)."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    length = sum((F.greatest(F.char_length(c) - 2, F.lit(0)) for c in low), F.lit(0))
    # one walk over the text; a substring by position would walk it from its start for each trigram
    of = lambda c: F.regexp_extract_all(c, F.lit("(?s)(?=(...))."), F.lit(1))
    grams = F.flatten(F.array(*(of(c) for c in low)))
    rows = index.select(key, length.alias("dl"), *columns)
    return index.select(key, F.explode(F.array_distinct(grams)).alias("gram")), rows


def candidates(grams: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """(token, key): rows that have all trigrams of a token; an equi join with the postings of these trigrams alone."""
    wanted = [(k, t.lower()[i : i + 3]) for k, t in enumerate(tokens) for i in range(len(t) - 2)]
    asked = grams.sparkSession.createDataFrame(sorted(set(wanted)), "token int, gram string")
    need = F.create_map(*(F.lit(x) for k in range(len(tokens)) for x in (k, len({g for j, g in set(wanted) if j == k}))))
    hits = grams.where(F.col("gram").isin(*sorted({g for _, g in wanted}))).join(F.broadcast(asked), "gram")
    return hits.groupBy("token", key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == need[F.col("token")]).select("token", key)


def bm25_indexed(grams: DataFrame, rows: DataFrame, key: str, columns: list[str], tokens: list[str], scope: DataFrame | None = None) -> DataFrame:
    """(key, score) as ``search.bm25`` gives it, but only rows that the postings name are read as text.

    Tokens have three characters or more. Statistics cover all rows: their number and length come from ``rows``
    without the text, document frequencies from the verified candidates before ``scope``.
    """
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    count = lambda t: sum((F.regexp_count(c, F.lit(f"(?={re.escape(t.lower())})")) for c in low), F.lit(0))
    some = candidates(grams, key, tokens).select(key).distinct()
    found = rows.join(some, key).select(key, "dl", matches(columns, tokens).alias("hit"), *(count(t).alias(f"f{k}") for k, t in enumerate(tokens)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).crossJoin(found.agg(*(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(tokens)))))  # one row each
    hits = found.where("hit")
    if scope is not None:
        hits = hits.join(scope, key, "left_semi")
    score = F.lit(0.0)
    for k in range(len(tokens)):
        idf = F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        f = F.col(f"f{k}")
        score = score - F.when(idf <= 0, LEAST_IDF).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats: one row


def marked(text: str, token: str, around: int = 30) -> Column:
    """A window around the first occurrence with the occurrence between ``[`` and ``]`` and an ellipsis where it is cut; else the first 200 characters."""
    c = F.coalesce(F.col(text), F.lit(""))
    at = F.locate(token.lower(), F.lower(c))
    n = len(token)
    start = F.greatest(at - around, F.lit(1))
    window = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(c, start, at - start), F.lit("["), F.substring(c, at, F.lit(n)), F.lit("]"), F.substring(c, at + n, F.lit(around)), F.when(F.char_length(c) > at + n + around - 1, "…").otherwise(""))
    return F.when(at > 0, window).otherwise(F.substring(c, 1, 200))


def block_search(index: DataFrame, tokens: list[str], kinds: list[str] | None = None, scope: DataFrame | None = None, fragments: DataFrame | None = None, most: int = 50) -> DataFrame:
    """Blocks that match, by version and node: of some kinds, of entries in ``scope`` (version), cut to ``most`` before boxes join."""
    hits = index.where(matches(["body"], tokens))
    if kinds:
        hits = hits.where(F.col("kind").isin(*kinds))
    if scope is not None:
        hits = hits.join(scope, "version", "left_semi")
    hits = hits.orderBy("version", "node").limit(most)
    if fragments is not None:
        first = fragments.groupBy("node").agg(F.min(F.struct("page", "x", "y", "w", "h")).alias("f"))
        hits = hits.join(first, "node", "left").select("version", "node", "kind", "page", marked("body", tokens[0]).alias("snippet"), "f.x", "f.y", "f.w", "f.h")
    return hits
