"""Queries over indexes, writes, listings, exports and recognisers, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import scalars as S
from folioscan.operators import indexes as I
from folioscan.operators import relational as R
from folioscan.operators import search as T
from folioscan.operators import upkeep as U
from folioscan.plans.core import QUERIES, _bm25_sql, query
from folioscan.sources.tables import ENTRIES_SQL, LINES_SQL, TAGS_SQL, entries, entry_tags, load, page_lines

__all__ = ["QUERIES"]


def _text(*parts):  # noqa: ANN202
    return F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))


# ---- indexes

_WORKS = "(SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS abstract, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 5 = 0 THEN '978' || o_orderkey END AS isbn, year(o_orderdate) AS year FROM orders)"


@query(f"""SELECT w.id, w.title, coalesce(a.authors_text, '') AS authors_text, coalesce(t.tags_text, '') AS tags_text, w.abstract AS abstract_text,
  trim(coalesce(w.doi, '') || ' ' || coalesce(w.isbn, '') || '  ' || w.year) AS identifiers FROM {_WORKS} w
  LEFT JOIN (SELECT l_orderkey AS id, string_agg(trim(s_name || ' Nr ' || s_suppkey || '  ' || s_nationkey), ' ' ORDER BY l_linenumber * 100000000 + l_partkey, trim(s_name || ' Nr ' || s_suppkey || '  ' || s_nationkey)) AS authors_text FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) a ON a.id = w.id
  LEFT JOIN (SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag || l_linestatus, ' ' ORDER BY l_returnflag || l_linestatus) AS tags_text FROM lineitem GROUP BY 1) t ON t.id = w.id""")
def entry_index(spark, d):
    """What is indexed of each entry: title, people in order with all their spellings, tags, abstract, identifiers."""
    o, li, s = load(spark, d, "orders"), load(spark, d, "lineitem"), load(spark, d, "supplier")
    key = F.col("o_orderkey")
    works = o.select(key.alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"), F.when(key % 3 == 0, _text("10.1/", key)).alias("doi"), F.when(key % 5 == 0, _text("978", key)).alias("isbn"), F.lit(None).cast("string").alias("arxiv_id"), F.year("o_orderdate").alias("year"))
    links = li.select(F.col("l_orderkey").alias("entry_id"), F.col("l_suppkey").alias("author_id"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("position"))
    people = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), _text("Nr ", F.col("s_suppkey")).alias("name_original"), F.lit("").alias("reading_family"), F.col("s_nationkey").cast("string").alias("reading_given"))
    tags = li.select(F.col("l_orderkey").alias("entry_id"), F.concat("l_returnflag", "l_linestatus").alias("tag")).distinct()
    return I.entry_index(works, links, people, tags)


_NODES = f"(SELECT attachment_id AS version, attachment_id * 100000 + page AS node, CASE page % 5 WHEN 0 THEN 'line' WHEN 1 THEN 'heading' WHEN 2 THEN 'page' ELSE 'paragraph' END AS kind, content AS text, page AS line FROM {LINES_SQL})"
_FRAGMENTS = f"(SELECT node, line // 7 + k AS page, CAST(line % 9 AS DOUBLE) AS x, CAST(k AS DOUBLE) AS y FROM {_NODES}, (SELECT unnest([0, 1]) AS k) WHERE line % 4 <> 3)"


def _nodes(spark, d):  # noqa: ANN001, ANN202
    p = F.col("page")
    kind = F.when(p % 5 == 0, "line").when(p % 5 == 1, "heading").when(p % 5 == 2, "page").otherwise("paragraph")
    return page_lines(spark, d).select(F.col("attachment_id").alias("version"), (F.col("attachment_id") * 100000 + p).alias("node"), kind.alias("kind"), F.col("content").alias("text"), p.alias("line"))


def _fragments(spark, d):  # noqa: ANN001, ANN202
    rows = _nodes(spark, d).where("line % 4 <> 3").select("node", "line", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return rows.select("node", (F.floor(F.col("line") / 7) + F.col("k")).alias("page"), (F.col("line") % 9).cast("double").alias("x"), F.col("k").cast("double").alias("y"))


@query(f"SELECT n.version, n.node, n.kind, n.text AS body, coalesce(f.page, 0) AS page FROM {_NODES} n LEFT JOIN (SELECT node, min(page) AS page FROM {_FRAGMENTS} GROUP BY node) f ON f.node = n.node WHERE n.kind NOT IN ('document', 'page', 'line')")
def block_index(spark, d):
    """Blocks that are no containers, with their first page or 0."""
    return I.block_index(_nodes(spark, d), _fragments(spark, d))


_OLD_PAGES = f"(SELECT attachment_id, page, content FROM {LINES_SQL} WHERE page <= 4 AND attachment_id % 7 <> 6)"
_NEW_PAGES = f"(SELECT attachment_id, page, CASE WHEN attachment_id % 5 = 4 THEN ' ' ELSE lower(content) END AS content FROM {LINES_SQL} WHERE page % 2 = 1 AND attachment_id % 3 <> 2)"
_SOURCES = "(SELECT doc_id AS attachment_id, CASE doc_id % 4 WHEN 0 THEN 'ocr' ELSE 'structure' END AS source FROM documents WHERE doc_id % 4 < 2)"


def _pages(spark, d):  # noqa: ANN001, ANN202
    p, key = page_lines(spark, d), F.col("attachment_id")
    new = p.where((F.col("page") % 2 == 1) & (key % 3 != 2)).withColumn("content", F.when(key % 5 == 4, " ").otherwise(F.lower("content")))
    sources = load(spark, d, "documents").select(F.col("doc_id").alias("attachment_id")).where("attachment_id % 4 < 2").withColumn("source", F.when(key % 4 == 0, "ocr").otherwise("structure"))
    return p.where((F.col("page") <= 4) & (key % 7 != 6)), new, sources


_GIVEN = f"SELECT n.attachment_id, s.source, n.full_pages, coalesce(o.n, 0) AS old_pages FROM (SELECT attachment_id, count(*) FILTER (trim(content) <> '') AS full_pages FROM {_NEW_PAGES} GROUP BY 1) n LEFT JOIN {_SOURCES} s ON s.attachment_id = n.attachment_id LEFT JOIN (SELECT attachment_id, count(*) AS n FROM {_OLD_PAGES} GROUP BY 1) o ON o.attachment_id = n.attachment_id"
_BY_STRUCTURE = f"(SELECT attachment_id, CASE WHEN source = 'ocr' THEN 'skipped_ocr' WHEN source IS NULL AND old_pages > 0 THEN 'skipped_unrecorded' ELSE 'replaced' END AS outcome FROM ({_GIVEN}))"
_BY_EXTRACTION = f"(SELECT attachment_id, CASE WHEN source IN ('ocr', 'structure') THEN 'skipped_protected' WHEN full_pages = 0 AND old_pages > 0 THEN 'skipped_empty' ELSE 'replaced' END AS outcome FROM ({_GIVEN}))"


@query(f"""WITH done AS (SELECT attachment_id FROM {_BY_STRUCTURE} WHERE outcome = 'replaced'), o AS (SELECT * FROM {_OLD_PAGES}), n AS (SELECT * FROM {_NEW_PAGES})
SELECT attachment_id, page, content FROM (SELECT * FROM o WHERE attachment_id NOT IN (SELECT attachment_id FROM done) UNION ALL SELECT * FROM n WHERE attachment_id IN (SELECT attachment_id FROM done)
  UNION ALL SELECT attachment_id, page, trim(regexp_replace(content, '\\s+', ' ', 'g')) FROM o WHERE attachment_id IN (SELECT attachment_id FROM done) AND NOT EXISTS (SELECT 1 FROM n WHERE n.attachment_id = o.attachment_id AND n.page = o.page)) WHERE trim(content) <> ''""")
def page_index_from_structure(spark, d):
    """The page index after structured pages came in: OCR stays, uncovered pages stay cleaned."""
    old, new, sources = _pages(spark, d)
    outcomes = I.structure_outcomes(old, new, sources, True)
    return I.page_index(old, new, outcomes, True, S.collapse_space("content"))


@query(f"""SELECT outcome, count(*) AS n FROM {_BY_EXTRACTION} GROUP BY outcome UNION ALL SELECT 'structure_' || outcome, count(*) FROM {_BY_STRUCTURE} GROUP BY outcome""")
def page_index_guards(spark, d):
    """What attachments' new pages do, by either way in."""
    old, new, sources = _pages(spark, d)
    a = I.extraction_outcomes(old, new, sources, False).groupBy("outcome").agg(F.count("*").alias("n"))
    b = I.structure_outcomes(old, new, sources, True).groupBy(F.concat(F.lit("structure_"), "outcome").alias("outcome")).agg(F.count("*").alias("n"))
    return a.union(b)


@query(f"""WITH done AS (SELECT attachment_id FROM {_BY_EXTRACTION} WHERE outcome = 'replaced') SELECT attachment_id, page, content FROM (SELECT * FROM {_OLD_PAGES} WHERE attachment_id NOT IN (SELECT attachment_id FROM done)
  UNION ALL SELECT * FROM {_NEW_PAGES} WHERE attachment_id IN (SELECT attachment_id FROM done)) WHERE trim(content) <> ''""")
def page_index_from_extraction(spark, d):
    """The page index after extracted pages came in: OCR and structure stay, and nothing replaces text by blanks."""
    old, new, sources = _pages(spark, d)
    return I.page_index(old, new, I.extraction_outcomes(old, new, sources, False), False)


@query(f"SELECT attachment_id, count(*) AS n FROM {LINES_SQL} WHERE attachment_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def orphan_sweep(spark, d):
    """Index rows whose owner still exists."""
    left = I.sweep_orphans(page_lines(spark, d), "attachment_id", load(spark, d, "labels").select("doc_id"))
    return left.groupBy("attachment_id").agg(F.count("*").alias("n"))


@query(_bm25_sql(["thand", "ersh"], "documents", "doc_id", "text"))
def text_bm25_indexed(spark, d):
    """BM25 through trigram postings: only rows that hold all trigrams of the tokens are read as text."""
    grams, rows = I.postings(load(spark, d, "documents"), "doc_id", ["text"])
    return I.bm25_indexed(grams, rows, "doc_id", ["text"], ["thand", "ersh"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""SELECT h.version, h.node, h.kind, h.page, CASE WHEN pos > 0 THEN CASE WHEN pos > 31 THEN '…' ELSE '' END || substring(body, greatest(pos - 30, 1), pos - greatest(pos - 30, 1)) || '[' || substring(body, pos, 4) || ']' || substring(body, pos + 4, 30) || CASE WHEN length(body) > pos + 33 THEN '…' ELSE '' END ELSE substring(body, 1, 200) END AS snippet, f.x, f.y
  FROM (SELECT *, strpos(lower(body), 'ersh') AS pos FROM (SELECT n.version, n.node, n.kind, n.text AS body, coalesce((SELECT min(page) FROM {_FRAGMENTS} f WHERE f.node = n.node), 0) AS page FROM {_NODES} n) WHERE kind = 'paragraph' AND contains(lower(body), 'ersh') AND version IN (SELECT id FROM {ENTRIES_SQL} e WHERE lang = 'en' AND NOT trashed) ORDER BY version, node LIMIT 40) h
  LEFT JOIN (SELECT node, arg_min(x, page * 1000 + x * 10 + y) AS x, arg_min(y, page * 1000 + x * 10 + y) AS y FROM {_FRAGMENTS} GROUP BY node) f ON f.node = h.node""")
def block_search_scoped(spark, d):
    """Blocks of a kind in live English entries, cut before their boxes join, with a marked window."""
    fragments = _fragments(spark, d)
    scope = R.scoped(entries(spark, d), "live").where("lang = 'en'").select(F.col("id").alias("version"))
    hits = I.block_search(I.block_index(_nodes(spark, d), fragments), ["ersh"], ["paragraph"], scope, fragments.withColumn("w", F.lit(1.0)).withColumn("h", F.lit(1.0)), 40)
    return hits.drop("w", "h")


@query(f"""SELECT l.attachment_id, l.page, e.title FROM {LINES_SQL} l JOIN {ENTRIES_SQL} e ON e.id = l.attachment_id WHERE NOT e.trashed AND e.starred AND contains(lower(l.content), 'thand')
  AND e.id IN (SELECT entry_id FROM {TAGS_SQL} t WHERE tag = 'quality') AND e.entry_type IN ('src1', 'src2', 'src3')""")
def page_search_scoped(spark, d):
    """Pages that match within a collection, a tag and a view."""
    live = R.tagged(R.scoped(entries(spark, d), "starred").where(F.col("entry_type").isin("src1", "src2", "src3")), entry_tags(spark, d), ["quality"], False)
    return page_lines(spark, d).where(T.matches(["content"], ["thand"])).join(live.select(F.col("id").alias("attachment_id"), "title"), "attachment_id").select("attachment_id", "page", "title")


_ORCID = "'0000-0001-' || lpad(CAST(c_custkey // 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"


@query(f"SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment || ' ' || c_custkey), 'build 12') OR {_ORCID} = '0000-0001-0000-0007' ORDER BY lower(c_name), c_custkey LIMIT 15")
def author_search_full(spark, d):
    """People by part of the name, by part of the original name, or by the very ORCID."""
    k = F.col("c_custkey")
    orcid = _text("0000-0001-", F.lpad(F.floor(k / 10000).cast("string"), 4, "0"), "-", F.lpad((k % 10000).cast("string"), 4, "0"))
    hit = F.contains(F.lower("c_name"), F.lit("00012")) | F.contains(F.lower(_text(F.col("c_mktsegment"), " ", k)), F.lit("build 12")) | (orcid == "0000-0001-0000-0007")
    return load(spark, d, "customer").where(hit).orderBy(F.lower("c_name"), "c_custkey").limit(15).select("c_custkey", "c_name")


# ---- keys, links, writes

_KEYED = "(SELECT p_partkey AS id, 'K' || (p_partkey % 300) AS citation_key, p_size % 6 = 0 AS trashed FROM part)"


def _keyed(spark, d):  # noqa: ANN001, ANN202
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), _text("K", F.col("p_partkey") % 300).alias("citation_key"), (F.col("p_size") % 6 == 0).alias("trashed"))


@query(f"SELECT s_suppkey AS row, NOT EXISTS (SELECT 1 FROM {_KEYED} k WHERE k.citation_key = 'K' || (s_suppkey * 7) AND (s_nationkey > 12 OR k.id <> s_suppkey * 7)) OR s_suppkey % 11 = 0 AS available FROM supplier")
def key_available(spark, d):
    """Whether a citation key is free but for one entry; spaces and the like don't count."""
    k = F.col("s_suppkey")
    asked = load(spark, d, "supplier").select(k.alias("row"), F.when(k % 11 == 0, " !? ").otherwise(_text(" K", k * 7, "!")).alias("key"), F.when(F.col("s_nationkey") <= 12, k * 7).alias("exclude"))
    return U.key_available(asked, _keyed(spark, d))


@query("""SELECT entry_id, author_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY pos) - 1 AS BIGINT) AS position FROM (
  SELECT o_orderkey AS entry_id, unnest([o_custkey, o_custkey + 100000000, (o_custkey + 1) % 100]) AS author_id, unnest([0, 1, 2]) AS pos FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, o_custkey % 25, 0 FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, o_custkey % 24 + 1, 1 FROM orders WHERE o_orderkey % 3 = 1
  UNION ALL SELECT o_orderkey, 3, 0 FROM orders WHERE o_orderkey % 3 = 2) WHERE author_id < 100000000""")
def author_links(spark, d):
    """Who is linked to an entry and where: structured people, else ids that exist, else names."""
    o, k, c = load(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None)
    named = lambda n: _text("NATION_", n)
    people = F.when(k % 3 == 1, F.array(named(c % 25), named(c % 24 + 1)))
    ids = F.when(k % 3 == 0, F.array(c, c + 100000000, (c + 1) % 100)).when(k % 3 == 1, F.array(c))
    inputs = o.select(k.alias("entry_id"), people.alias("authors"), ids.alias("author_ids"), F.when(k % 3 == 2, F.array(F.lit("NATION_3"))).otherwise(none).alias("names"))
    resolve = load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("author_id"))
    return U.author_links(inputs, load(spark, d, "customer").select(F.col("c_custkey").alias("id")), resolve)


_VERSIONS = "(SELECT event_id AS version, user_id AS attachment_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id = max(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) THEN 'completed' ELSE 'superseded' END AS status FROM events)"
_ASSETS = "(SELECT event_id AS version, 'sha' || (event_id % 17) AS sha256, event_id AS id FROM events WHERE event_id % 3 <> 1)"
_ALT = "(SELECT event_id AS id, event_id AS version, 'sha' || (event_id % 17) AS sha256, CASE WHEN event_type = 'purchase' THEN 'user' ELSE 'generated' END AS origin, CASE WHEN event_id % 10 = 0 AND event_id > 40 THEN event_id - 40 END AS carried_from FROM events WHERE value > 40)"


def _versions(spark, d):  # noqa: ANN001, ANN202
    e = load(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("ok"), F.col("event_id"))).alias("last"))
    status = F.when(~F.col("ok"), "failed").when(F.col("event_id") == F.col("last"), "completed").otherwise("superseded")
    versions = e.join(last, "user_id").select(F.col("event_id").alias("version"), F.col("user_id").alias("attachment_id"), status.alias("status"))
    sha = _text("sha", F.col("event_id") % 17).alias("sha256")
    assets = e.where("event_id % 3 <> 1").select(F.col("event_id").alias("version"), sha, F.col("event_id").alias("id"))
    carried = F.when((F.col("event_id") % 10 == 0) & (F.col("event_id") > 40), F.col("event_id") - 40)
    texts = e.where("value > 40").select(F.col("event_id").alias("id"), F.col("event_id").alias("version"), sha, F.when(F.col("event_type") == "purchase", "user").otherwise("generated").alias("origin"), carried.alias("carried_from"))
    return versions, assets, texts


@query(f"SELECT t.id, t.version, t.sha256 FROM (SELECT event_id AS id, event_id AS version, 'sha' || ((event_id + event_id % 2) % 17) AS sha256 FROM events) t WHERE t.version IN (SELECT max(version) FROM {_VERSIONS} WHERE status = 'completed' GROUP BY attachment_id) AND EXISTS (SELECT 1 FROM {_ASSETS} a WHERE a.version = t.version AND a.sha256 = t.sha256)")
def insert_if_latest(spark, d):
    """Texts that may still be written: their version is the latest and has the image."""
    versions, assets, _ = _versions(spark, d)
    k = F.col("event_id")
    asked = load(spark, d, "events").select(k.alias("id"), k.alias("version"), _text("sha", (k + k % 2) % 17).alias("sha256"))
    return U.insert_if_latest(asked, versions, assets).select("id", "version", "sha256")


@query(f"""WITH v AS (SELECT * FROM {_VERSIONS}), keep AS (SELECT attachment_id, max(version) AS version FROM v WHERE status = 'completed' GROUP BY 1), held AS (SELECT DISTINCT k.attachment_id, k.version AS kept, a.sha256 FROM keep k JOIN (SELECT event_id AS version, 'sha' || j AS sha256 FROM events, (SELECT unnest(range(0, 17, 2)) AS j)) a ON a.version = k.version)
SELECT id, origin FROM {_ALT} t WHERE NOT (origin = 'generated' AND EXISTS (SELECT 1 FROM v JOIN held h ON h.attachment_id = v.attachment_id WHERE v.version = t.version AND h.sha256 = t.sha256 AND t.version <> h.kept))""")
def alt_text_prune(spark, d):
    """Alternative texts without the generated ones whose image the kept version has."""
    versions, _, texts = _versions(spark, d)
    crops = load(spark, d, "events").select(F.col("event_id").alias("version"), F.explode(F.array(*(F.lit(f"sha{j}") for j in range(0, 17, 2)))).alias("sha256"))
    return U.prune_carried(texts, versions, crops, U.latest_done(versions)).select("id", "origin")


_TARGETS = f"(SELECT version FROM {_VERSIONS} v WHERE status = 'superseded' AND attachment_id IN (SELECT attachment_id FROM {_VERSIONS} WHERE status = 'completed') AND version NOT IN (SELECT version FROM {_ALT}) AND version IN (SELECT version FROM {_ASSETS}))"


@query(f"SELECT version, attachment_id, CASE WHEN version IN (SELECT version FROM {_TARGETS}) THEN 'tombstone' ELSE status END AS status FROM {_VERSIONS} v WHERE version NOT IN (SELECT version FROM {_TARGETS}) OR version IN (SELECT carried_from FROM {_ALT} WHERE carried_from IS NOT NULL)")
def gc_sweep(spark, d):
    """Versions after a sweep; those that texts were carried from are tombstones."""
    versions, assets, texts = _versions(spark, d)
    return U.collect_garbage(versions, texts, assets)[0]


@query(f"SELECT version, sha256, id FROM {_ASSETS} WHERE version NOT IN (SELECT version FROM {_TARGETS})")
def gc_children(spark, d):
    """What hangs on versions after a sweep."""
    versions, assets, texts = _versions(spark, d)
    return U.collect_garbage(versions, texts, assets)[1]


@query(f"""WITH k AS (SELECT * FROM {_KEYED}), a AS (SELECT s_suppkey * 23 AS id FROM supplier), r AS (SELECT a.id, k.citation_key, k.trashed, EXISTS (SELECT 1 FROM k l WHERE NOT l.trashed AND l.citation_key = k.citation_key) AS taken, row_number() OVER (PARTITION BY k.citation_key, k.trashed ORDER BY a.id) AS n FROM a LEFT JOIN k ON k.id = a.id)
SELECT id, CASE WHEN trashed IS NULL THEN 'unknown' WHEN NOT trashed THEN 'not_trashed' WHEN taken OR n > 1 THEN 'conflict' ELSE 'restored' END AS outcome FROM r""")
def restore_entries(spark, d):
    """What becomes of entries that shall leave the trash."""
    return U.restore(_keyed(spark, d), load(spark, d, "supplier").select((F.col("s_suppkey") * 23).alias("id")))


@query("SELECT CASE WHEN n_nationkey IN (3, 7) THEN 'NATION_' || n_nationkey ELSE n_name END AS key, CASE n_nationkey WHEN 3 THEN 'new' WHEN 7 THEN 'last' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation UNION ALL SELECT 'added', '1'")
def settings_write(spark, d):
    """Settings after several were written at once."""
    old = load(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return U.set_settings(old, [("NATION_3", "new"), ("NATION_7", "first"), ("added", "1"), ("NATION_7", "last")])


@query("""SELECT author_id, scheme, value FROM (SELECT c_custkey AS author_id, 'orcid' AS scheme, c_name AS value FROM customer WHERE c_custkey % 4 <> 1 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 8 = 1 THEN 'orcid' ELSE 'isni' END, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 4 = 1 AND c_nationkey <> 5)""")
def identifier_edit(spark, d):
    """Identifiers after those of some authors were replaced; blank ones are skipped."""
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    old = c.select(k.alias("author_id"), F.lit("orcid").alias("scheme"), F.col("c_name").alias("value"))
    new = c.where("c_custkey % 4 = 1").select(k.alias("author_id"), F.when(k % 8 == 1, " ORCID").otherwise("isni").alias("scheme"), F.when(F.col("c_nationkey") == 5, " ").otherwise(_text(" ", F.col("c_nationkey"))).alias("value"))
    return U.replace_identifiers(old, new, c.select(k.alias("id"), F.lit(None).cast("string").alias("orcid")))[0]


@query(f"""WITH asked AS (SELECT DISTINCT doc_id + 5 AS entry_id, CASE WHEN doc_id % 2 = 0 THEN 'quality' ELSE 'new' END AS tag FROM labels), r AS (SELECT CASE WHEN e.id IS NULL THEN 'skipped_missing' WHEN t.tag IS NOT NULL THEN 'skipped_present' ELSE 'added' END AS outcome FROM asked a LEFT JOIN (SELECT id FROM {ENTRIES_SQL} e WHERE NOT trashed) e ON e.id = a.entry_id LEFT JOIN (SELECT DISTINCT * FROM {TAGS_SQL}) t ON t.entry_id = a.entry_id AND t.tag = a.tag) SELECT outcome, count(*) AS n FROM r GROUP BY outcome""")
def tag_write_summary(spark, d):
    """What a tool's writing of tags did and skipped."""
    asked = load(spark, d, "labels").select((F.col("doc_id") + 5).alias("entry_id"), F.when(F.col("doc_id") % 2 == 0, "quality").otherwise("new").alias("tag"))
    return U.add_tags(entry_tags(spark, d), entries(spark, d), asked)[1]


@query(f"""WITH c AS (SELECT id, version, sha256 AS was, 'now' || id % 4 AS now FROM {_ASSETS} WHERE id % 6 = 0), m AS (SELECT version, was, min(now) AS now FROM c GROUP BY 1, 2)
SELECT t.id, t.version, coalesce(m.now, t.sha256) AS sha256 FROM {_ALT} t LEFT JOIN m ON m.version = t.version AND m.was = t.sha256""")
def asset_heal(spark, d):
    """Alternative texts after missing crops were written again with other fingerprints."""
    _, assets, texts = _versions(spark, d)
    again = assets.where("id % 6 = 0").select("id", _text("now", F.col("id") % 4).alias("sha256"))
    return U.heal_assets(assets, again, texts)[1].select("id", "version", "sha256")


# ---- listings, exports, tools


@query("SELECT event_id AS id, floor(value / 10) AS page, value AS y FROM events WHERE user_id = 7 ORDER BY page, y DESC, id")
def highlight_listing(spark, d):
    """An entry's highlights down its pages."""
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.floor(F.col("value") / 10).cast("double").alias("page"), F.col("value").alias("y"))
    return U.highlights(rows, "user_id", 7).select("id", "page", "y")


_PARTS = "(SELECT l_partkey * 10 + l_linenumber % 3 AS node, l_returnflag = 'R' AS prim, l_linenumber AS reading_order, l_orderkey * 1000 + l_suppkey AS id, CAST(l_quantity AS BIGINT) AS page, l_discount AS x, l_tax AS y FROM lineitem)"


@query(f"""SELECT n.node, v.attachment_id, v.source, f.page, f.x, f.y FROM (SELECT p_partkey * 10 + k AS node, p_partkey AS version FROM part, (SELECT unnest([0, 1, 2, 3]) AS k)) n JOIN (SELECT p_partkey AS version, p_size AS attachment_id, p_brand AS source FROM part) v ON v.version = n.version
  LEFT JOIN (SELECT node, page, x, y FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY NOT prim, reading_order, id, page, x, y) AS n FROM {_PARTS}) WHERE n = 1) f ON f.node = n.node""")
def node_regions(spark, d):
    """Where nodes stand: attachment, source, page and box of the primary fragment."""
    part, li = load(spark, d, "part"), load(spark, d, "lineitem")
    nodes = part.select(F.col("p_partkey").alias("version"), F.explode(F.array(*(F.col("p_partkey") * 10 + k for k in range(4)))).alias("node"))
    versions = part.select(F.col("p_partkey").alias("version"), F.col("p_size").alias("attachment_id"), F.col("p_brand").alias("source"))
    fragments = li.select((F.col("l_partkey") * 10 + F.col("l_linenumber") % 3).alias("node"), (F.col("l_returnflag") == "R").alias("primary"), F.col("l_linenumber").alias("reading_order"), (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("id"), F.col("l_quantity").cast("long").alias("page"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    return U.node_regions(nodes, versions, fragments).drop("w", "h")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity")
def version_listing(spark, d):
    """What hangs on the nodes of one version, in order."""
    nodes = load(spark, d, "orders").select(F.col("o_custkey").alias("version"), F.col("o_orderkey").alias("node"))
    rows = load(spark, d, "lineitem").withColumn("node", F.col("l_orderkey"))
    return U.of_version(rows, nodes, 7, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_LIBRARY = "(SELECT p_partkey AS place, 'K' || p_partkey AS key, p_name AS title, p_size AS size FROM part)"


def _library(spark, d):  # noqa: ANN001, ANN202
    return load(spark, d, "part").select(F.col("p_partkey").alias("place"), _text("K", F.col("p_partkey")).alias("key"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))


@query(f"SELECT place, key, title FROM {_LIBRARY} WHERE key IN (SELECT 'K' || s_suppkey * 31 FROM supplier) ORDER BY place")
def export_by_keys(spark, d):
    """Entries of the keys that were asked for, in the order of the library."""
    asked = load(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), _text("K", F.col("s_suppkey") * 31).alias("key"))
    return U.export_by_keys(_library(spark, d), asked)[0].select("place", "key", "title")


@query(f"SELECT min(s_suppkey) AS position, 'K' || (s_suppkey % 40) * 61 AS key, any_value(l.key) IS NOT NULL AS found FROM supplier LEFT JOIN {_LIBRARY} l ON l.key = 'K' || (s_suppkey % 40) * 61 GROUP BY 2")
def export_keys_found(spark, d):
    """Which of the asked keys there are, each once in the order it was asked for."""
    asked = load(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), _text("K", F.col("s_suppkey") % 40 * 61).alias("key"))
    return U.export_by_keys(_library(spark, d), asked)[1]


@query(f"SELECT place, key, title FROM {_LIBRARY} WHERE size BETWEEN 10 AND 20 AND contains(lower(title), 'ring') ORDER BY place")
def export_by_filter(spark, d):
    """Without keys, an export has what the filter finds, under the library's keys."""
    every = _library(spark, d)
    hits = R.compound_filter(every.withColumn("id", F.col("place")), low=10, high=20).where(T.matches(["title"], ["ring"]))
    asked = hits.select(F.col("place").alias("position"), "key")
    return U.export_by_keys(every, asked)[0].select("place", "key", "title")


@query("""SELECT o.o_orderkey AS id, '{"id":' || o.o_orderkey || ',"title":"' || o.o_orderpriority || '","authors":[' || coalesce(a.authors, '') || '],"tags":[' || coalesce(t.tags, '') || ']}' AS json FROM orders o
  LEFT JOIN (SELECT l_orderkey AS id, string_agg('"' || s_name || '"', ',' ORDER BY l_linenumber * 100000000 + l_partkey, s_name) AS authors FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) a ON a.id = o.o_orderkey
  LEFT JOIN (SELECT l_orderkey AS id, string_agg(DISTINCT '"' || l_returnflag || '"', ',' ORDER BY '"' || l_returnflag || '"') AS tags FROM lineitem GROUP BY 1) t ON t.id = o.o_orderkey""")
def library_json(spark, d):
    """The whole library as JSON, people in order."""
    li = load(spark, d, "lineitem")
    works = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    links = li.select(F.col("l_orderkey").alias("entry_id"), F.col("l_suppkey").alias("author_id"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("position"))
    people = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return U.library_json(works, links, people, li.select(F.col("l_orderkey").alias("entry_id"), F.col("l_returnflag").alias("tag")))


@query("SELECT p_partkey AS id, '{\"id\":' || p_partkey || ',\"title\":\"' || p_name || '\"' || CASE WHEN p_size > 25 THEN ',\"size\":' || p_size ELSE '' END || '}' AS json FROM part")
def tool_projection(spark, d):
    """What a tool returns of entries: compact JSON without nulls."""
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    return U.compact(rows, "id", ["id", "title", "size"])


@query("SELECT object, arg_max(transform, n * 10 - transform) AS transform FROM (SELECT p_size AS object, t AS transform, count(*) FILTER (a * x + e >= 0 AND a * y + e >= 0 AND a * x + e + a * 30 <= 595 AND a * y + e + a * 20 <= 842) AS n FROM (SELECT p_size, CAST(p_partkey % 700 AS DOUBLE) AS x, CAST(p_partkey % 900 AS DOUBLE) AS y FROM part), (SELECT unnest([0, 1, 2]) AS t, unnest([1.0, 0.5, 0.5]) AS a, unnest([0.0, 0.0, 100.0]) AS e) GROUP BY 1, 2) GROUP BY object")
def form_calibration(spark, d):
    """Of the ways to place nested objects the one that puts most boxes on the page."""
    k = F.col("p_partkey")
    boxes = load(spark, d, "part").select(F.col("p_size").alias("object"), (k % 700).cast("double").alias("x"), (k % 900).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(20.0).alias("h"), F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"))
    ways = F.array(*(F.struct(F.lit(t).alias("transform"), F.lit(a).alias("a"), F.lit(a).alias("d"), F.lit(e).alias("e"), F.lit(e).alias("f")) for t, a, e in ((0, 1.0, 0.0), (1, 0.5, 0.0), (2, 0.5, 100.0))))
    return U.calibrate(boxes, boxes.select("object").distinct().select("object", F.explode(ways).alias("t")).select("object", "t.*"))


# ---- recognisers

_HEADS = "(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || p_partkey % 9 || ' ' || p_name WHEN 1 THEN p_size || '. ' || p_name WHEN 2 THEN '  ' || p_size || ' ' || p_name WHEN 3 THEN p_partkey + 100 || ' ' || p_name WHEN 4 THEN p_size || '.' || p_name ELSE p_size || '.1.2 ' || p_size END AS t FROM part)"


@query(f"SELECT p_partkey, number, CASE WHEN number IS NOT NULL THEN CAST(length(number) - length(replace(number, '.', '')) + 1 AS INTEGER) END AS level FROM (SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]{{3,}}$') THEN NULL ELSE nullif(n, '') END AS number FROM (SELECT p_partkey, regexp_extract(t, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\.?\\s+(\\p{{L}}.*)$', 1) AS n FROM {_HEADS}))")
def section_number_parse(spark, d):
    """Numbers and levels of headings."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    t = F.when(k % 6 == 0, _text(size, ".", k % 9, " ", name)).when(k % 6 == 1, _text(size, ". ", name)).when(k % 6 == 2, _text("  ", size, " ", name)).when(k % 6 == 3, _text(k + 100, " ", name)).when(k % 6 == 4, _text(size, ".", name)).otherwise(_text(size, ".1.2 ", size))
    rows = load(spark, d, "part").select(k, t.alias("t"))
    return rows.select("p_partkey", S.section_number("t").alias("number"), S.section_level("t").alias("level"))


@query("""SELECT p_partkey, CASE k WHEN 0 THEN 'figure_caption' WHEN 1 THEN 'table_caption' WHEN 2 THEN 'table_caption' WHEN 3 THEN 'figure_caption' END AS kind, CASE k WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'IV' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_partkey AS VARCHAR) END AS number FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def caption_detect(spark, d):
    """Captions by label and number; a label without a number near it is none."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    t = F.when(k % 6 == 0, _text("Figure ", size, ": ", name)).when(k % 6 == 1, _text("TABLE IV. ", name)).when(k % 6 == 2, _text(" table ", size)).when(k % 6 == 3, _text("Fig. ", k, name)).when(k % 6 == 4, _text("Figure of ", name, size)).otherwise(_text("The figure ", size))
    rows = load(spark, d, "part").select(k, t.alias("t"))
    return rows.select("p_partkey", S.caption_kind("t").alias("kind"), S.caption_number("t").alias("number"))


@query("""SELECT p_partkey, CASE k WHEN 0 THEN 'theorem' WHEN 1 THEN 'lemma' WHEN 2 THEN 'definition' WHEN 3 THEN 'proof' WHEN 4 THEN 'proof' END AS kind, CASE k WHEN 0 THEN p_size || '.' || p_partkey % 7 WHEN 1 THEN 'A.' || p_size END AS number FROM (SELECT *, p_partkey % 7 AS k FROM part)""")
def theorem_detect(spark, d):
    """Openings of theorems and proofs."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    t = F.when(k % 7 == 0, _text("Theorem ", size, ".", k % 7, ". Every ", name)).when(k % 7 == 1, _text(" LEMMA A.", size, " (", name, ")")).when(k % 7 == 2, _text("Definition: ", name)).when(k % 7 == 3, _text("Proof of ", name)).when(k % 7 == 4, F.lit("Proof.")).when(k % 7 == 5, _text("Theorems ", size, ".")).otherwise(_text("Proofs ", name))
    rows = load(spark, d, "part").select(k, t.alias("t"))
    return rows.select("p_partkey", S.theorem_kind("t").alias("kind"), S.theorem_number("t").alias("number"))


@query("SELECT doc_id, CASE WHEN full_chars = 0 THEN 0.0 ELSE round(letters / full_chars, 9) END AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS full_chars, CAST(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS DOUBLE) AS letters FROM documents)")
def alpha_ratio(spark, d):
    """Share of letters of each document."""
    return load(spark, d, "documents").select("doc_id", F.round(S.alpha_ratio("text"), 9).alias("ratio"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN '0000-0002-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-12' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS orcid FROM customer""")
def orcid_normal(spark, d):
    """ORCIDs of any spelling: bare, as a URL, with slashes and blanks after it."""
    k = F.col("c_custkey")
    bare = _text("0000-0002-", F.lpad((k % 10000).cast("string"), 4, "0"), "-12", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    t = F.when(k % 5 == 0, bare).when(k % 5 == 1, _text("https://orcid.org/", bare, "/")).when(k % 5 == 2, _text("  ", bare, " ")).when(k % 5 == 3, _text("orcid.org//", bare, "//")).otherwise(_text(bare, "x"))
    return load(spark, d, "customer").select("c_custkey", S.normalize_orcid(t).alias("orcid"))
