"""Queries over the library operators, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import scalars as S
from folioscan.operators import relational as R
from folioscan.operators import search as T
from folioscan.sources.tables import ENTRIES_SQL, LINES_SQL, TAGS_SQL, entries, entry_tags, load, page_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function under its name, with its oracle."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scans, filters, scopes


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_projection(spark, d):
    """Full scan of four columns."""
    return load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def scan_by_key(spark, d):
    """Primary-key lookup; the predicate reaches the scan."""
    return load(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT id, entry_type, lang FROM " + ENTRIES_SQL + " e WHERE entry_type IN ('src1', 'src3') AND lang IN ('en', 'fr')")
def in_list(spark, d):
    """IN-lists."""
    return entries(spark, d).where(F.col("entry_type").isin("src1", "src3") & F.col("lang").isin("en", "fr")).select("id", "entry_type", "lang")


@query("SELECT id, size FROM " + ENTRIES_SQL + " e WHERE size >= 500 AND size <= 1500")
def range_filter(spark, d):
    """Range predicate; nulls fail."""
    return R.compound_filter(entries(spark, d), low=500, high=1500).select("id", "size")


_ATTACHED = "(SELECT doc_id AS id FROM labels)"


@query("SELECT id, entry_type, size FROM " + ENTRIES_SQL + " e WHERE entry_type IN ('src0', 'src2', 'src4', 'src6') AND size BETWEEN 200 AND 5000 AND starred AND id IN " + _ATTACHED)
def compound_filter(spark, d):
    """All axes at once: types, range, tri-state flag, semi join."""
    labelled = load(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return R.compound_filter(entries(spark, d), ["src0", "src2", "src4", "src6"], 200, 5000, True, with_rows=labelled).select("id", "entry_type", "size")


@query("SELECT id, starred FROM " + ENTRIES_SQL + " e WHERE NOT starred AND id NOT IN " + _ATTACHED)
def tri_state_false(spark, d):
    """Flags that must be false: unstarred, without a label row."""
    labelled = load(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return R.compound_filter(entries(spark, d), starred=False, without_rows=labelled).select("id", "starred")


@query(f"SELECT id FROM {ENTRIES_SQL} e WHERE id IN (SELECT entry_id FROM {TAGS_SQL} t WHERE tag IN ('quality', 'toxic'))")
def tags_or(spark, d):
    """Entries with any of the tags."""
    return R.tagged(entries(spark, d), entry_tags(spark, d), ["quality", "toxic"], False).select("id")


@query(f"SELECT id FROM {ENTRIES_SQL} e WHERE id IN (SELECT entry_id FROM {TAGS_SQL} t WHERE tag = 'quality') AND id IN (SELECT entry_id FROM {TAGS_SQL} t WHERE tag = 'toxic')")
def tags_and(spark, d):
    """Entries with every tag (relational division)."""
    return R.tagged(entries(spark, d), entry_tags(spark, d), ["quality", "toxic"], True).select("id")


@query(f"SELECT id, title FROM {ENTRIES_SQL} e WHERE NOT trashed AND NOT EXISTS (SELECT 1 FROM {TAGS_SQL} t WHERE t.entry_id = e.id)")
def unfiled(spark, d):
    """Live entries without a tag."""
    return R.scoped(entries(spark, d), "unfiled", entry_tags(spark, d)).select("id", "title")


@query(f"SELECT 'live' AS view, count(*) AS n FROM {ENTRIES_SQL} WHERE NOT trashed UNION ALL SELECT 'trash', count(*) FROM {ENTRIES_SQL} WHERE trashed UNION ALL SELECT 'starred', count(*) FROM {ENTRIES_SQL} WHERE NOT trashed AND starred")
def view_scopes(spark, d):
    """How many entries each view shows."""
    e = entries(spark, d)
    parts = [R.scoped(e, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "n") for v in ("live", "trash", "starred")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"SELECT id, title FROM (SELECT id, title FROM {ENTRIES_SQL} WHERE NOT trashed ORDER BY id DESC LIMIT 8) ORDER BY title, id")
def recent_view(spark, d):
    """The first 8 of the list, then sorted by title."""
    return R.scoped(entries(spark, d), "live").orderBy(F.desc("id")).limit(8).select("id", "title").orderBy("title", "id")


@query("SELECT conv_id, turn, before FROM (SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM conversations) WHERE before < 1000")
def page_window_budget(spark, d):
    """Messages of each conversation until a character budget is spent."""
    return R.budget(load(spark, d, "conversations"), "conv_id", "turn", "text", 1000).select("conv_id", "turn", "before")


@query("""SELECT conv_id, turn, rn, before FROM (SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS BIGINT) AS rn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM conversations WHERE role = 'assistant' AND turn >= 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE before < 2000 AND rn < 3""")
def block_window(spark, d):
    """Blocks of a kind from an offset, with a count and a character budget."""
    rows = load(spark, d, "conversations").where("role = 'assistant' and turn >= 1")
    return R.positions(R.budget(rows, "conv_id", "turn", "text", 2000), "conv_id", ["turn"]).where("position < 3").select("conv_id", "turn", F.col("position").alias("rn"), "before")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def collapse_space(spark, d):
    """White space collapsed."""
    return load(spark, d, "documents").select("doc_id", S.collapse_space("text").alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_work(spark, d):
    """Documents without a label: what still has to be done."""
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


# ---- full text


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'hand')")
def text_match_all_tokens(spark, d):
    """Every token as a case-folded substring."""
    return load(spark, d, "documents").where(T.matches(["text"], ["the", "tion", "HAND"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'é') AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ou.')")
def text_match_short_token(spark, d):
    """A short token: plain substrings, ASCII folding, wildcards taken literally."""
    return load(spark, d, "documents").where(T.matches(["text"], ["é", "OU."])).select("doc_id")


def _bm25_sql(tokens: list[str], table: str, key: str, column: str, scope: str = "") -> str:
    f = [f"(length(lower({column})) - length(replace(lower({column}), '{t}', ''))) / {len(t)}.0 AS f{k}" for k, t in enumerate(tokens)]
    hit = " AND ".join(f"f{k} > 0" for k in range(len(tokens)))
    idf = [f"CASE WHEN n{k} * 2 >= n THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END" for k in range(len(tokens))]
    score = " - ".join(f"({i}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k, i in enumerate(idf))
    return f"""WITH r AS (SELECT {key}, greatest(length({column}) - 2, 0) AS dl, {', '.join(f)} FROM {table}),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (f{k} > 0) AS n{k}' for k in range(len(tokens)))} FROM r)
SELECT {key}, round(- {score}, 6) AS score FROM r, s WHERE {hit} {scope}"""


@query(_bm25_sql(["thand", "ersh"], "documents", "doc_id", "text"))
def text_bm25(spark, d):
    """BM25 of every match, rounded."""
    return T.bm25(load(spark, d, "documents"), "doc_id", ["text"], ["thand", "ersh"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, score FROM ({_bm25_sql(['onre'], 'documents', 'doc_id', 'text')}) ORDER BY score, doc_id LIMIT 20")
def text_bm25_topk(spark, d):
    """The 20 best matches."""
    found = T.bm25(load(spark, d, "documents"), "doc_id", ["text"], ["onre"]).select("doc_id", F.round("score", 6).alias("score"))
    return found.orderBy("score", "doc_id").limit(20)


@query(_bm25_sql(["thand"], "documents", "doc_id", "text", "AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"))
def text_bm25_scoped(spark, d):
    """BM25 within a scope; the statistics are the whole index's."""
    scope = load(spark, d, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return T.bm25(load(spark, d, "documents"), "doc_id", ["text"], ["thand"], scope).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'ersh') > 0 THEN substring(text, greatest(strpos(lower(text), 'ersh') - 20, 1), 60) ELSE substring(text, 1, 200) END AS snippet FROM documents")
def text_snippet(spark, d):
    """A window around the first occurrence."""
    return load(spark, d, "documents").select("doc_id", T.snippet("text", "ersh").alias("snippet"))


@query(f"SELECT l.attachment_id, l.page, e.title FROM {LINES_SQL} l JOIN {ENTRIES_SQL} e ON e.id = l.attachment_id WHERE NOT e.trashed AND contains(lower(l.content), 'thand') AND contains(lower(l.content), 'onre')")
def page_search(spark, d):
    """Pages that match, joined to their live entries."""
    hits = page_lines(spark, d).where(T.matches(["content"], ["thand", "onre"]))
    live = R.scoped(entries(spark, d), "live").select(F.col("id").alias("attachment_id"), "title")
    return hits.join(live, "attachment_id").select("attachment_id", "page", "title")


@query(f"SELECT h.attachment_id, h.page, e.title FROM (SELECT * FROM {LINES_SQL} l WHERE contains(lower(content), 'ersh') ORDER BY attachment_id, page LIMIT 51) h JOIN {ENTRIES_SQL} e ON e.id = h.attachment_id")
def block_search(spark, d):
    """The first 51 hits (one more than a page shows), cut before they are joined to their entries."""
    hits = page_lines(spark, d).where(T.matches(["content"], ["ersh"])).orderBy("attachment_id", "page").limit(51)
    return hits.join(entries(spark, d).select(F.col("id").alias("attachment_id"), "title"), "attachment_id").select("attachment_id", "page", "title")


@query(f"SELECT id FROM {ENTRIES_SQL} e WHERE contains(lower(text), 'thand') AND lang = 'en' AND starred AND size >= 1000")
def search_with_filter(spark, d):
    """A text query and a compound filter."""
    return R.compound_filter(entries(spark, d).where(T.matches(["text", "title"], ["thand"])), low=1000, starred=True).where("lang = 'en'").select("id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '0001') ORDER BY lower(c_name), c_custkey LIMIT 10")
def author_search(spark, d):
    """People by part of the name, in case-insensitive order, limited."""
    return load(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("0001"))).orderBy(F.lower("c_name"), "c_custkey").limit(10).select("c_custkey", "c_name")


@query(f"SELECT attachment_id, (page - 1) // 5 + 1 AS page, string_agg(content, ' ' ORDER BY page) AS body FROM {LINES_SQL} GROUP BY 1, 2")
def index_build(spark, d):
    """The page index: one row a page of five lines, in their order, blank lines left out."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("page").alias("line"), "content")))
    pages = page_lines(spark, d).groupBy("attachment_id", (F.floor((F.col("page") - 1) / 5) + 1).alias("at")).agg(lines.alias("lines"))
    return pages.select("attachment_id", F.col("at").alias("page"), F.array_join(F.transform("lines", lambda x: x["content"]), " ").alias("body"))


# ---- joins


@query("SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def bridge_join(spark, d):
    """Hydration over bridges: one plan of equi joins."""
    t = lambda n: load(spark, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join(spark, d):
    """EXISTS."""
    big = load(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_join(spark, d):
    """NOT EXISTS."""
    big = load(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT a, b FROM (SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey AND (x.s_nationkey = y.s_nationkey OR floor(x.s_acctbal / 500) = floor(y.s_acctbal / 500)))")
def conflict_pairs(spark, d):
    """Rows that share one of several keys, by equality on exploded keys."""
    rows = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 500).alias("band"))
    return R.conflict_pairs(rows, "s_suppkey", ["s_nationkey", "band"])


@query("SELECT node, direction, count(DISTINCT other) AS n FROM (SELECT l_partkey AS node, l_suppkey AS other, 'out' AS direction FROM lineitem UNION ALL SELECT l_suppkey, l_partkey, 'in' FROM lineitem) GROUP BY node, direction")
def undirected_edges(spark, d):
    """Edges seen from both ends."""
    return R.undirected(load(spark, d, "lineitem"), "l_partkey", "l_suppkey").groupBy("node", "direction").agg(F.count_distinct("other").alias("n"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_version_per_key(spark, d):
    """Of each key the row with the largest id."""
    return R.latest(load(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT o_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS first_part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def first_by_position(spark, d):
    """The part of each order's first line."""
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return load(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey").groupBy("o_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def primary_fragment(spark, d):
    """A boolean-first order, then position: the first row of each group."""
    order = [F.desc(F.col("l_returnflag") == "R"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return R.best(load(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey")
def hydrate_nested(spark, d):
    """Children as one ordered list."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["l_linenumber"].cast("string"), p["l_partkey"].cast("string"))), ",").alias("lines"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS n FROM events) WHERE n = 1")
def representation_choice(spark, d):
    """Preferred kind first, then the smallest id."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return R.best(load(spark, d, "events"), ["user_id"], [rank, F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, last_click FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events) WHERE event_type = 'purchase'")
def asof_backward(spark, d):
    """Each purchase with the click before it (as-of)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = load(spark, d, "events").withColumn("last_click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "last_click")


@query("SELECT p_partkey, first_order, n FROM (SELECT p_partkey FROM part) p JOIN (SELECT l_partkey, min(l_orderkey) AS first_order, count(*) AS n FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p_partkey")
def label_lookup(spark, d):
    """Names to their first definition."""
    firsts = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("n"))
    return load(spark, d, "part").select("p_partkey").join(firsts, "p_partkey")


# ---- aggregates


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT trashed AND starred) AS starred, count(*) FILTER (trashed) AS trash, count(*) FILTER (NOT trashed AND NOT EXISTS (SELECT 1 FROM {TAGS_SQL} t WHERE t.entry_id = e.id)) AS unfiled FROM {ENTRIES_SQL} e")
def sidebar_counts(spark, d):
    """Global counts in one pass."""
    tags = entry_tags(spark, d).select(F.col("entry_id").alias("id")).distinct().withColumn("has_tag", F.lit(True))
    live = ~F.col("trashed")
    return entries(spark, d).join(tags, "id", "left").agg(F.count("*").alias("total"), F.count_if(live & F.col("starred")).alias("starred"), F.count_if("trashed").alias("trash"), F.count_if(live & F.col("has_tag").isNull()).alias("unfiled"))


@query(f"SELECT tag, count(*) AS n FROM {TAGS_SQL} t JOIN {ENTRIES_SQL} e ON e.id = t.entry_id WHERE NOT e.trashed OR tag = 'toxic' GROUP BY tag")
def tag_counts(spark, d):
    """Entries of each tag."""
    return entry_tags(spark, d).join(entries(spark, d).select(F.col("id").alias("entry_id"), "trashed"), "entry_id").where("not trashed or tag = 'toxic'").groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS keep FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """Keys that occur more than once, and the row to keep."""
    return load(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keep")).where("n > 1")


@query("SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def ordered_concat(spark, d):
    """Ordered string concatenation."""
    return load(spark, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ' ') within group (order by n_name)").alias("names"))


@query("SELECT source, min(n_chars) AS least, max(n_chars) AS most, CAST(coalesce(sum(n_chars) FILTER (lang = 'es'), 0) AS BIGINT) AS es_chars, median(n_chars) AS middle FROM documents GROUP BY source")
def group_statistics(spark, d):
    """Minimum, maximum, sum with a default, exact median."""
    return load(spark, d, "documents").groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.coalesce(F.sum(F.when(F.col("lang") == "es", F.col("n_chars"))), F.lit(0)).alias("es_chars"), F.median("n_chars").alias("middle"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 40")
def distinct_rows(spark, d):
    """DISTINCT."""
    return load(spark, d, "lineitem").where("l_quantity > 40").select("l_suppkey", "l_returnflag").distinct()


@query(f"SELECT attachment_id, count(*) AS pages, max(page) AS last_page FROM {LINES_SQL} GROUP BY attachment_id")
def page_counts(spark, d):
    """Pages of each attachment."""
    return page_lines(spark, d).groupBy("attachment_id").agg(F.count("*").alias("pages"), F.max("page").alias("last_page"))


@query("SELECT conv_id, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id, role")
def kind_histogram(spark, d):
    """Blocks of each kind."""
    return load(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def outcome_counters(spark, d):
    """Counters of a batch by outcome."""
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_SUPERSEDED = "(SELECT event_id, user_id, value FROM events e WHERE event_id < (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id))"


@query(f"SELECT count(*) AS targets, count(DISTINCT user_id) AS keys, round(sum(value), 2) AS total FROM {_SUPERSEDED}")
def multi_metric_preview(spark, d):
    """Several numbers over one set of targets, in one pass."""
    e = load(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    return e.join(last, "user_id").where("event_id < last").agg(F.count("*").alias("targets"), F.count_distinct("user_id").alias("keys"), F.round(F.sum("value"), 2).alias("total"))


# ---- ordered computations


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position FROM conversations")
def sequential_position(spark, d):
    """Positions from 0."""
    return R.positions(load(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "position")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def current_section(spark, d):
    """The last section start at or before each block."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("section"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_occurrence(spark, d):
    """First occurrence of each (key, kind)."""
    return R.best(load(spark, d, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT conv_id, turn, part FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM (SELECT conv_id, turn,
  CAST(sum(CASE WHEN gap IS NULL OR gap > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS part FROM (SELECT *, abs(length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)) AS gap FROM conversations)))""")
def block_grouping(spark, d):
    """Groups split where the gap to the row before is large."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, d, "conversations").withColumn("gap", F.abs(F.char_length("text") - F.lag(F.char_length("text")).over(w)))
    return rows.select("conv_id", "turn", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 150), 1).otherwise(0)).over(w).alias("part"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY lower(source), n_chars DESC, doc_id LIMIT 25 OFFSET 10")
def limit_offset(spark, d):
    """Case-insensitive order, with LIMIT and OFFSET."""
    return load(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.lower("source"), F.desc("n_chars"), "doc_id").offset(10).limit(25)


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 8")
def keep_largest(spark, d):
    """The 8 largest of each group."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, d, "documents").withColumn("n", F.row_number().over(w)).where("n <= 8").select("source", "doc_id", "n_chars")


@query("SELECT l_suppkey, count(*) > 12 AS cut, array_to_string(list_slice(list(DISTINCT l_partkey ORDER BY l_partkey), 1, 12), ',') AS parts FROM lineitem GROUP BY l_suppkey")
def capped_list(spark, d):
    """Sorted related ids, capped, with a flag."""
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count("*") > 12).alias("cut"), F.array_join(F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 12).cast("array<string>"), ",").alias("parts"))


# ---- set operations and changes


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    """Set difference."""
    return load(spark, d, "documents").select("doc_id").subtract(load(spark, d, "labels").select("doc_id"))


_OLD, _NEW = "(SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING')", "(SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_acctbal > 5000)"


def _old_new(spark, d):
    c = load(spark, d, "customer")
    return c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("v"))


@query(f"SELECT k, v FROM {_NEW} UNION ALL SELECT k, v FROM {_OLD} WHERE k NOT IN (SELECT k FROM {_NEW})")
def upsert(spark, d):
    """New rows replace old ones of the same key."""
    return R.upsert(*_old_new(spark, d), "k")


@query(f"SELECT k, v FROM {_OLD} UNION ALL SELECT k, v FROM {_NEW} WHERE k NOT IN (SELECT k FROM {_OLD})")
def idempotent_insert(spark, d):
    """Only rows with a new key are added."""
    return R.insert_missing(*_old_new(spark, d), ["k"])


@query(f"SELECT n.k, o.k IS NOT NULL AS found FROM {_NEW} n LEFT JOIN {_OLD} o ON n.k = o.k")
def batch_partition(spark, d):
    """Which keys of a batch exist."""
    old, new = _old_new(spark, d)
    return new.select("k").join(old.select("k", F.lit(True).alias("f")), "k", "left").select("k", F.coalesce("f", F.lit(False)).alias("found"))


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderkey")
def cascade_delete(spark, d):
    """What is left of orders and their lines when customers are deleted."""
    gone = load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    left = load(spark, d, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("x"))
    return left.join(li, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("x").alias("n"))


@query(f"SELECT id, trashed OR size < 300 AS trashed FROM {ENTRIES_SQL} e WHERE NOT (trashed AND size > 3000)")
def soft_delete_purge(spark, d):
    """Small entries move to the trash, large trashed ones are purged."""
    return entries(spark, d).where("not (trashed and size > 3000)").select("id", (F.col("trashed") | (F.col("size") < 300)).alias("trashed"))


# ---- versions


@query("SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent, CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) THEN 'completed' ELSE 'superseded' END AS status FROM events")
def version_lifecycle(spark, d):
    """Versions with their parent and status."""
    w = Window.partitionBy("user_id")
    status = F.when(F.col("event_id") == F.max("event_id").over(w), "completed").otherwise("superseded")
    return load(spark, d, "events").select("event_id", "user_id", F.lag("event_id").over(w.orderBy("event_id")).alias("parent"), status.alias("status"))


@query("SELECT e.event_id FROM events e WHERE e.event_type <> 'purchase' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id > e.event_id) AND NOT EXISTS (SELECT 1 FROM events y WHERE y.user_id = e.user_id AND y.event_type = 'purchase' AND y.event_id % 30 = 0)")
def gc_targets(spark, d):
    """Superseded versions of keys that nothing protects."""
    e = load(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last"), F.count_if((F.col("event_type") == "purchase") & (F.col("event_id") % 30 == 0)).alias("kept"))
    return e.join(last, "user_id").where("event_id < last and kept = 0 and event_type <> 'purchase'").select("event_id")


@query("SELECT doc_id, sha256(coalesce(text, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(source, '')) AS content_key FROM documents")
def content_key(spark, d):
    """SHA-256 of the joined parts."""
    return load(spark, d, "documents").select("doc_id", S.content_hash("text", "lang", "source").alias("content_key"))


@query("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 50")
def session_listing(spark, d):
    """The 50 longest sessions."""
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("""SELECT conv_id, turn, 'present' AS state FROM conversations UNION ALL SELECT conv_id, turn + 1, 'missing' FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user' AND (nxt IS NULL OR nxt <> 'assistant')""")
def conversation_reconcile(spark, d):
    """Messages, with a placeholder after each question that has no answer."""
    rows = load(spark, d, "conversations")
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    gaps = rows.withColumn("nxt", nxt).where("role = 'user' and (nxt is null or nxt <> 'assistant')")
    return rows.select("conv_id", "turn", F.lit("present").alias("state")).union(gaps.select("conv_id", F.col("turn") + 1, F.lit("missing")))


# ---- identity, trees, scalars


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
p AS (SELECT id, name, name AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.name, p.path || '/' || n.name, p.depth + 1 FROM n JOIN p ON n.parent = p.id) SELECT id, name, path, depth FROM p""")
def collection_paths(spark, d):
    """Paths of a tree."""
    t = lambda n: load(spark, d, n)
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t("region").select(of("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.union(t("nation").select(of("n", "n_nationkey"), of("r", "n_regionkey"), "n_name")).union(t("supplier").select(of("s", "s_suppkey"), of("n", "s_nationkey"), "s_name"))
    return R.tree_paths(nodes, "id", "parent", "name")


_LETTERS = "CASE WHEN n <= 0 THEN '' WHEN n <= 26 THEN chr(96 + n) WHEN n <= 702 THEN chr(97 + (n - 27) // 26) || chr(97 + (n - 27) % 26) ELSE chr(97 + (n - 703) // 676) || chr(97 + ((n - 703) // 26) % 26) || chr(97 + (n - 703) % 26) END"


@query(f"SELECT c_custkey, base || {_LETTERS} AS key FROM (SELECT c_custkey, base, CAST(row_number() OVER (PARTITION BY base ORDER BY c_custkey DESC) - 1 AS INTEGER) AS n FROM (SELECT c_custkey, lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) AS base FROM customer))")
def citation_keys(spark, d):
    """Base keys made unique by letters, newest first."""
    c = load(spark, d, "customer")
    base = S.base_citation_key(F.col("c_mktsegment"), F.col("c_name"), F.col("c_name"), F.col("c_nationkey"))
    rows = c.select("c_custkey", base.alias("base")).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("c_custkey"))) - 1)
    return rows.select("c_custkey", F.concat("base", S.suffix_letters(F.col("n"))).alias("key"))


@query("""SELECT page_id, nullif(lower(trim(regexp_replace(trim(u), '^(https://doi\\.org/|http://doi\\.org/|https://dx\\.doi\\.org/|http://dx\\.doi\\.org/|doi:|DOI:)', ''))), '') AS doi,
  nullif(lower(regexp_replace(regexp_replace(trim(v), '^(arXiv:|arxiv:)', ''), 'v[0-9]+$', '')), '') AS arxiv, nullif(upper(regexp_replace(url, '[^0-9A-Za-z]', '', 'g')), '') AS isbn, nullif(regexp_replace(url, '[^A-Za-z0-9_:./+-]', '', 'g'), '') AS key
  FROM (SELECT page_id, url, 'https://doi.org/10.' || page_id || '/Ab' AS u, 'arXiv:' || page_id || '.0001v' || (page_id % 5) AS v FROM pages)""")
def canonical_identifiers(spark, d):
    """DOI, arXiv, ISBN and key forms."""
    p = load(spark, d, "pages")
    i = F.col("page_id").cast("string")
    return p.select("page_id", S.canonical_doi(F.concat(F.lit("https://doi.org/10."), i, F.lit("/Ab"))).alias("doi"), S.canonical_arxiv(F.concat(F.lit("arXiv:"), i, F.lit(".0001v"), (F.col("page_id") % 5).cast("string"))).alias("arxiv"), S.canonical_isbn("url").alias("isbn"), S.sanitize_citation_key("url").alias("key"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '') AS lang, length(regexp_replace(html, '<[^>]*(>|$)', '', 'g')) AS text_length FROM pages")
def web_clip_extract(spark, d):
    """Title, language and stripped length of web pages."""
    nz = lambda c: F.nullif(c, F.lit(""))
    return load(spark, d, "pages").select("page_id", nz(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), nz(F.regexp_extract("html", 'lang="([a-z]+)"', 1)).alias("lang"), F.char_length(S.strip_tags("html")).cast("long").alias("text_length"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '…' ELSE text END AS text FROM documents")
def clip_text(spark, d):
    """Text cut with an ellipsis."""
    return load(spark, d, "documents").select("doc_id", S.clip("text", 40).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, CAST(json_extract_string(props, '$.ms') AS BIGINT) AS ms FROM events")
def event_props_json(spark, d):
    """Fields of a JSON payload."""
    return load(spark, d, "events").select("event_id", S.json_pick("props", "page").alias("page"), S.json_pick("props", "ms", "long").alias("ms"))


_RATIO = "CASE WHEN length(regexp_replace(content, '\\s', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(content, '[^\\pL]', '', 'g')) / length(regexp_replace(content, '\\s', '', 'g')) END"


@query(f"SELECT attachment_id, page, round({_RATIO}, 6) AS ratio, length(content) - length(translate(content, '{S.STRONG_MATH}', '')) AS strong FROM {LINES_SQL}")
def math_features(spark, d):
    """Share of letters and number of mathematical characters of each line."""
    return page_lines(spark, d).select("attachment_id", "page", F.round(S.alpha_ratio("content"), 6).alias("ratio"), S.strong_math("content").cast("long").alias("strong"))
