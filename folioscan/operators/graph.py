"""Cross-references, symbols and context bundles over document nodes.

Nodes are (version, node, ordinal, kind, text, labels, number); ``ordinal`` is the reading order within a version. What is
ambiguous or unresolved gives no edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.sources.store import discard, save

# Macros and words that refer, decorations and words that define.
EQUATION_MACROS = ("eqref",)
REFERENCE_MACROS = ("ref", "autoref", "cref", "Cref", "vref", "Vref", "labelcref", "nameref")
CITE_MACROS = ("cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citenum", "Citep", "Citet", "Citealp", "Citealt", "parencite", "Parencite", "textcite", "Textcite", "autocite", "Autocite", "footcite", "smartcite")
THEOREM_WORDS = ("Theorem", "Lemma", "Proposition", "Corollary", "Definition", "Remark", "Example")
EQUATION_WORDS, FIGURE_WORDS, TABLE_WORDS = ("Equation", "Eqs", "Eq"), ("Figure", "Fig"), ("Table",)
DECORATIONS = ("mathbf", "mathcal", "mathrm", "mathbb", "mathsf", "mathfrak", "mathit", "boldsymbol", "bm", "vec", "hat", "tilde", "bar", "overline", "underline", "operatorname")
TEX_CONFIDENCE, TEXT_CONFIDENCE, NUMBERED_PROOF, PLAIN_PROOF, OCCURRENCE = 0.9, 0.6, 0.7, 0.6, 0.5
THEOREMS = tuple(w.lower() for w in THEOREM_WORDS)


def tex_references(nodes: DataFrame) -> DataFrame:
    """(version, node, macro, key): every key of a reference or citation macro, optional arguments passed over."""
    macros = "|".join(sorted(EQUATION_MACROS + REFERENCE_MACROS + CITE_MACROS, key=len, reverse=True))
    pattern = rf"\\({macros})\*?(?:\[[^\]]*\])*\{{([^}}]*)\}}"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("macro"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("keys"))
    rows = nodes.select("version", "node", F.explode(both).alias("m")).select("version", "node", F.col("m.macro").alias("macro"), F.explode(F.split("m.keys", ",")).alias("key"))
    return rows.withColumn("key", F.trim("key")).where("key <> ''").distinct()


def text_references(nodes: DataFrame) -> DataFrame:
    """(version, node, category, number): words like ``Lemma 2.3``, ``Eq. (4)`` or ``Fig. 2`` in running text."""
    words = "|".join(THEOREM_WORDS + EQUATION_WORDS + FIGURE_WORDS + TABLE_WORDS)
    pattern = rf"(?<![A-Za-z])({words})\.?[\s~]+\(?([0-9]+(?:\.[0-9]+)*[a-z]?|[A-Z]\.[0-9]+(?:\.[0-9]+)*)"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("word"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("number"))
    rows = nodes.select("version", "node", F.explode(both).alias("m")).select("version", "node", F.col("m.word").alias("word"), F.col("m.number").alias("number"))
    category = F.when(F.col("word").isin(*EQUATION_WORDS), "equation").when(F.col("word").isin(*FIGURE_WORDS), "figure").when(F.col("word").isin(*TABLE_WORDS), "table").otherwise(F.lower("word"))
    return rows.select("version", "node", category.alias("category"), "number").distinct()


def _relation(kind: F.Column) -> F.Column:
    return F.when(kind == "display_math", "refers_to_equation").when(kind.isin("figure", "figure_caption"), "refers_to_figure").when(kind.isin("table", "table_caption"), "refers_to_table").when(kind == "bibliography_entry", "cites").when(kind == "definition", "uses_definition").when(kind.isin(*THEOREMS), "refers_to_theorem").otherwise("refers_to")


def tex_edges(nodes: DataFrame) -> DataFrame:
    """Edges (version, source, relation, target, confidence) from labels; the first node that has a label owns it."""
    owners = nodes.select("version", F.explode("labels").alias("key"), "ordinal", "node", "kind").groupBy("version", "key").agg(F.min_by(F.struct("node", "kind"), F.struct("ordinal", "node")).alias("t"))
    joined = tex_references(nodes).join(owners, ["version", "key"]).where("node <> t.node")
    joined = joined.where((F.col("t.kind") == "bibliography_entry") == F.col("macro").isin(*CITE_MACROS))
    return joined.select("version", F.col("node").alias("source"), _relation(F.col("t.kind")).alias("relation"), F.col("t.node").alias("target"), F.lit(TEX_CONFIDENCE).alias("confidence")).distinct()


def text_edges(nodes: DataFrame) -> DataFrame:
    """Edges from numbers in text: theorems and equations to their first bearer, floats only when one alone has the number.

    A figure or table goes before its caption of the same number.
    """
    category = F.when(F.col("kind") == "display_math", "equation").when(F.col("kind").isin("figure", "figure_caption"), "figure").when(F.col("kind").isin("table", "table_caption"), "table").otherwise(F.col("kind"))
    bearers = nodes.where("number is not null").withColumn("category", category).withColumn("number", F.regexp_replace("number", "[()]", ""))
    entity = F.when(F.col("kind").isin("figure", "table"), 0).otherwise(1)
    ranked = bearers.withColumn("entity", entity).withColumn("top", F.min("entity").over(Window.partitionBy("version", "category", "number")))
    owners = ranked.where("entity = top").groupBy("version", "category", "number").agg(F.count("*").alias("n"), F.min_by(F.struct("node", "kind"), F.struct("ordinal", "node")).alias("t"))
    owners = owners.where("n = 1 or category not in ('figure', 'table')")
    joined = text_references(nodes).join(owners, ["version", "category", "number"]).where("node <> t.node")
    return joined.select("version", F.col("node").alias("source"), _relation(F.col("t.kind")).alias("relation"), F.col("t.node").alias("target"), F.lit(TEXT_CONFIDENCE).alias("confidence")).distinct()


def proves_edges(nodes: DataFrame) -> DataFrame:
    """Each proof to the theorem it names (``Proof of Lemma 2.3``), else to the nearest one before it (as-of)."""
    w = Window.partitionBy("version").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    proofs = nodes.withColumn("before", F.last(F.when(F.col("kind").isin(*THEOREMS), F.col("node")), ignorenulls=True).over(w)).where("kind = 'proof'")
    named = rf"(?i)^\W*(?:proof\s+)?of\s+(?:the\s+)?({'|'.join(THEOREMS)})\s+([0-9]+(?:\.[0-9]+)*)"
    text = F.concat_ws(" ", "note", "text") if "note" in nodes.columns else F.col("text")
    proofs = proofs.withColumn("category", F.lower(F.regexp_extract(text, named, 1))).withColumn("number", F.regexp_extract(text, named, 2)).select("version", F.col("node").alias("source"), "before", "category", "number")
    owners = nodes.where(F.col("kind").isin(*THEOREMS) & F.col("number").isNotNull()).groupBy("version", F.col("kind").alias("category"), "number").agg(F.min_by("node", "ordinal").alias("named"))
    joined = proofs.join(owners, ["version", "category", "number"], "left")
    target = F.coalesce("named", F.when(F.col("number") == "", F.col("before")))
    return joined.select("version", "source", F.lit("proves").alias("relation"), target.alias("target"), F.when(F.col("named").isNotNull(), NUMBERED_PROOF).otherwise(PLAIN_PROOF).alias("confidence")).where("target is not null")


def edges(nodes: DataFrame) -> DataFrame:
    """All edges; of one kind between two nodes the most certain stays."""
    every = tex_edges(nodes).union(text_edges(nodes)).union(proves_edges(nodes))
    return every.groupBy("version", "source", "relation", "target").agg(F.max("confidence").alias("confidence"))


# ---- symbols

_WORDS = re.compile(r"(?i)\b(?:let|define|denote|write|call)\s+(?:by\s+)?\$([^$]+)\$\s*(?:be|as|denote|for|:|,|the)?\s*([^$]{0,200})|\$([^$]+)\$\s+(?:denotes|is defined(?: as)?|is called|stands for)\s+([^$]{0,200})|\$([^$]+?)\s*:=\s*([^$]+)\$")
_TYPES = (("function", "function"), ("map", "function"), ("operator", "operator"), ("matrix", "matrix"), ("vector", "vector"), ("set", "set"), ("space", "space"), ("group", "group"), ("constant", "constant"), ("parameter", "parameter"), ("variable", "variable"))


def normal_symbol(surface: str) -> str:
    """A symbol without its decorations."""
    s = surface.strip()
    pattern = re.compile(r"^\\(?:" + "|".join(DECORATIONS) + r")\s*\{([^}]*)\}")
    while m := pattern.match(s):
        s = m[1] + s[m.end() :]
    return s.strip()


def is_symbol(s: str) -> bool:
    """Short, with a letter or command, and no space outside brackets."""
    s = s.strip()
    if not s or len(s) > 24 or not re.search(r"[A-Za-z\\]", s):
        return False
    flat = s
    while (less := re.sub(r"\{[^{}]*\}|\([^()]*\)|\[[^\[\]]*\]", "", flat)) != flat:
        flat = less
    return not re.search(r"[ \t]", flat)


def symbol_type(description: str) -> str:
    low = description.lower()
    return next((t for w, t in _TYPES if re.search(rf"\b{w}s?\b", low)), "unknown")


_SYMBOLS = "version long, node long, surface string, normal string, description string, type string, confidence double"


def definitions(nodes: DataFrame) -> DataFrame:
    """Symbols that inline formulas define in running text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for v, n, text in zip(frame["version"], frame["node"], frame["text"], strict=True):
                for m in _WORDS.finditer(text or ""):
                    surface, said = next((m[k], m[k + 1]) for k in (1, 3, 5) if m[k])
                    said = re.split(r"\. |; |\n", said, maxsplit=1)[0].strip(" .,;:").encode()[:160].decode(errors="ignore")
                    if is_symbol(surface):
                        rows.append((v, n, surface.strip(), normal_symbol(surface), said if len(said) >= 3 else None, symbol_type(said), 0.5 if m[5] else 0.6))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SYMBOLS.split(", ")])

    return nodes.where("text is not null").select("version", "node", "text").mapInPandas(run, _SYMBOLS)


def scoped_symbols(nodes: DataFrame) -> DataFrame:
    """Definitions with the section they stand in; the first of a symbol in a section counts."""
    w = Window.partitionBy("version").orderBy("ordinal")
    section = nodes.select("version", "node", "ordinal", F.last(F.when(F.col("kind").isin("section", "subsection"), F.col("node")), ignorenulls=True).over(w).alias("scope"))
    rows = definitions(nodes).join(section, ["version", "node"])
    first = Window.partitionBy("version", "scope", "normal").orderBy("ordinal", "node", "surface")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def occurrences(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(version, surface, node): formulas that have a symbol, as it is or, for one letter, between non-letters."""
    math = nodes.where("kind = 'display_math'").select("version", F.col("node").alias("at"), "text")
    one = F.regexp_like("text", F.concat(F.lit(r"(?<![A-Za-z\\])"), F.lit(r"\Q"), F.col("surface"), F.lit(r"\E(?![A-Za-z])")))
    hit = F.when(F.length("surface") == 1, one).otherwise(F.contains("text", F.col("surface")))
    return symbols.select("version", "surface").distinct().join(math, "version").where(hit).select("version", "surface", F.col("at").alias("node"), F.lit(OCCURRENCE).alias("confidence"))


# ---- context

BEFORE, AFTER, CHARACTERS, RELATED, PREMISES = 2, 16, 6000, 12, 12
LISTS = ("proofs", "proves", "equations", "floats", "citations", "references")
BOUNDARIES = ("section", "subsection", "bibliography_entry", *THEOREMS, "proof")


def _related(f: DataFrame, origins: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(version, focus, list, source, other, relation, kind, lost) for the edges from ``origins``, the proofs of each focus and the
    captions of its floats; ``lost`` says of a caption that no figure or table is known for it."""
    edge = links.select("version", "source", "relation", "target")
    out = origins.withColumnRenamed("node", "source").join(edge, ["version", "source"]).where("relation <> 'proves' or target <> focus")
    relation = F.col("relation")
    named = F.when(relation == "proves", "proves").when(relation == "refers_to_equation", "equations").when(relation == "cites", "citations").when(relation.isin("refers_to_figure", "refers_to_table", "caption_of"), "floats").otherwise("references")
    out = out.select("version", "focus", named.alias("list"), "source", F.col("target").alias("other"), "relation")
    proofs = f.select("version", "focus").join(edge.where("relation = 'proves'").withColumnRenamed("target", "focus"), ["version", "focus"])
    out = out.union(proofs.select("version", "focus", F.lit("proofs"), F.col("focus"), F.col("source"), "relation"))
    captions = origins.join(edge.where("relation = 'caption_of'").withColumnRenamed("target", "node"), ["version", "node"])
    out = out.union(captions.select("version", "focus", F.lit("floats"), "source", F.col("node"), "relation"))
    once = F.when(F.col("list") == "floats", "").otherwise(F.col("relation"))
    out = out.groupBy("version", "focus", "list", "source", "other", once.alias("once")).agg(F.min("relation").alias("relation")).drop("once")
    held = edge.where("relation = 'caption_of'").select("version", F.col("source").alias("other"), F.lit(True).alias("held")).distinct()
    out = out.join(nodes.select("version", F.col("node").alias("other"), "kind"), ["version", "other"]).join(held, ["version", "other"], "left")
    return out.withColumn("lost", (F.col("list") == "floats") & ~F.col("kind").isin("figure", "table") & F.col("held").isNull()).drop("held")


def _backing(f: DataFrame, origins: DataFrame, nodes: DataFrame, related: DataFrame) -> DataFrame:
    """(version, focus, premises): definitions that the references name, then those of symbols, one a surface: of those before the
    focus the one whose symbol occurs in a formula of it, else in its text as ``$symbol$``; described and late ones go first."""
    named = related.where("list = 'references' and kind = 'definition'").groupBy("version", "focus", "other").agg(F.min("source").alias("source"))
    entry = lambda rank, source, surface, node, via, said: F.struct(F.lit(rank).alias("rank"), source.cast("long").alias("source"), surface.cast("string").alias("surface"), node.cast("long").alias("node"), via.alias("via"), said.cast("string").alias("description"))
    none = F.lit(None)
    rows = named.select("version", "focus", entry(0, F.col("source"), none, F.col("other"), F.lit("reference"), none).alias("p"))
    symbols = save(scoped_symbols(nodes), "symbols")
    w = Window.partitionBy("version", "focus").orderBy("source", "other")
    formulas = related.where("list = 'equations'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= RELATED).select("version", "focus", F.col("other").alias("node"))
    seen = origins.union(formulas).distinct().join(occurrences(symbols, nodes).select("version", "node", "surface"), ["version", "node"]).select("version", "focus", "surface", F.lit(2).alias("occurs")).distinct()
    said = origins.join(nodes.select("version", "node", "text"), ["version", "node"]).groupBy("version", "focus").agg(F.array_join(F.collect_list("text"), "\n").alias("said"))
    parts = F.split("said", r"\$")
    named = said.select("version", "focus", F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("surface"), F.lit(1).alias("occurs"))
    seen = seen.union(named).groupBy("version", "focus", "surface").agg(F.max("occurs").alias("how"))
    hits = seen.join(symbols, ["version", "surface"]).join(f.select("version", "focus", "at"), ["version", "focus"]).where("ordinal < at")
    best = hits.groupBy("version", "focus", "surface").agg(F.max_by(F.struct("node", "description", "how"), F.struct("how", F.col("description").isNotNull(), "ordinal", "node")).alias("d"))
    via = F.when(F.col("d.how") == 2, "occurrence").otherwise("symbol")
    rows = rows.union(best.select("version", "focus", entry(1, none, F.col("surface"), F.col("d.node"), via, F.col("d.description"))))
    return rows.groupBy("version", "focus").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["via"].alias("via"), p["node"].alias("node"), p["surface"].alias("surface"), p["description"].alias("description"))).alias("premises"))


def _around(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """(version, focus, k, node, ordinal, fits): the block ``k`` positions after a focus or, from 0 down, before it, up to the next
    boundary. Running counts place every node once, so that a focus meets only the few positions around it."""
    w = Window.partitionBy("version").orderBy("ordinal", "node").rowsBetween(Window.unboundedPreceding, 0)
    shown = F.coalesce(F.trim("text") != "", F.lit(False))
    stops = shown & F.col("kind").isin(*BOUNDARIES)
    chars = F.sum(F.when(shown, F.char_length("text")).otherwise(0)).over(w).alias("chars")
    placed = nodes.select("version", "node", "ordinal", shown.alias("shown"), stops.alias("stops"), F.sum(shown.cast("int")).over(w).alias("pos"), F.sum(stops.cast("int")).over(w).alias("part"), chars)
    placed = save(placed, "placed")
    own = f.select("version", F.col("focus").alias("node")).join(placed, ["version", "node"])
    k = F.explode(F.sequence(F.lit(1 - BEFORE), F.lit(AFTER + 1))).alias("k")
    probes = own.select("version", F.col("node").alias("focus"), "pos", "part", F.col("chars").alias("past"), "shown", "stops", k)
    late = F.col("k") > 0
    probes = probes.select("version", "focus", "k", "past", (F.col("pos") + F.col("k") - F.when(late, 0).otherwise(F.col("shown").cast("int"))).alias("pos"), (F.col("part") - F.when(late, 0).otherwise(F.col("stops").cast("int"))).alias("part"))
    fits = ~late | ((F.col("k") <= AFTER) & (F.col("chars") - F.col("past") <= CHARACTERS))
    return probes.join(placed.where("shown").select("version", "pos", "part", "node", "ordinal", "chars"), ["version", "pos", "part"]).select("version", "focus", "k", "node", "ordinal", fits.alias("fits"))


def _path(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """(version, focus, path): the open headings before a focus, the innermost four. The last heading of each level is looked up
    as-of; it is open if none after it has its level or a lesser one."""
    heads = nodes.where("level is not null and trim(text) <> ''").select("version", "level", "ordinal", "text")
    probes = f.select("version", "focus", "at").join(heads.select("version", "level").distinct(), "version")
    rows = heads.select("version", "level", "ordinal", F.lit(1).alias("head"), "text", F.lit(None).cast(f.schema["focus"].dataType).alias("focus"))
    rows = rows.union(probes.select("version", "level", "at", F.lit(0), F.lit(None).cast("string"), "focus"))
    w = Window.partitionBy("version", "level").orderBy("ordinal", "head")
    rows = rows.withColumn("found", F.last(F.when(F.col("head") == 1, F.struct("ordinal", "level", "text")), ignorenulls=True).over(w)).where("head = 0 and found is not null")
    every = rows.groupBy("version", "focus").agg(F.sort_array(F.collect_list("found"), asc=False).alias("every"))
    is_open = lambda s: F.forall("every", lambda t: (t["ordinal"] <= s["ordinal"]) | (t["level"] > s["level"]))
    return every.select("version", "focus", F.reverse(F.slice(F.transform(F.filter("every", is_open), lambda s: s["text"]), 1, 4)).alias("path"))


def context(nodes: DataFrame, focus: DataFrame, links: DataFrame) -> DataFrame:
    """For each focus (version, node): its section path, the blocks before it, what continues it to the next boundary within
    a budget, related nodes, premises and notes.

    ``related`` has a list for each of ``LISTS``, from edges of the focus and of its continuation, in the order of (source, other) and
    each capped by itself; it is null without edges. ``notes`` says what was cut, a proof of something that is no theorem, and a
    float of which only the caption is known.
    """
    f = focus.join(nodes.select("version", "node", F.col("ordinal").alias("at"), F.col("text").alias("focus_text")), ["version", "node"]).withColumnRenamed("node", "focus")
    near = save(_around(f, nodes), "near")
    after = near.where("k > 0 and fits").groupBy("version", "focus").agg(F.array_sort(F.collect_list("ordinal")).alias("continuation"))
    short = near.where("k > 0").groupBy("version", "focus").agg(F.max(~F.col("fits")).alias("short"))
    before = near.where("k <= 0").groupBy("version", "focus").agg(F.array_sort(F.collect_list("ordinal")).alias("before"))
    origins = f.select("version", "focus", F.col("focus").alias("node")).union(near.where("k > 0 and fits").select("version", "focus", "node"))
    path = _path(f, nodes)
    origins = save(origins, "origins")
    edge = save(_related(f, origins, nodes, links), "related")
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("source", "other", "relation")))).alias(name)
    other = F.max((F.col("list") == "proves") & ~F.col("kind").isin("theorem", "lemma", "proposition", "corollary")).alias("other_target")
    every = edge.groupBy("version", "focus").agg(*(of(x) for x in LISTS), other, F.max("lost").alias("lost"))
    many = F.greatest(*(F.size(x) for x in LISTS)) > RELATED
    related = every.select("version", "focus", F.struct(*(F.slice(x, 1, RELATED).alias(x) for x in LISTS)).alias("related"), many.alias("many"), "other_target", "lost")
    premise = _backing(f, origins, nodes, edge)
    out = f.select("version", "focus", F.substring("focus_text", 1, 4000).alias("text"))
    for part in (path, before, after, related, premise, short):
        out = out.join(part, ["version", "focus"], "left")
    said = (("continuation_truncated", F.col("short")), ("proves_target_is_not_a_theorem", F.col("other_target")), ("float_entity_unreachable", F.col("lost")), ("related_truncated", F.col("many")), ("premises_truncated", F.size("premises") > PREMISES))
    notes = F.array_compact(F.array(*(F.when(there, name) for name, there in said)))
    return out.withColumn("notes", notes).withColumn("premises", F.slice("premises", 1, PREMISES)).drop("short", "many", "other_target", "lost")


def _paths(nodes: DataFrame) -> DataFrame:
    """(version, node, path) of the nodes below a root, the sort keys from the root down.

    Each round puts the path of the topmost ancestor known so far before a node's own, which doubles both: a tree of d levels takes
    log2(d) rounds. A depth of 2 ** r has a node only if every lesser depth has one, so a round that completes no path is the last;
    what it leaves is below a cycle or a parent that isn't there.
    """
    own = F.array(F.struct("ordinal", "node"))
    held, done = save(nodes.select("version", "node", F.col("parent").alias("top"), own.alias("path")), "paths"), -1
    while True:
        now, left = held.agg(F.count_if(F.col("top").isNull()), F.count("top")).first()
        if not left or now == done:
            return held.where("top is null").select("version", "node", "path")
        above = held.select("version", F.col("node").alias("top"), F.col("top").alias("next"), F.col("path").alias("head"))
        longer = held.where("top is not null").join(above, ["version", "top"]).select("version", "node", F.col("next").alias("top"), F.concat("head", "path").alias("path"))
        last, held, done = held, save(held.where("top is null").unionByName(longer), "paths"), now
        discard(last)


def reading_order(nodes: DataFrame) -> DataFrame:
    """Pre-order position of (version, node, parent, ordinal) trees of any depth; nodes without a reachable root come last."""
    rows = nodes.join(_paths(nodes), ["version", "node"], "left")
    w = Window.partitionBy("version").orderBy(F.col("path").isNull(), "path", "parent", "ordinal", "node")
    return rows.select("version", "node", (F.row_number().over(w) - 1).cast("long").alias("position"))


def premises(symbols: DataFrame, occurs: DataFrame, focus: DataFrame, most: int = 12) -> DataFrame:
    """For each focus formula the definitions of its symbols: those before by occurrence, the latest first, one a surface."""
    hits = focus.select("version", F.col("node").alias("focus")).join(occurs.select("version", F.col("node").alias("focus"), "surface"), ["version", "focus"])
    best = hits.join(symbols, ["version", "surface"]).groupBy("version", "focus", "surface").agg(F.max_by(F.struct("node", "description"), F.struct(F.col("description").isNotNull(), "ordinal")).alias("d"))
    w = Window.partitionBy("version", "focus").orderBy("surface")
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("version", "focus", "surface", F.col("d.node").alias("defined_at"), F.col("d.description").alias("description"))
