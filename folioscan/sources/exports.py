"""Sinks: documents and libraries as Markdown or JSON, with a report of what the format drops; an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cell(c: F.Column) -> F.Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def node_markdown(nodes: DataFrame) -> DataFrame:
    """``md`` of each node by its kind: headings, quoted theorems, formulas, tables, captions, lists, paragraphs."""
    text, number = F.col("text"), F.col("number")
    head = F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(1)) + 1, F.lit(6))), F.lit(" "), F.concat_ws(" ", number, text))
    name = F.concat_ws(" ", F.initcap("kind"), number)
    rows = F.transform("cells", lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r["cells"], _cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at("cells", 1)["cells"])))
    table = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.when(F.size("cells") > 1, F.slice(rows, F.lit(2), F.greatest(F.size("cells") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))), "\n")
    md = (
        F.when(F.col("kind") == "title", F.concat(F.lit("# "), text))
        .when(F.col("kind").isin("section", "subsection", "heading"), head)
        .when(F.col("kind").isin("theorem", "lemma", "proposition", "corollary", "definition", "remark", "example", "proof"), F.concat(F.lit("> **"), name, F.lit(".** "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "display_math", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when((F.col("kind") == "table") & F.col("cells").isNotNull(), table)
        .when(F.col("kind").isin("figure_caption", "table_caption"), F.concat(F.lit("*"), text, F.lit("*")))
        .when(F.col("kind").isin("list_item", "bibliography_entry"), F.concat(F.lit("- "), text))
        .when(F.col("kind") == "code_block", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("kind") != "warning", text)
    )
    return nodes.withColumn("md", md)


def document_markdown(nodes: DataFrame) -> DataFrame:
    """(document, markdown): the nodes in reading order, blank line between."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "md")))
    return node_markdown(nodes).where("md is not null and md <> ''").groupBy("document").agg(F.array_join(F.transform(parts, lambda p: p["md"]), "\n\n").alias("markdown"))


def document_json(nodes: DataFrame) -> DataFrame:
    """(document, json): all nodes of a document in order."""
    fields = [c for c in nodes.columns if c != "document"]
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("node"))), lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0))
    return nodes.groupBy("document").agg(F.to_json(F.struct(F.transform(parts, lambda p: p["node"]).alias("nodes"))).alias("json"))


def warnings(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(document, code, n): what a plain format drops."""
    doc = lambda d, c, code: d.groupBy(F.col(c).alias("document")).agg(F.count("*").alias("n")).select("document", F.lit(code).alias("code"), "n")
    return doc(edges, "version", "relations_dropped").union(doc(symbols, "version", "symbols_dropped")).union(doc(nodes.where("kind = 'warning'"), "document", "unknown_environment")).union(doc(nodes.where("kind = 'table' and cells is null"), "document", "table_dropped"))


def library_markdown(entries: DataFrame) -> DataFrame:
    """(id, markdown) of live entries: a headed section each, parts that are blank left out."""
    part = lambda label, c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")))
    return entries.where("not trashed").select("id", F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), part("Type", "entry_type"), part("Language", "lang"), part("Size", "size")).alias("markdown"))


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to an append-only log."""
    rows.write.mode("append").parquet(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """Replace the text files at ``path``."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
