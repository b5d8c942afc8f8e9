"""BibTeX: files to entry rows, and entry rows to text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions.scalars import base_citation_key, sanitize_citation_key, suffix_letters

# Entry types and what they are read as.
TYPES = {"article": "article", "inproceedings": "conference", "conference": "conference", "book": "book", "inbook": "book_chapter", "incollection": "book_chapter", "phdthesis": "thesis", "mastersthesis": "thesis", "thesis": "thesis", "techreport": "report", "report": "report", "unpublished": "preprint", "online": "webpage", "misc": "other"}
_SPECIAL = {"&": r"\&", "%": r"\%", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}", "$": r"\$"}
SCHEMA = "citation_key string, entry_type string, title string, year int, doi string, url string, authors array<struct<given:string,family:string,organization:boolean>>, error string"


def _balanced(text: str, at: int, opening: str, closing: str) -> int:
    """Where the group that opens at ``at`` ends (exclusive), or -1."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] == "\\":
            continue
        if text[k] == opening and (not k or text[k - 1] != "\\"):
            depth += 1
        elif text[k] == closing and text[k - 1] != "\\":
            depth -= 1
            if not depth:
                return k + 1
    return -1


def _fields(body: str) -> dict[str, str]:
    out, at = {}, 0
    while m := re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*").match(body, at):
        at, value = m.end(), []
        while at < len(body):
            if body[at] == "{":
                end = _balanced(body, at, "{", "}")
                if end < 0:
                    return out
                value.append(body[at + 1 : end - 1])
            elif body[at] == '"':
                end, depth = at + 1, 0
                while end < len(body) and (depth or body[end] != '"'):
                    depth += {"{": 1, "}": -1}.get(body[end], 0)
                    end += 1
                value.append(body[at + 1 : end])
                end += 1
            else:
                end = re.compile(r"[^,#\s}]*").match(body, at).end()
                value.append(body[at:end])
            more = re.compile(r"\s*#\s*").match(body, end)
            at = more.end() if more else end
            if not more:
                break
        out.setdefault(m[1].lower(), re.sub(r"\s+", " ", "".join(value)).strip())
    return out


def parse(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; comments, strings and preambles are passed over."""
    at = 0
    while m := re.compile(r"@\s*([A-Za-z]+)\s*\{").search(text, at):
        end = _balanced(text, m.end() - 1, "{", "}")
        if end < 0:
            return
        at = end
        if m[1].lower() not in ("comment", "string", "preamble"):
            key, _, body = text[m.end() : end - 1].partition(",")
            yield m[1].lower(), key.strip(), _fields(body)


def split_authors(text: str | None) -> list[dict]:
    """Names at ``and`` outside braces: ``Last, First``, ``First Last`` or ``{Organisation}``."""
    out, depth, start, parts = [], 0, 0, []
    text = (text or "").strip()
    for m in re.finditer(r"[{}]|\s+and\s+", text):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth == 0:
            parts.append(text[start : m.start()])
            start = m.end()
    for p in filter(None, (p.strip() for p in [*parts, text[start:]])):
        if p.startswith("{") and p.endswith("}"):
            out.append({"given": None, "family": p[1:-1].strip(), "organization": True})
        elif "," in p:
            family, _, given = p.partition(",")
            out.append({"given": given.strip() or None, "family": family.strip(), "organization": False})
        else:
            given, _, family = p.rpartition(" ")
            out.append({"given": given.strip() or None, "family": family, "organization": False})
    return out


def _rows(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in texts:
        rows = []
        for text in frame["value"].dropna():
            for kind, key, f in parse(text):
                year = (f.get("year") or f.get("date", ""))[:4]
                rows.append((key, TYPES.get(kind, "other"), f.get("title"), int(year) if year.isdigit() else None, f.get("doi"), f.get("url"), split_authors(f.get("author")), None if f.get("title") else "no title"))
        yield pd.DataFrame(rows, columns=["citation_key", "entry_type", "title", "year", "doi", "url", "authors", "error"]).astype({"year": "Int32"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the ``.bib`` files at ``path``; an entry without a title has an ``error`` and is for the caller to skip."""
    return from_text(spark.read.text(path, wholetext=True))


def from_text(files: DataFrame) -> DataFrame:
    """Entries of files in the column ``value``."""
    return files.select("value").mapInPandas(_rows, SCHEMA)


def escape(text: str | None) -> str | None:
    """Special characters escaped; ``$…$`` and ``$$…$$`` stay as they are."""
    if text is None:
        return None
    parts = re.split(r"(\$\$(?=[^\s$])[^$]*[^\s$]\$\$|\$(?=[^\s$])[^$]*(?<=\S)\$)", text)
    return "".join(p if k % 2 else "".join(_SPECIAL.get(c, c) for c in p) for k, p in enumerate(parts))


def assign_keys(entries: DataFrame, base: Column, order: list[Column], pinned: str = "citation_key") -> DataFrame:
    """``entries`` with ``key``: the sanitised pinned one, else the base with letters in ``order``.

    Letters follow from the rank within the base. Where such a key equals a pinned key or another base's, the ranks
    are not enough; those bases alone are assigned by one ordered pass over their rows.
    """
    rows = entries.withColumn("__pin", sanitize_citation_key(pinned)).withColumn("__base", base)
    free = rows.where("__pin is null").withColumn("__n", F.row_number().over(Window.partitionBy("__base").orderBy(*order)) - 1)
    free = free.withColumn("key", F.concat("__base", suffix_letters(F.col("__n"))))
    pins = rows.where("__pin is not null").withColumn("__n", F.lit(0)).withColumn("key", F.col("__pin"))
    out = pins.select(*free.columns).unionByName(free)
    clash = out.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    touched = out.join(clash, "key", "left_semi").where("__pin is null").select("__base").distinct()
    easy = out.join(touched, "__base", "left_anti")
    hard = out.where("__pin is null").join(touched, "__base", "left_semi")
    taken = easy.select("key").union(clash)
    bump = hard.join(taken, "key", "left_semi").select("__base").distinct().withColumn("__up", F.lit(True))
    moved = hard.join(bump, "__base", "left").withColumn("key", F.when(F.col("__up") & (F.col("__n") > 0), F.concat("__base", F.lit("_"), suffix_letters(F.col("__n")))).when(F.col("__up"), F.concat("__base", F.lit("_"))).otherwise(F.col("key"))).drop("__up")
    return easy.unionByName(moved).drop("__pin", "__base", "__n")


def to_text(entries: DataFrame) -> DataFrame:
    """``bib``: each entry (key, entry_type, title, year, doi, authors as text) as BibTeX."""
    back = {v: k for k, v in reversed(TYPES.items())}
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in back.items() for x in kv))[F.col("entry_type")], F.lit("misc"))
    safe = F.udf(escape, "string")
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("},")))
    body = F.concat_ws("\n", line("author", safe("authors")), line("title", safe("title")), line("year", F.col("year").cast("string")), line("doi", F.col("doi")))
    return entries.select("key", F.concat(F.lit("@"), kind, F.lit("{"), F.col("key"), F.lit(",\n"), body, F.lit("\n}")).alias("bib"))


def default_base(entries: DataFrame) -> Column:
    first = F.element_at("authors", 1)
    return base_citation_key(first["family"], F.concat_ws(" ", first["given"], first["family"]), F.col("title"), F.col("year"))
