"""TeX sources: archives, comments, includes, typed blocks and tables. Parsers are pure functions; DataFrames map over archives."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Environments by what becomes of them, and limits beyond which input gives a warning and no output.
DISPLAY = ("equation", "align", "alignat", "flalign", "gather", "multline", "eqnarray", "displaymath", "dmath")
VERBATIM = ("verbatim", "lstlisting", "Verbatim", "BVerbatim", "LVerbatim", "minted", "alltt")
DROPPED = ("tikzpicture", "pgfpicture", "picture", "tabu")
TABULAR = ("tabular", "tabularx")
FIGURES, TABLES = ("figure", "wrapfigure", "sidewaysfigure"), ("table", "sidewaystable", "longtable")
TRANSPARENT = ("center", "flushleft", "flushright", "quote", "quotation", "verse", "widetext", "subequations", "acknowledgments", "acknowledgements", "minipage", "sloppypar", "singlespace", "doublespace", "spacing", "appendices", "appendix")
LISTS = ("itemize", "enumerate", "description")
THEOREMS = {"theorem": "theorem", "thm": "theorem", "lemma": "lemma", "lem": "lemma", "proposition": "proposition", "prop": "proposition", "corollary": "corollary", "cor": "corollary", "definition": "definition", "defn": "definition", "remark": "remark", "rem": "remark", "example": "example", "proof": "proof"}
SECTIONS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph")
MOST_ROWS, MOST_COLUMNS, MOST_BYTES, MOST_FILES, MOST_PARAGRAPH = 512, 64, 64 << 20, 2000, 40_000


def open_archive(raw: bytes) -> dict[str, str]:
    """Text files of a gzipped tar, or the one file of a plain gzip; too large or too many give nothing."""
    try:
        data = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(MOST_BYTES + 1) if raw[:2] == b"\x1f\x8b" else raw
    except (OSError, EOFError):
        return {}
    if len(data) > MOST_BYTES:
        return {}
    text = lambda b: b.decode("utf-8") if _is_utf8(b) else b.decode("latin-1")
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            members = [m for m in tar if m.isfile()]
            if len(members) > MOST_FILES:
                return {}
            return {m.name.removeprefix("./"): text(tar.extractfile(m).read()) for m in members if m.name.lower().endswith((".tex", ".bbl", ".ltx", ".sty"))}
    except tarfile.TarError:
        return {"main.tex": text(data)}


def _is_utf8(b: bytes) -> bool:
    try:
        b.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


_SKIPPED = re.compile(r"\\begin\{(" + "|".join(VERBATIM) + r")\*?\}.*?\\end\{\1\*?\}|\\url\{[^}]*\}|\\verb\*?([^A-Za-z\s]).*?\2|(?P<mark>(?<!\\)(?:\\\\)*%)", re.S)


def strip_comments(text: str) -> str:
    """Without unescaped ``%`` to the end of line; verbatim environments, ``\\verb`` and ``\\url`` are left alone."""
    out, at = [], 0
    while m := _SKIPPED.search(text, at):
        if m["mark"] is None:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        out.append(text[at : m.end() - 1])
        end = text.find("\n", m.end())
        if end < 0:
            return "".join(out)
        own_line = not text[text.rfind("\n", 0, m.start()) + 1 : m.end() - 1].strip()
        at = end + 1 if own_line else end
    return "".join([*out, text[at:]])


_INCLUDE = re.compile(r"\\(?:input|include|subfile)\s*\{([^}]+)\}|\\input\s+([^\s\\{}%]+)|\\import\s*\{([^}]*)\}\s*\{([^}]+)\}")


def _included(m: re.Match) -> str:
    """The name in an include, a folder before it joined."""
    return (m[1] or m[2] or m[3].strip() + m[4].strip()).strip().removeprefix("./")


def main_file(files: dict[str, str]) -> str | None:
    """The file that none includes, that has a document and a title, and is longest; names break ties."""
    tex = {n: strip_comments(t) for n, t in files.items() if n.lower().endswith((".tex", ".ltx"))}
    named = {f"{x.strip().removesuffix('.tex')}.tex" for t in tex.values() for x in map(_included, _INCLUDE.finditer(t))}
    rank = lambda n: (n not in named, r"\begin{document}" in tex[n], r"\title" in tex[n], len(tex[n]))
    ordered = sorted(tex)
    return max(ordered, key=lambda n: (rank(n), -ordered.index(n))) if tex else None


def resolve(files: dict[str, str], name: str) -> str | None:
    """A file with its includes in place, each file once, where it is first included; a missing one is nothing. None if the whole is
    larger than ``MOST_BYTES``."""
    seen, size = set(), 0

    def read(name: str) -> str:
        nonlocal size
        if name in seen or name not in files:
            return ""
        seen.add(name)
        text = strip_comments(files[name])
        size += len(text.encode(errors="replace"))
        return _INCLUDE.sub(include, text) if size <= MOST_BYTES else ""

    def include(m: re.Match) -> str:
        own = _included(m)
        return read(own if own in files else f"{own}.tex")

    text = read(name)
    bbl = name.rsplit(".", 1)[0] + ".bbl"
    bbl = bbl if bbl in files else next((n for n in sorted(files) if n.endswith(".bbl")), None)
    if bbl:
        text = re.sub(r"\\bibliography\s*\{[^}]*\}", lambda _: read(bbl), text)
    return text if size <= MOST_BYTES else None


def group(text: str, at: int) -> int:
    """End (exclusive) of the braces that open at ``at``, or -1."""
    depth = 0
    k = at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return -1


def argument(text: str, command: str) -> str | None:
    """The first braced argument of a command, past an optional one."""
    m = re.search(r"\\" + command + r"\*?\s*(?:\[[^\]]*\]\s*)?(?=\{)", text)
    if not m:
        return None
    end = group(text, m.end())
    return text[m.end() + 1 : end - 1] if end > 0 else None


def labels(text: str) -> list[str]:
    return re.findall(r"\\label\s*\{([^}]*)\}", text)


def math_text(text: str) -> str:
    """A formula without labels, tags' place and numbering marks, spaces collapsed."""
    text = re.sub(r"\\label\s*\{[^}]*\}|\\tag\*?\s*\{[^}]*\}|\\(?:nonumber|notag)(?![A-Za-z])", "", text)
    return re.sub(r"\s+", " ", text).strip()


def plain(text: str) -> str:
    """Running text: ties as spaces, formatting commands unwrapped, spaces collapsed."""
    text = re.sub(r"\\label\s*\{[^}]*\}", "", text).replace("~", " ")
    for _ in range(4):
        text = re.sub(r"\\(?:emph|textbf|textit|texttt|textsc|textrm|text|underline|mbox)\s*\{([^{}]*)\}", r"\1", text)
    return re.sub(r"\s+", " ", text).strip()


def split_cells(row: str) -> list[str]:
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\\.|[{}&]", row, re.S):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif m[0] == "&" and not depth:
            out.append(row[start : m.start()])
            start = m.end()
    return [*out, row[start:]]


def tabular(body: str) -> list[dict] | None:
    """Rows of a tabular body, after its column specification: ``cells`` and ``rule_above``. All or nothing."""
    if body.lstrip().startswith("["):
        body = body[body.index("]") + 1 :]
    body = body.lstrip()
    if not body.startswith("{") or (end := group(body, 0)) < 0:
        return None
    rows, rule = [], False
    for raw in re.split(r"\\\\(?:\s*\[[^\]]*\])?|\\tabularnewline", body[end:]):
        rules = re.findall(r"\\(?:hline|toprule|midrule|bottomrule|cline\s*\{[^}]*\}|cmidrule(?:\([^)]*\))?\s*\{[^}]*\})", raw)
        text = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)|\\(?:cline|cmidrule)(?:\([^)]*\))?\s*\{[^}]*\}", "", raw)
        rule = rule or bool(rules)
        if not text.strip():
            continue
        cells = []
        for cell in split_cells(text):
            m = re.match(r"\s*\\multicolumn\s*\{(\d+)\}\s*\{[^}]*\}\s*", cell)
            span = int(m[1]) if m else 1
            value = cell[m.end() :].strip() if m else cell
            value = value[1:-1] if m and value.startswith("{") and group(value, 0) == len(value) else value
            value = re.sub(r"\\multirow\s*\{[^}]*\}\s*\{[^}]*\}\s*\{([^{}]*)\}", r"\1", value)
            cells += [plain(value), *[""] * (span - 1)]
        if len(cells) > MOST_COLUMNS or len(rows) >= MOST_ROWS:
            return None
        rows.append({"cells": cells, "rule_above": rule})
        rule = False
    return rows or None


_TOKEN = re.compile(r"\\begin\s*\{([A-Za-z]+)(\*?)\}|\\(" + "|".join(SECTIONS) + r")(\*?)\s*(?:\[[^\]]*\]\s*)?(?=\{)|\\appendix(?![A-Za-z])|\$\$|\\\[|\n[ \t]*\n")


def _end_of(text: str, name: str, at: int) -> tuple[int, int]:
    """Where the body of an environment ends and where what follows it begins; nested ones of the name are passed."""
    depth = 1
    for m in re.compile(r"\\(begin|end)\s*\{" + re.escape(name) + r"\}").finditer(text, at):
        depth += 1 if m[1] == "begin" else -1
        if not depth:
            return m.start(), m.end()
    return len(text), len(text)


def parse(text: str) -> list[dict]:
    """Typed blocks of a resolved source, in order: kind, text, number, level, labels, note and cells."""
    custom = dict(THEOREMS)
    for env, title in re.findall(r"\\newtheorem\*?\s*\{([^}]+)\}(?:\s*\[[^\]]*\])?\s*\{([^}]+)\}", text):
        if title.strip().lower() in THEOREMS:
            custom[env] = THEOREMS[title.strip().lower()]
    start = re.search(r"\\begin\s*\{document\}", text)
    body = text[start.end() :] if start else text
    body = body.split(r"\end{document}")[0]
    out: list[dict] = []
    if start and (title := argument(text, "title")):
        out.append(_block("title", plain(title)))
    counters, state = [0] * len(SECTIONS), {"appendix": False, "group": 0}
    _walk(body, out, custom, counters, state)
    return out


def _block(kind: str, text: str = "", **more) -> dict:  # noqa: ANN003
    return {"kind": kind, "text": text, "number": None, "level": None, "labels": [], "note": None, "cells": None, "group": None} | more


def _paragraph(text: str, out: list[dict]) -> None:
    shown = plain(re.sub(r"\\(?:maketitle|noindent|bigskip|medskip|smallskip|newpage|clearpage|centering|par|item)(?![A-Za-z])", "", text))
    while shown:
        out.append(_block("paragraph", shown[:MOST_PARAGRAPH], labels=labels(text)))
        shown = shown[MOST_PARAGRAPH:]


def _number(level: int, counters: list[int], appendix: bool) -> str:
    counters[level] += 1
    counters[level + 1 :] = [0] * (len(counters) - level - 1)
    parts = [str(c) for c in counters[: level + 1]]
    if appendix:
        parts[0] = chr(64 + max(1, min(26, counters[0])))
    return ".".join(parts)


def _walk(text: str, out: list[dict], custom: dict[str, str], counters: list[int], state: dict) -> None:
    at = pending = 0
    while m := _TOKEN.search(text, at):
        if group_depth(text, pending, m.start()):
            at = m.end()
            continue
        _paragraph(text[pending : m.start()], out)
        at = pending = m.end()
        if m[3]:
            end = group(text, m.end())
            title = text[m.end() + 1 : end - 1] if end > 0 else ""
            at = pending = max(end, m.end())
            level = SECTIONS.index(m[3])
            number = None if m[4] or level > 2 else _number(level, counters, state["appendix"])
            out.append(_block("section" if not level else "subsection", plain(title), number=number, level=level + 1, labels=labels(text[at : at + 120].split("\n\n")[0][:120])))
        elif m[0] in ("$$", r"\["):
            stop = text.find("$$" if m[0] == "$$" else r"\]", at)
            stop = len(text) if stop < 0 else stop
            out.append(_block("display_math", math_text(text[at:stop])))
            at = pending = min(len(text), stop + 2)
        elif m[0].startswith(r"\appendix"):
            state["appendix"], counters[:] = True, [0] * len(counters)
        elif m[1]:
            name, star = m[1], m[1] + m[2]
            stop, after = _end_of(text, star, at)
            _environment(name, text[at:stop], out, custom, counters, state)
            at = pending = after
    _paragraph(text[pending:], out)


def group_depth(text: str, lo: int, hi: int) -> int:
    part = re.sub(r"\\.", "", text[lo:hi], flags=re.S)
    return max(0, part.count("{") - part.count("}"))


def _environment(name: str, body: str, out: list[dict], custom: dict[str, str], counters: list[int], state: dict) -> None:
    if name in DISPLAY:
        tag = re.search(r"\\tag\*?\s*\{([^}]*)\}", body)
        out.append(_block("display_math", math_text(re.sub(r"^\s*\{[^}]*\}", "", body) if name == "alignat" else body), number=f"({tag[1]})" if tag else None, labels=labels(body)))
    elif name in VERBATIM:
        out.append(_block("code_block", body.strip("\n")))
    elif name in DROPPED:
        pass
    elif name in custom:
        note = re.match(r"\s*\[([^\]]*)\]", body)
        body = body[note.end() :] if note else body
        out.append(_block(custom[name], plain(body), labels=labels(body), note=plain(note[1]) if note else None))
    elif name in FIGURES or name in TABLES:
        state["group"] += 1
        shown = argument(body, "caption")
        inner = re.search(r"\\begin\s*\{(tabularx?|tabular\*)\}", body)
        cells = None
        if name in TABLES and inner and name != "longtable":
            stop, _ = _end_of(body, inner[1], inner.end())
            cells = tabular(re.sub(r"^\s*\{[^}]*\}(?=\s*\{)", "", body[inner.end() : stop]) if inner[1] != "tabular" else body[inner.end() : stop])
        own = labels(body)
        if shown is not None:
            out.append(_block("figure_caption" if name in FIGURES else "table_caption", plain(shown), labels=own, group=state["group"]))
        if cells:
            out.append(_block("table", "", cells=cells, labels=[] if shown is not None else own, group=state["group"]))
    elif name in TABULAR:
        if cells := tabular(body):
            out.append(_block("table", "", cells=cells))
    elif name in LISTS:
        for item in re.split(r"\\item(?![A-Za-z])", body)[1:]:
            out.append(_block("list_item", plain(re.sub(r"^\s*\[([^\]]*)\]", r"\1", item)), labels=labels(item)))
    elif name == "thebibliography":
        out.append(_block("heading", "References", level=1))
        for m in re.finditer(r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}(.*?)(?=\\bibitem|\Z)", body, re.S):
            out.append(_block("bibliography_entry", plain(m[2]), labels=[m[1]]))
    elif name == "abstract":
        out.append(_block("abstract", plain(body)))
    else:  # transparent, or unknown: the marker goes, the content stays
        _walk(body, out, custom, counters, state)
        if name not in TRANSPARENT:
            out.append(_block("warning", f"unknown environment {name}"))


BLOCKS = "document long, ordinal int, kind string, text string, number string, level int, labels array<string>, note string, cells array<struct<cells:array<string>,rule_above:boolean>>, float_group int"


def blocks(sources: DataFrame) -> DataFrame:
    """Typed blocks of (document, files map<path, content>) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, files in zip(frame["document"], frame["files"], strict=True):
                files = dict(files or {})
                main = main_file(files)
                text = resolve(files, main) if main else ""
                for k, b in enumerate([_block("warning", "the source is too large")] if text is None else parse(text)):
                    rows.append((doc, k, b["kind"], b["text"], b["number"], b["level"], b["labels"], b["note"], b["cells"], b["group"]))
            yield pd.DataFrame(rows, columns=["document", "ordinal", "kind", "text", "number", "level", "labels", "note", "cells", "float_group"]).astype({"level": "Int32", "float_group": "Int32"})

    return sources.select("document", "files").mapInPandas(run, BLOCKS)


def archives(files: DataFrame) -> DataFrame:
    """(document, files) of binary files (path, content), numbered by the hash of their path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"document": frame["document"], "files": [open_archive(bytes(raw or b"")) for raw in frame["content"]]})

    return files.select(F.xxhash64("path").alias("document"), "content").mapInPandas(run, "document long, files map<string,string>")
