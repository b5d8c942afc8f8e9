from __future__ import annotations

import gzip
import io
import random
import tarfile

import pandas as pd
import pytest

from folioscan.operators import figures, graph, structure, tex
from folioscan.plans import documents
from folioscan.sources import bibtex
from folioscan.streaming import ingest


def test_bibtex_parse_and_authors():
    text = '@string{x = "y"} @article{Doe:2001, title = {A {B} and C}, author = {Doe, Jane and {Big and Sons} and Max M. Muster}, year = 2001, note = "q {"} z" # "w"} @misc{n, year=1}'
    (kind, key, f), (_, _, g) = bibtex.parse(text)
    assert (kind, key, f["title"], f["year"]) == ("article", "Doe:2001", "A {B} and C", "2001") and "title" not in g
    assert [(a["given"], a["family"], a["organization"]) for a in bibtex.split_authors(f["author"])] == [("Jane", "Doe", False), (None, "Big and Sons", True), ("Max M.", "Muster", False)]


def test_bibtex_escape_keeps_math():
    assert bibtex.escape("a & b_c $x_1$ 5% $ 3") == r"a \& b\_c $x_1$ 5\% \$ 3"


def test_key_assignment(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", "aa"), (4, "a", "!?"), (5, "c", None)]
    df = spark.createDataFrame(rows, "id long, base string, citation_key string")
    from pyspark.sql import functions as F

    out = {r.id: r.key for r in bibtex.assign_keys(df, F.col("base"), [F.col("id")]).collect()}
    assert out[3] == "aa" and out[5] == "c" and out[1] == "a_" and len(set(out.values())) == 5


def test_tex_comments_and_includes():
    assert tex.strip_comments("a % b\nc \\% d\n  % e\n\\begin{verbatim}% x\\end{verbatim}\\url{a%b}") == "a \nc \\% d\n  \\begin{verbatim}% x\\end{verbatim}\\url{a%b}"
    files = {"a.tex": r"\begin{document}\title{x}\input{b}\bibliography{q}\end{document}", "b.tex": r"B \input{a} \input{nope}", "a.bbl": "BBL"}
    assert tex.main_file(files) == "a.tex"
    assert "BBL" in tex.resolve(files, "a.tex") and tex.resolve(files, "a.tex").count("B ") == 1


def test_tex_includes_once_and_bounded(monkeypatch):
    twice = {f"f{k}.tex": rf"{k}\input{{f{k + 1}}}\input f{k + 1}.tex \import{{./}}{{f{k + 1}}}" for k in range(40)} | {"f40.tex": "end"}
    got = tex.resolve(twice, "f0.tex")
    assert got.count("end") == 1 and got.startswith("0123")
    monkeypatch.setattr(tex, "MOST_BYTES", 60)
    assert tex.resolve({"a.tex": r"\input{b}" + "x" * 30, "b.tex": "y" * 40}, "a.tex") is None
    assert tex.open_archive(gzip.compress(b"z" * 61)) == {}
    assert tex.strip_comments("% a\n" * 20_000 + r"\verb|%|") == r"\verb|%|"


def test_archives_of_files(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"plain"))
    (tmp_path / "b.gz").write_bytes(b"\x1f\x8bbroken")
    found = tex.archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted(len(r.files) for r in found) == [0, 1] and {"main.tex": "plain"} in [r.files for r in found]


def test_papers_differ(spark):
    rows = tex.blocks(documents.papers(spark, "/root/testdata/sf0.001")).collect()
    shapes, docs = {}, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in sorted(rows, key=lambda r: (r.document, r.ordinal)):
        shapes.setdefault(r.document, []).append(r.kind)
    assert len(shapes) == docs and len({tuple(x) for x in shapes.values()}) > docs // 4
    assert {"theorem", "lemma", "definition", "proof", "table", "warning", "list_item"} <= {r.kind for r in rows}


def test_tex_archive_round_trip():
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        info = tarfile.TarInfo("./x.tex")
        info.size = 2
        t.addfile(info, io.BytesIO(b"\xe9a"))
    assert tex.open_archive(gzip.compress(raw.getvalue())) == {"x.tex": "éa"}
    assert tex.open_archive(gzip.compress(b"plain")) == {"main.tex": "plain"}


def test_tex_blocks():
    text = r"""\newtheorem{s}{Theorem}\begin{document}
\section{One}\subsection{Two}\section*{Star}
First ~ line.

Second \emph{line}.
\begin{s}[Name]\label{t} Body.\end{s}
\begin{align}a&=b\label{e}\\c\end{align}
\appendix\section{More}
\begin{foo}inside\end{foo}
\end{document}"""
    got = [(b["kind"], b["text"], b["number"]) for b in tex.parse(text)]
    assert got[:3] == [("section", "One", "1"), ("subsection", "Two", "1.1"), ("section", "Star", None)]
    assert ("paragraph", "First line.", None) in got and ("paragraph", "Second line.", None) in got
    assert ("theorem", "Body.", None) in got and ("display_math", r"a&=b\\c", None) in got
    assert ("section", "More", "A") in got and ("paragraph", "inside", None) in got and got[-1][0] == "warning"


def test_tabular():
    rows = tex.tabular(r"{l|r}\hline a & b\&c \\ \hline \multicolumn{2}{c}{x} \\")
    assert rows == [{"cells": ["a", r"b\&c"], "rule_above": True}, {"cells": ["x", ""], "rule_above": True}]
    assert tex.tabular("no columns") is None


def test_regions_merge_by_hull():
    # the hull of the first two reaches the third, which neither does alone
    assert figures.merge([(0, 0, 10, 100), (20, 0, 100, 10), (60, 60, 10, 10)]) == [(0, 0, 120, 100)]
    assert len(figures.merge([(0, 0, 10, 10), (50, 0, 10, 10)])) == 2


def test_lines_and_blocks():
    seg = pd.DataFrame([(0, 10.0, 700.0, 30.0, 10.0, "Hello"), (1, 45.0, 701.0, 30.0, 10.0, "world"), (2, 10.0, 686.0, 60.0, 10.0, "next"), (3, 10.0, 672.0, 60.0, 10.0, "third"), (4, 10.0, 620.0, 60.0, 10.0, "far")], columns=["reading_order", "x", "y", "w", "h", "text"])
    lines = structure._page_lines(list(seg[["x", "y", "w", "h", "text"]].itertuples(index=False, name=None)))
    assert [x["text"] for x in lines] == ["Hello world", "next", "third", "far"]
    assert [len(b) for b in structure._page_blocks(lines)] == [3, 1]


def test_mode_carries_over(spark):
    rows = [(1, k, k, 72.0, 700.0, 300.0, 10.0, t, 842.0) for k, t in enumerate(["Abstract", "We do things here and more of them now.", "1 Introduction", "Theorem 2.1 (Name). It holds.", "Proof of it is short", "Figure 3: A plot", "References", "Doe J. A title, 2001.", "Another one, 2002."])]
    out = structure.nodes(spark.createDataFrame(rows, "document long, page int, reading_order int, x double, y double, w double, h double, text string, page_h double"))
    assert [r.kind for r in out.orderBy("ordinal").collect()] == ["heading", "abstract", "section", "theorem", "proof", "figure_caption", "heading", "bibliography_entry", "bibliography_entry"]


def _nodes(spark, rows):
    return spark.createDataFrame([(1, k, k, *r) for k, r in enumerate(rows)], "version long, node long, ordinal int, kind string, text string, labels array<string>, number string, level int")


def test_edges(spark):
    n = _nodes(spark, [
        ("section", "Intro", ["s"], "1", 1), ("paragraph", r"See \ref{t}, \cite[p. 3]{b, zz} and \eqref{e}; Lemma 4 and Fig. 2.", [], None, None), ("theorem", "T", ["t"], "3", None),
        ("proof", "Short.", [], None, None), ("lemma", "L", [], "4", None), ("proof", "of Theorem 3. Long.", [], None, None), ("display_math", "x", ["e"], "(7)", None),
        ("figure_caption", "c", [], "2", None), ("figure_caption", "d", [], "2", None), ("bibliography_entry", "B", ["b"], None, None), ("paragraph", r"again \ref{none} Equation (7) Lemma 9", ["t"], None, None),
    ])
    got = {(e.source, e.relation, e.target) for e in graph.edges(n).collect()}
    assert got == {(1, "refers_to_theorem", 2), (1, "cites", 9), (1, "refers_to_equation", 6), (1, "refers_to_theorem", 4), (3, "proves", 2), (5, "proves", 2), (5, "refers_to_theorem", 2), (10, "refers_to_equation", 6)}


def test_symbols(spark):
    assert graph.normal_symbol(r"\hat{\mathbf{x}}_1") == "x_1"
    assert graph.is_symbol("f(x, y)") and not graph.is_symbol("a b") and not graph.is_symbol("12")
    n = _nodes(spark, [("section", "S", [], "1", 1), ("paragraph", r"Let $\mathcal{G}$ be a finite group. $h$ denotes the norm. $n := 3$", [], None, None), ("display_math", r"h = \mathcal{G}", [], None, None), ("display_math", r"\sinh", [], None, None)])
    s = graph.scoped_symbols(n)
    assert {(r.normal, r.type, r.scope) for r in s.collect()} == {("G", "group", 0), ("h", "unknown", 0), ("n", "unknown", 0)}
    assert {(r.surface, r.node) for r in graph.occurrences(s, n).collect()} == {("h", 2), (r"\mathcal{G}", 2)}


def test_context_stops_at_boundaries(spark):
    n = _nodes(spark, [("section", "A", [], "1", 1), ("paragraph", "p", [], None, None), ("subsection", "B", [], "1.1", 2), ("paragraph", "q", [], None, None), ("theorem", "T", [], "1", None), ("paragraph", "r", [], None, None), ("paragraph", "s", [], None, None), ("section", "C", [], "2", 1)])
    out = graph.context(n, spark.createDataFrame([(1, 4)], "version long, node long"), graph.edges(n)).first()
    assert out.path == ["A", "B"] and out.before == [2, 3] and out.continuation == [5, 6] and out.related is None


def test_context_lists_are_capped_by_themselves(spark):
    cites = r"\cite{" + ",".join(f"b{k}" for k in range(13)) + "}"
    rows = [("section", str(k), [], None, k) for k in range(1, 7)]
    rows += [("definition", r"Let $g$ be a group.", ["d"], None, None), ("paragraph", r"Let $h$ be a map. Here $q$ denotes a set and $u$ denotes a cell.", [], None, None), ("display_math", "h = 1", ["e"], None, None)]
    rows += [("theorem", rf"T {cites}", ["t"], "1", None), ("paragraph", r"By \eqref{e}, \ref{d}, \ref{f} and $q$.", [], None, None), ("proof", "P", [], None, None), ("figure_caption", "c", ["f"], None, None)]
    rows += [("bibliography_entry", "b", [f"b{k}"], None, None) for k in range(13)]
    n = _nodes(spark, rows)
    out = graph.context(n, n.where("kind in ('theorem', 'proof')").select("version", "node"), graph.edges(n)).orderBy("focus").collect()
    got = {k: [(x.source, x.other) for x in v] for k, v in out[0].related.asDict().items()}
    assert out[0].path == ["3", "4", "5", "6"]
    assert got == {"proofs": [(9, 11)], "proves": [], "equations": [(10, 8)], "floats": [(10, 12)], "citations": [(9, 13 + k) for k in range(12)], "references": [(10, 6)]}
    assert [(x.via, x.node, x.surface) for x in out[0].premises] == [("reference", 6, None), ("occurrence", 7, "h"), ("symbol", 7, "q")]
    assert out[0].notes == ["float_entity_unreachable", "related_truncated"]
    assert [(x.source, x.other) for x in out[1].related.proves] == [(11, 9)] and out[1].notes == []


def test_reading_order_of_deep_trees(spark):
    tree = lambda n: spark.createDataFrame([(1, k, k - 1 if k else None, -k) for k in range(n)], "version long, node long, parent long, ordinal long")
    assert [r.position for r in graph.reading_order(tree(100)).orderBy("node").collect()] == list(range(100))
    lost = tree(3).union(spark.createDataFrame([(1, 7, 8, 0), (1, 8, 7, 0), (1, 9, 99, 0)], "version long, node long, parent long, ordinal long"))
    assert [r.node for r in graph.reading_order(lost).orderBy("position").collect()] == [0, 1, 2, 8, 7, 9]


def _plain_context(rows, focus):
    """(path, before, continuation) of a focus by walking its version, rows being (ordinal, kind, text, level)."""
    at = next(r for r in rows if r[0] == focus)[0]
    shown = [r for r in sorted(rows, key=lambda r: r[0]) if (r[2] or "").strip()]
    path, least, before, after, size = [], 99, [], [], 0
    back = [r for r in reversed(shown) if r[0] < at]
    for r in back:
        if r[3] is not None and r[3] < least:
            least = r[3]
            path.append(r[2])
    for r in back[: graph.BEFORE]:
        before.append(r[0])
        if r[1] in graph.BOUNDARIES:
            break
    for r in (r for r in shown if r[0] > at):
        size += len(r[2])
        if r[1] in graph.BOUNDARIES or len(after) == graph.AFTER or size > graph.CHARACTERS:
            break
        after.append(r[0])
    return path[:4][::-1] or None, sorted(before) or None, after or None


def test_context_against_a_walk(spark):
    pick = random.Random(5)
    rows = []
    for k in range(400):
        kind = pick.choice(["paragraph"] * 12 + ["section", "subsection", "theorem", "proof"])
        text = pick.choice(["", None, " ", "x" * 900, f"t{k}", f"u{k}", f"w{k}"])
        rows.append((kind, text, [], None, pick.randrange(1, 5) if kind in ("section", "subsection") else None))
    n = _nodes(spark, rows)
    out = graph.context(n, n.select("version", "node"), graph.edges(n)).select("focus", "path", "before", "continuation").collect()
    plain = [(k, r[0], r[1], r[4]) for k, r in enumerate(rows)]
    assert len(out) == 400
    assert {r.focus: (r.path, r.before, r.continuation) for r in out} == {k: _plain_context(plain, k) for k in range(400)}


def test_incremental_ingest(spark, tmp_path):
    src, store, mark = (str(tmp_path / x) for x in ("src", "store", "mark"))
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    write([(1, "a"), (2, "b")])
    ingest.run(spark, src, store, mark, "doc_id long, text string")
    write([(1, "a"), (2, "c"), (3, None)])
    ingest.run(spark, src, store, mark, "doc_id long, text string")
    assert spark.read.parquet(store).count() == 4
    assert {(r.attachment_id, r.text) for r in ingest.current(spark.read.parquet(store)).collect()} == {(1, "a"), (2, "c"), (3, None)}
