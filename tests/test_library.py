from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from folioscan.functions import scalars as S
from folioscan.functions import text as X
from folioscan.operators import indexes
from folioscan.operators import library as L
from folioscan.sources import metadata


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(c.alias("x")).first().x


def test_identifiers(spark):
    rows = [(" https://doi.org/10.1/AbC ", "10.1/abc"), ("HTTPS://DOI.ORG/x", "https://doi.org/x"), ("doi:", None), ("DOI: 10.2/Q", "10.2/q")]
    got = [r.x for r in spark.createDataFrame([(a,) for a, _ in rows], "a string").select(S.canonical_doi("a").alias("x")).collect()]
    assert got == [b for _, b in rows]
    assert one(spark, S.canonical_arxiv("a"), a="arXiv:hep-th/9901001v2") == "hep-th/9901001"
    assert one(spark, S.canonical_isbn("a"), a="978-3-16 x") == "978316X"
    assert one(spark, S.normalize_orcid("a"), a="https://orcid.org/0000-0002-1825-009X") == "0000-0002-1825-009X"


def test_recognisers(spark):
    lines = ["3.2 Details here", "104 Pages", "2020 was", "Related Work:", "Figure 3: A", "Fig. 2 b", "TABLE IV. C", "Tablet 3", "Theorem 2 shows", "Lemma 2.3. Let", "Definition (Name).", "Proof of Lemma 1.", "Proofread"]
    r = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, t string").select("k", S.section_number("t").alias("s"), S.section_level("t").alias("l"), S.heading_keyword("t").alias("h"), S.caption_kind("t").alias("c"), S.caption_number("t").alias("n"), S.theorem_kind("t").alias("m"), S.theorem_number("t").alias("q")).orderBy("k").collect()
    assert (r[0].s, r[0].l, r[1].s, r[2].s, r[3].h) == ("3.2", 2, None, None, "related work")
    assert [(x.c, x.n) for x in r[4:8]] == [("figure_caption", "3"), ("figure_caption", "2"), ("table_caption", "IV"), (None, None)]
    assert [(x.m, x.q) for x in r[8:]] == [(None, None), ("lemma", "2.3"), ("definition", None), ("proof", None), (None, None)]


def test_text_functions(spark):
    assert one(spark, X.name_key("a"), a="  Ａnn ﬁ ") == "ann fi"
    assert one(spark, X.decode_entities("a"), a="&lt;&#65;&#x42;&amp;&nbsp;") == "<AB&&nbsp;"
    assert one(spark, X.encode_doi("a"), a="10.1/a b<c>") == "10.1/a%20b%3Cc%3E"
    assert one(spark, X.script_of("a"), a="Ann 山田") == "Hani"
    assert one(spark, X.description("a"), a="the norm of x. And more") == "the norm of x"


def test_author_resolution(spark):
    known = spark.createDataFrame([(1, "Ann Lee", "0000-0000-0000-0001"), (2, "Bo", None)], "id long, name string, orcid string")
    new = spark.createDataFrame([(0, "A. Lee", "0000-0000-0000-0001"), (1, "BO ", None), (2, "Bo", "0000-0000-0000-0002"), (3, "New", None), (4, "new", None)], "row long, name string, orcid string")
    got = {r.row: r.author_id for r in L.resolve_authors(new, known).collect()}
    assert got[0] == 1 and got[1] == 2 and got[2] not in (1, 2) and got[3] == got[4] and len({*got.values()}) == 4


def test_conversations_get_missing_results(spark):
    rows = [(1, 0, "user", None, None), (1, 1, "assistant", ["a", "b"], None), (1, 2, "tool", None, "a"), (1, 3, "assistant", [], None), (1, 4, "tool", None, "b")]
    out = L.reconcile(spark.createDataFrame(rows, "session long, position long, role string, calls array<string>, call_id string"))
    assert out.count() == 6 and [(r.position, r.call_id) for r in out.where("filled").collect()] == [(2, "b")]


def test_web_clip(spark):
    html = '<html><head><title> T </title><meta content="doi:10.1234/x" name="citation_doi"><meta name="citation_author" content="Lee, Ann"><meta name="citation_author" content="Bo"><meta property="og:site_name" content="S"><meta name="date" content="2020-01-02"></head>'
    df = spark.createDataFrame([("https://arxiv.org/abs/2101.00001v2", html), ("http://x", "<p>")], "url string, html string")
    a, b = metadata.web_clip(df).collect()
    assert (a.doi, a.arxiv_id, a.title, a.site_name, a.authors, a.published_date) == ("10.1234/x", "2101.00001v2", "T", "S", ["Ann Lee", "Bo"], "2020-01-02")
    assert (b.doi, b.title, b.authors) == (None, None, [])
    f, g = metadata.fallback_entry(metadata.web_clip(df)).collect()
    assert (f.year, f.entry_type, f.arxiv_id, g.title, g.entry_type) == (2020, "preprint", "2101.00001", "http://x", "webpage")


def test_service_records(spark):
    work = json.dumps({"message": {"title": ["T"], "DOI": "10.1/X", "abstract": "<p>A</p>", "issued": {"date-parts": [[2001, 2]]}, "author": [{"given": "Ann", "family": "Lee", "ORCID": "http://orcid.org/0000-0000-0000-000X"}]}})
    feed = "<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>A &amp;\n B</title><published>2021-01-01T</published><author><name>Ann</name></author></entry></feed>"
    person = json.dumps({"person": {"name": {"given-names": {"value": "Ann B C"}, "family-name": {"value": "李"}}, "external-identifiers": {"external-identifier": [{"external-id-type": "Scopus Author ID", "external-id-value": "7"}]}}})
    row = lambda x: spark.createDataFrame([(x,)], "body string")
    w = metadata.work_records(row(work)).first()
    assert (w.title, w.doi, w.abstract, w.year, w.authors[0].orcid) == ("T", "10.1/x", "A", 2001, "0000-0000-0000-000X")
    e = metadata.feed_entries(row(feed)).first()
    assert (e.title, e.year, e.arxiv_id, e.authors) == ("A & B", 2021, "2101.00001", ["Ann"])
    p = metadata.person_records(row(person)).first()
    assert (p.given_name, p.middle_name, p.family_name, p.script, p.identifiers[0].scheme) == ("Ann", "B C", "李", "Hani", "scopus")


def test_alt_texts(spark):
    old = spark.createDataFrame([(1, "s", "x", "generated"), (2, "s", "y", "generated"), (3, "s", "z", "user")], "id long, sha256 string, text string, origin string")
    assert L.carry_alt_texts(old, spark.createDataFrame([(9, "s"), (8, "t")], "node_id long, sha256 string")).collect()[0].text == "y"
    figures = spark.createDataFrame([(1, 5, 300, 300), (1, 4, 100, 300), (2, 6, 250, 250)], "node_id long, asset_id long, width int, height int")
    assert [tuple(r) for r in L.figures_without_alt_text(figures, spark.createDataFrame([(2,)], "node_id long")).collect()] == [(1, 5)]


def test_scalars(spark):
    assert [r.x for r in spark.createDataFrame([(n,) for n in (0, 1, 26, 27, 52, 53, 702, 703)], "n int").select(S.suffix_letters(F.col("n")).alias("x")).collect()] == ["", "a", "z", "aa", "az", "ba", "zz", "aaa"]
    assert one(spark, S.strip_tags("a"), a="<b>x</b> y <z") == "x y "
    assert one(spark, S.clean_control("a"), a="a\r\nb\x00\tc") == "a\nb\tc"
    assert one(spark, S.base_citation_key(F.lit("李"), F.lit("Ann Lee"), F.lit("t"), F.lit(None).cast("int")), a=1) == "leend"


def test_clip_plan(spark):
    entries = spark.createDataFrame([(1, "10.1/A", "2101.00001v3", None, False), (2, "10.1/a", None, None, False), (3, "10.2/b", None, None, True)], "id long, doi string, arxiv_id string, isbn string, trashed boolean")
    clips = spark.createDataFrame([(10, "doi:10.1/a", None, None), (11, None, "arXiv:2101.00001", None), (12, "10.2/b", None, None), (13, None, None, None)], "id long, doi string, arxiv_id string, isbn string")
    files = spark.createDataFrame([(1, "application/pdf")], "entry_id long, mime_type string")
    got = {r.clip: (r.duplicate, r.action, r.missing_pdf, r.missing_tex) for r in L.clip_plan(clips, entries, files).collect()}
    assert got == {10: (1, "duplicate", False, True), 11: (1, "duplicate", False, True), 12: (None, "create", False, False), 13: (None, "create", False, False)}


def test_postings_of_a_long_text(spark):
    long = "".join(f"{k:x}\n" for k in range(60_000)) + "𝔄é 山"
    texts = [(1, long), (2, "AB"), (3, None), (4, "aBcab\r\n𝔄b"), (5, "")]
    began = time.time()
    grams, rows = indexes.postings(spark.createDataFrame(texts, "id long, text string"), "id", ["text"])
    got = sorted((r.id, r.gram) for r in grams.collect())
    assert time.time() - began < 60  # by position each trigram walks the text from its start
    low = [(k, (t or "").lower()) for k, t in texts]
    assert got == sorted({(k, t[i : i + 3]) for k, t in low for i in range(len(t) - 2)})
    assert {r.id: r.dl for r in rows.collect()} == {k: max(len(t) - 2, 0) for k, t in low}
