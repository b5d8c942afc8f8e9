"""Metadata sources: web pages' meta tags, and records of bibliographic services as JSON or XML text, mapped to entries.

Responses come as rows; nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import scalars as S
from folioscan.functions.text import decode_entities, script_of


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def meta(html: str, name: str) -> Column:
    """Content of ``<meta name=… content=…>`` (or ``property=``), in either attribute order; null when absent or blank."""
    esc = name.replace(".", r"\.")
    forth = F.regexp_extract(html, rf'(?i)<meta[^>]*\b(?:name|property)="{esc}"[^>]*\bcontent="([^"]*)"', 1)
    back = F.regexp_extract(html, rf'(?i)<meta[^>]*\bcontent="([^"]*)"[^>]*\b(?:name|property)="{esc}"', 1)
    return F.coalesce(_filled(forth), _filled(back))


def clean_doi(c: Column) -> Column:
    """A DOI without prefix of either case; null unless it begins like one."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), "(?i)^doi:", ""), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.when(t.rlike(r"^10\.[0-9]{4,9}/"), t)


def web_clip(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Identifiers, title, authors, date and links of web pages, each from the first place that has it."""
    link = _filled(F.regexp_extract(html, r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1))
    doi = F.coalesce(*(clean_doi(c) for c in (meta(html, "citation_doi"), meta(html, "doi"), meta(html, "DC.Identifier"), link, meta(html, "og:url"), F.col(url))))
    arxiv = F.coalesce(meta(html, "citation_arxiv_id"), _filled(F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})", 1)))
    names = F.regexp_extract_all(html, F.lit(r'(?i)<meta[^>]*\bname="citation_author"[^>]*\bcontent="([^"]*)"'), 1)
    turned = F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.when(F.size(F.split(n, ",")) == 2, F.concat_ws(" ", F.trim(F.split(n, ",")[1]), F.trim(F.split(n, ",")[0]))).otherwise(F.trim(n)))
    title = F.coalesce(meta(html, "citation_title"), meta(html, "og:title"), _filled(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)))
    date = F.coalesce(*(meta(html, n) for n in ("citation_publication_date", "citation_date", "article:published_time", "date")))
    return pages.select("*", doi.alias("doi"), arxiv.alias("arxiv_id"), meta(html, "citation_isbn").alias("isbn"), meta(html, "citation_pdf_url").alias("pdf_url"), title.alias("title"), date.alias("published_date"), meta(html, "og:site_name").alias("site_name"), turned.alias("authors"))


def fallback_entry(clips: DataFrame, url: str = "url") -> DataFrame:
    """Entries of clips that no service knows: title or URL, year of the date, a preprint when there is an arXiv id."""
    return clips.select(F.coalesce(_filled(F.col("title")), F.col(url)).alias("title"), S.first_year("published_date").alias("year"), F.when(F.col("arxiv_id").isNotNull(), "preprint").otherwise("webpage").alias("entry_type"), S.canonical_doi("doi").alias("doi"), S.canonical_arxiv("arxiv_id").alias("arxiv_id"), S.canonical_isbn("isbn").alias("isbn"), F.col(url).alias("url"))


def resolution_order(doi: Column, arxiv: Column, isbn: Column) -> Column:
    """Which identifier to ask for first: DOI, arXiv, ISBN; arXiv first when the DOI is arXiv's own."""
    return F.when(doi.startswith("10.48550/") & arxiv.isNotNull(), "arxiv").when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").when(isbn.isNotNull(), "isbn")


_WORK = "struct<message:struct<title:array<string>,type:string,DOI:string,URL:string,abstract:string,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string,name:string,ORCID:string>>>>"


def work_records(rows: DataFrame, body: str = "body") -> DataFrame:
    """Entries of JSON work records: first title, first year, stripped abstract, authors with their ORCID."""
    r = F.from_json(body, _WORK)["message"]
    people = F.transform(r["author"], lambda a: F.struct(a["given"].alias("given"), F.coalesce(a["family"], a["name"]).alias("family"), F.regexp_extract(a["ORCID"], "([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])$", 1).alias("orcid")))
    return rows.select(r["title"][0].alias("title"), r["type"].alias("entry_type"), S.canonical_doi(r["DOI"]).alias("doi"), r["URL"].alias("url"), _filled(S.strip_tags(r["abstract"])).alias("abstract"), F.get(F.get(r["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"), people.alias("authors"))


def xml_text(c: Column | str, tag: str) -> Column:
    """Text of the first exact ``<tag>``, spaces collapsed and entities decoded."""
    return decode_entities(S.collapse_space(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1)))


def feed_entries(rows: DataFrame, body: str = "body") -> DataFrame:
    """Entries of Atom feeds, one a feed: title, year, summary and authors."""
    part = F.regexp_extract(body, r"(?s)<entry>(.*?)</entry>", 1)
    names = F.regexp_extract_all(part, F.lit(r"(?s)<name>(.*?)</name>"), 1)
    return rows.select(xml_text(part, "title").alias("title"), S.first_year(xml_text(part, "published")).alias("year"), xml_text(part, "summary").alias("abstract"), S.canonical_arxiv(F.regexp_extract(xml_text(part, "id"), "abs/(.*)$", 1)).alias("arxiv_id"), F.transform(names, F.trim).alias("authors"))


_PERSON = "struct<person:struct<name:struct<`given-names`:struct<value:string>,`family-name`:struct<value:string>>,`external-identifiers`:struct<`external-identifier`:array<struct<`external-id-type`:string,`external-id-value`:string>>>>>"
# Names of identifier schemes and the short forms they are kept under.
_SCHEMES = {"scopus author id": "scopus", "researcherid": "researcherid", "isni": "isni", "viaf": "viaf"}


def person_records(rows: DataFrame, body: str = "body") -> DataFrame:
    """Authors of JSON person records: names in parts, the script of the family name, identifiers by short scheme."""
    p = F.from_json(body, _PERSON)["person"]
    given, family = p["name"]["given-names"]["value"], p["name"]["family-name"]["value"]
    first, rest = F.element_at(F.split(given, " "), 1), F.array_join(F.slice(F.split(given, " "), 2, 100), " ")
    short = F.create_map(*(F.lit(x) for kv in _SCHEMES.items() for x in kv))
    ids = F.transform(p["external-identifiers"]["external-identifier"], lambda i: F.struct(F.coalesce(short[F.lower(i["external-id-type"])], F.lower(i["external-id-type"])).alias("scheme"), i["external-id-value"].alias("value")))
    return rows.select(first.alias("given_name"), F.nullif(rest, F.lit("")).alias("middle_name"), family.alias("family_name"), script_of(family).alias("script"), ids.alias("identifiers"))
