"""Scalar functions as column expressions; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that a DOI may be written with, headings that papers use, words that open a theorem-like block, and
# characters that mark mathematics.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:", "DOI:")
HEADINGS = (
    "abstract", "introduction", "related work", "background", "motivation", "preliminaries", "notation", "method", "methods", "methodology", "approach",
    "materials and methods", "experiments", "experimental setup", "experimental results", "results", "results and discussion", "evaluation", "analysis", "discussion",
    "conclusion", "conclusions", "concluding remarks", "future work", "limitations", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
    "references", "bibliography", "appendix", "appendices", "supplementary material",
)
THEOREM_WORDS = ("theorem", "lemma", "proposition", "corollary", "definition", "remark", "example", "proof")
STRONG_MATH = "=≠≈≃≅≡≤≥≪≫<>≺≻+−±∓×÷·⋅∗∘⊗⊕⊙⊘∑∏∫∬∮√∛∞∂∇∝∆∈∉∋⊂⊆⊃⊇⊄∪∩∖∅∀∃∄∴∵→↦↔⇒⇔⟨⟩‖⌊⌋⌈⌉∧∨¬ℝℂℤℕℚℍℋℓ℘′″⊤⊥⊢⊨"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def canonical_doi(c: Column | str) -> Column:
    """Trimmed, without one prefix (as spelled in ``DOI_PREFIXES``), in lower case; null when nothing is left."""
    pattern = "^(" + "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES) + ")"
    return _filled(F.lower(F.trim(F.regexp_replace(F.trim(_col(c)), pattern, ""))))


def normalize_arxiv(c: Column | str) -> Column:
    """Without ``arXiv:`` and a trailing version; an old-style category stays."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(c)), "^(arXiv:|arxiv:)", ""), "v[0-9]+$", "")


def canonical_arxiv(c: Column | str) -> Column:
    return _filled(F.lower(normalize_arxiv(c)))


def canonical_isbn(c: Column | str) -> Column:
    """ASCII letters and digits only, in upper case."""
    return _filled(F.upper(F.regexp_replace(_col(c), "[^0-9A-Za-z]", "")))


def normalize_orcid(c: Column | str) -> Column:
    """The last part of a path; null unless it has the shape of an ORCID."""
    last = F.trim(F.element_at(F.split(F.regexp_replace(F.trim(_col(c)), "/+$", ""), "/"), -1))
    return F.when(last.rlike("^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"), last)


def sanitize_citation_key(c: Column | str) -> Column:
    return _filled(F.regexp_replace(_col(c), "[^A-Za-z0-9_:./+-]", ""))


def base_citation_key(family: Column, name: Column, title: Column, year: Column) -> Column:
    """Family name, else the last word of the name, else the first of the title, with the year or ``nd``.

    Only ASCII letters, digits and underscores stay; if that leaves the year alone, the last word of the name is tried.
    """
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "")
    last = F.element_at(F.split(_filled(F.trim(name)), r"\s+"), -1)
    first = F.coalesce(_filled(F.element_at(F.split(F.trim(title), r"\s+"), 1)), F.lit("unknown"))
    when = F.coalesce(year.cast("string"), F.lit("nd"))
    key = clean(F.concat(F.lower(F.coalesce(_filled(F.trim(family)), last, first)), when))
    other = clean(F.concat(F.lower(last), when))
    return F.when((key == when) & last.isNotNull() & (other != when), other).otherwise(key)


def suffix_letters(n: Column) -> Column:
    """'' for 0, then a … z, aa …, as spreadsheet columns are named; up to three letters."""
    m = n - 1
    letter = lambda k: F.chr((F.lit(97) + k).cast("int"))
    one, two = F.lit(26), F.lit(26 + 26 * 26)
    return (
        F.when(n <= 0, "")
        .when(n <= one, letter(m))
        .when(n <= two, F.concat(letter(F.floor((m - 26) / 26)), letter((m - 26) % 26)))
        .otherwise(F.concat(letter(F.floor((m - 702) / 676)), letter(F.floor((m - 702) / 26) % 26), letter((m - 702) % 26)))
    )


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by line breaks; a null part counts as empty."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)


def clip(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, then an ellipsis."""
    c = _col(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def strip_tags(c: Column | str) -> Column:
    """Without ``<…>``; an unclosed ``<`` drops the rest."""
    return F.regexp_replace(_col(c), "<[^>]*(>|$)", "")


def clean_control(c: Column | str) -> Column:
    """CRLF and CR as line breaks, without other control characters but tabs."""
    return F.regexp_replace(F.regexp_replace(_col(c), "\r\n?", "\n"), "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]", "")


def collapse_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def fold_ascii(c: Column | str) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def json_pick(c: Column | str, key: str, kind: str = "string") -> Column:
    return F.get_json_object(_col(c), f"$.{key}").cast(kind)


def first_year(c: Column | str) -> Column:
    """The year that a date begins with, 1000 to 9999."""
    y = F.regexp_extract(F.trim(_col(c)), "^([0-9]{4})", 1)
    return F.when((y != "") & (y >= "1000"), y.cast("int"))


def interval_due(last: Column, now: Column, seconds: int) -> Column:
    """Whether a job is due: it never ran, ran ``seconds`` ago or more, or is recorded in the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(last)
    return last.isNull() | (age < 0) | (age >= seconds)


def alpha_ratio(c: Column | str) -> Column:
    """Share of letters among the characters that are no white space."""
    c = _col(c)
    full = F.char_length(F.regexp_replace(c, r"\s", ""))
    return F.when(full == 0, 0.0).otherwise(F.char_length(F.regexp_replace(c, r"[^\p{L}]", "")) / full)


def strong_math(c: Column | str) -> Column:
    c = _col(c)
    return (F.char_length(c) - F.char_length(F.translate(c, STRONG_MATH, ""))).cast("int")


def word_count(c: Column | str) -> Column:
    c = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


_SECTION = r"^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+(\p{L}.*)$"


def section_number(c: Column | str) -> Column:
    """Number of a heading like ``3.2 Details``; null for one level of 100 or more."""
    c = _col(c)
    number = _filled(F.regexp_extract(c, _SECTION, 1))
    return F.when(~number.rlike(r"^[0-9]{3,}$"), number)


def section_level(c: Column | str) -> Column:
    number = section_number(c)
    return F.when(number.isNotNull(), F.size(F.split(number, r"\.")))


def heading_keyword(c: Column | str) -> Column:
    """The known heading that a line is, without a closing colon or stop."""
    word = F.lower(F.regexp_replace(collapse_space(c), "[:.]+$", ""))
    return F.when(word.isin(*HEADINGS), word)


def caption_label(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"^\s*(?i:(figure|fig|table|algorithm|listing))\b", 1)


def caption_number(c: Column | str) -> Column:
    """The number of a caption line: digits soon after the label, or a roman numeral after a label in capitals; else null."""
    c = _col(c)
    digits = F.regexp_extract(c, r"^\s*(?i:figure|fig\.|fig|table|algorithm|listing)[^0-9\p{L}]{0,5}([0-9]+)", 1)
    roman = F.regexp_extract(c, r"^\s*(?:FIGURE|FIG\.?|TABLE|ALGORITHM|LISTING)\s+([IVXLC]+)[.:]", 1)
    return F.coalesce(_filled(digits), _filled(roman))


def caption_kind(c: Column | str) -> Column:
    label = F.lower(caption_label(c))
    return F.when(caption_number(c).isNull(), None).when(label == "table", "table_caption").otherwise("figure_caption")


_THEOREM = r"^\s*(?i:(theorem|lemma|proposition|corollary|definition|remark|example))\s*([0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)*)?\s*[.:(—–]"
_PROOF = r"^\s*(?i:proof)\s*(?:$|[.:(—–]|(?i:of)(?:\s|$))"


def theorem_kind(c: Column | str) -> Column:
    c = _col(c)
    return F.coalesce(_filled(F.lower(F.regexp_extract(c, _THEOREM, 1))), F.when(c.rlike(_PROOF), "proof"))


def theorem_number(c: Column | str) -> Column:
    return _filled(F.regexp_extract(_col(c), _THEOREM, 2))


def equation_label(c: Column | str) -> Column:
    """A number in parentheses at the end of a line, of 10 characters at most."""
    return _filled(F.regexp_extract(_col(c), r"\(([0-9A-Za-z.]{1,10})\)\s*$", 1))


def display_math(c: Column | str, lines: Column) -> Column:
    """Confidence that a block is a displayed formula; null if it is none."""
    strong, ratio = strong_math(c), alpha_ratio(c)
    labelled = equation_label(c).isNotNull()
    return F.when((lines <= 3) & (strong > 0) & (ratio < 0.7) & ((strong >= 2) | (ratio < 0.6) | labelled), F.least(F.lit(0.5) + F.lit(0.05) * strong, F.lit(0.75)))


def prose_kind(kind: Column) -> Column:
    """Whether a block counts as running text."""
    return kind.isin("paragraph", "abstract", "unknown")
