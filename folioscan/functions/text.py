"""Scalar functions that the JVM has no counterpart for; pandas UDFs over Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Trimmed, NFKC, lower case."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s.strip()).lower())


_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);")


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """The five named XML entities and numeric ones; others stay."""
    return texts.map(lambda s: None if s is None else _ENTITY.sub(lambda m: html.unescape(m[0]), s))


@F.pandas_udf(StringType())
def encode_doi(dois: pd.Series) -> pd.Series:
    """Percent-encoded but for unreserved characters and ``/().:``."""
    return dois.map(lambda s: None if s is None else quote(s, safe="-._~/().:"))


_SCRIPTS = (("Hani", "㐀", "鿿"), ("Kana", "぀", "ヿ"), ("Hang", "가", "힣"), ("Cyrl", "Ѐ", "ӿ"), ("Grek", "Ͱ", "Ͽ"), ("Arab", "؀", "ۿ"), ("Hebr", "֐", "׿"), ("Deva", "ऀ", "ॿ"), ("Thai", "฀", "๿"))


@F.pandas_udf(StringType())
def script_of(names: pd.Series) -> pd.Series:
    """Script of the first character outside Latin; null if there is none."""
    return names.map(lambda s: next((k for c in s or "" for k, lo, hi in _SCRIPTS if lo <= c <= hi), None))


@F.pandas_udf(StringType())
def description(texts: pd.Series) -> pd.Series:
    """What is said of a symbol: up to a stop, semicolon, line break or formula, 160 bytes at most, 3 characters at least."""

    def cut(s: str | None) -> str | None:
        if s is None:
            return None
        s = re.split(r"\. |; |\n|\$\$|\\\[", s, maxsplit=1)[0].strip().rstrip(".,;:")
        s = s.encode()[:160].decode(errors="ignore").strip()
        return s if len(s) >= 3 else None

    return texts.map(cut)
