"""Full-text search: substring tokens, ranked by BM25 over overlapping occurrences and trigram counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.scalars import fold_ascii

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens_of(query: str) -> list[str]:
    """Words of a query, without quotation marks."""
    return [t for t in (w.replace('"', "") for w in query.split()) if t]


def is_short(tokens: list[str]) -> bool:
    """Whether a token is too short for trigrams: then the whole query is matched by plain, ASCII-folded substrings."""
    return any(len(t) < 3 for t in tokens)


def matches(columns: list[str], tokens: list[str]) -> Column:
    """Every token stands in any of the columns; nothing matches an empty query."""
    out = F.lit(bool(tokens))
    for t in tokens:
        if is_short(tokens):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            hit = [F.coalesce(F.contains(fold_ascii(c), F.lit(low)), F.lit(False)) for c in columns]
        else:
            hit = [F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False)) for c in columns]
        any_of = hit[0]
        for h in hit[1:]:
            any_of = any_of | h
        out = out & any_of
    return out


def bm25(index: DataFrame, key: str, columns: list[str], tokens: list[str], scope: DataFrame | None = None) -> DataFrame:
    """(key, score) of the matching rows, lower is better; statistics cover the whole ``index``, before ``scope`` (keys).

    One pass adds up documents, lengths and document frequencies; the one-row result joins the matches.
    """
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    length = sum((F.greatest(F.char_length(c) - 2, F.lit(0)) for c in low), F.lit(0))
    count = lambda t: sum((F.regexp_count(c, F.lit(f"(?={re.escape(t.lower())})")) for c in low), F.lit(0))
    rows = index.select(key, length.alias("dl"), matches(columns, tokens).alias("hit"), *(count(t).alias(f"f{k}") for k, t in enumerate(tokens)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(tokens))))
    found = rows.where("hit")
    if scope is not None:
        found = found.join(scope, key, "left_semi")
    score = F.lit(0.0)
    for k in range(len(tokens)):
        idf = F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        f = F.col(f"f{k}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats: one row


def search(index: DataFrame, key: str, columns: list[str], query: str, scope: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(key, score) for a query: by BM25, or newest first with score 0 when a token is short."""
    tokens = tokens_of(query)
    if not tokens:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    if is_short(tokens):
        found = index.where(matches(columns, tokens)).select(key, F.lit(0.0).alias("score"))
        found = found.join(scope, key, "left_semi") if scope is not None else found
        found = found.orderBy(F.desc(key))
    else:
        found = bm25(index, key, columns, tokens, scope).orderBy("score", key)
    return found.limit(most) if most is not None else found


def snippet(text: str, token: str, before: int = 20, length: int = 60) -> Column:
    """A window around the first occurrence of a token, else the first 200 characters."""
    at = F.locate(token.lower(), F.lower(F.col(text)))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(F.col(text), start, F.lit(length))).otherwise(F.substring(text, 1, 200))
