"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and finds anchors: at-signs, digits, URL schemes and identifier
cues. A deterministic parser per kind then expands an anchor to the run of characters that its kind allows and
validates what stands there. No text is scanned by a pattern as a whole.

Kinds, in order: email, ip, card, phone (the base kinds), then url, iban, secret (``token = "…"`` and the like, bearer
tokens, and access keys that are known by their prefix).

Defined results: a null text counts as empty and has no spans; equal texts have equal spans; columns of the input
other than the key and the text are ignored; an empty table gives an empty result. Texts of any length are read
whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "secret")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "bearer", "authorization")
#: Prefixes of access keys, and what follows them in the public formats.
PREFIXES = {"AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "ghp_": "[A-Za-z0-9]{36}", "gho_": "[A-Za-z0-9]{36}", "github_pat_": "[A-Za-z0-9_]{22,}", "xoxb-": "[A-Za-z0-9-]{20,}", "xoxp-": "[A-Za-z0-9-]{20,}", "AIza": "[A-Za-z0-9_-]{35}", "sk_live_": "[A-Za-z0-9]{16,}", "glpat-": "[A-Za-z0-9_-]{20,}", "eyJ": r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]*")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_IP_RUN = re.compile(r"[0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CARD_RUN = re.compile(r"[0-9 -]*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PHONE_RUN = re.compile(r"\+[ ().0-9-]*")
_URL_REST = re.compile(r"""[^\s<>"'`|\\^{}\[\]]+""")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"""(?i:["']?\s{0,3}[:=]\s{0,3}["']?)([A-Za-z0-9_+/=.-]{12,})""")
_BEARER = re.compile(r"\s{1,3}([A-Za-z0-9_+/=.-]{16,})")
_AFTER = {p: re.compile(rest + "(?![A-Za-z0-9])") for p, rest in PREFIXES.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [("@", "@"), *((d, "0") for d in "0123456789"), *((s, "url") for s in SCHEMES), *((c, "cue") for c in CUES), *((c.upper(), "cue") for c in CUES), *((c.capitalize(), "cue") for c in CUES), *((p, "prefix") for p in PREFIXES)]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


_ANCHORS: list[ahocorasick.Automaton] = []


def _back(text: str, at: int, least: int, allowed: frozenset | str) -> int:
    """The first place, not before ``least``, from which all characters up to ``at`` are allowed."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _small(digits: str) -> bool:
    """Whether a number without leading zeros, of whatever length, is at most 255."""
    return len(digits) < 3 or (len(digits) == 3 and int(digits) <= 255)


def _digit_spans(text: str, at: int, done: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """What the digit at ``at`` belongs to. A run that was parsed once is not parsed again."""
    if at >= done["ip"]:
        lo = _back(text, at, 0, "0123456789.")
        done["ip"] = hi = _IP_RUN.match(text, at).end()
        if text.count(".", lo, hi) >= 3:
            for m in _IP.finditer(text, lo, hi):
                if all(_small(x.lstrip("0")) for x in m[0].split(".")):
                    yield "ip", m.start(), m.end()
    if at >= done["card"]:
        lo = _back(text, at, 0, "0123456789 -")
        done["card"] = hi = _CARD_RUN.match(text, at).end()
        if hi - lo >= 16:
            for m in _CARD.finditer(text, lo, hi):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    yield "card", m.start(), m.end()
    if at >= done["phone"] and text[at - 1 : at] == "+":
        hi = _PHONE_RUN.match(text, at - 1).end()
        if m := _PHONE.match(text, at - 1, hi):
            done["phone"] = m.end()
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    s = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, end exclusive, sorted by kind as in ``KINDS``, then start."""
    if not text:
        return []
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _ANCHORS[0].iter(text):
        if kind == "0":
            for what, lo, hi in _digit_spans(text, last, done):
                found[what].append((lo, hi))
            if last >= done["iban"] and last >= 2 and text[last - 1].isupper() and text[last - 2].isupper() and (m := _IBAN.match(text, last - 2)):
                done["iban"] = m.end()
                if _iban(m[0]):
                    found["iban"].append(m.span())
        elif kind == "@":
            lo = _back(text, last, done["email"], _LOCAL)
            if m := _EMAIL.match(text, lo) if lo < last else None:
                done["email"] = m.end()
                found["email"].append(m.span())
        elif kind == "url":
            lo = last + 1 - size
            if lo >= done["url"] and (m := _URL_REST.match(text, last + 1)):
                hi = m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?)")))
                if hi > last + 1:
                    done["url"] = hi
                    found["url"].append((lo, hi))
        elif last + 1 - size < done["secret"]:
            continue  # within a secret that was found
        elif kind == "prefix":
            lo = last + 1 - size
            if (lo == 0 or not text[lo - 1].isalnum()) and (m := _AFTER[text[lo : last + 1]].match(text, last + 1)):
                done["secret"] = m.end()
                found["secret"].append((lo, m.end()))
        elif m := _SECRET.match(text, last + 1) or (_BEARER.match(text, last + 1) if text[last - 5 : last + 1].lower() == "bearer" else None):
            done["secret"] = m.end()
            found["secret"].append(m.span(1))
    return [(k, lo, hi) for k in KINDS for lo, hi in found[k]]


def redact(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """``text`` with every span replaced by its kind in brackets; where spans overlap, the kind of the one that starts first stands for all that they cover."""
    if not text:
        return text
    out, at = [], 0
    for kind, lo, hi in sorted(find(text) if spans is None else spans, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]]) if out else text


SPAN_SCHEMA = "array<struct<kind:string,start:bigint,end:bigint>>"


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key and ``spans``, an array of (kind, start, end)."""
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kinds))], [key, "spans"])

    return map_arrow(df.select(key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, spans {SPAN_SCHEMA}", text)


def scrub(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its personal data replaced in ``text``; all other columns and all rows stay as they are."""
    names, at = df.columns, df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(len(names))], names)

    return map_arrow(df, run, df.schema, text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text with their number."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return spans.select(key, *(of(k) for k in BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """As in ``digest``, for one text."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE_KINDS).encode()).hexdigest()
