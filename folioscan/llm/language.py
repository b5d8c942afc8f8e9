"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds its letters: the first vector permuted twice, the second
once, and the third, multiplied. A text's profile bundles (adds) the vectors of all its trigrams, a language's prototype
bundles its training texts, and a text gets the language whose prototype has the highest cosine with its profile.

Letters a to z are symbols of their own, all others share ``OTHERS`` symbols by code point; whatever is no letter is one
boundary, and so are a text's ends. Whole texts are read.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without training texts every text is; ties
go to the language that sorts first; equal texts get equal results, to the last bit and
whatever else is in their batch, as profiles are whole numbers; other columns are ignored; an empty table
gives an empty result. Rows with a null language or text teach nothing. Any number of languages is taken; the
model, 8 KB a language, is all that the driver holds and sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_arrow, pieces_of, settle, small_batches, steady

DIMENSIONS, OTHERS = 1024, 16
#: Languages whose trigrams a task counts at a time, and trigrams whose vectors are added at a time (exact in single precision).
_COUNTED, _ADDED = 64, 1 << 23
_SYMBOLS = 27 + OTHERS
_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of every code point: 0 boundary, 1 to 26 the letters a to z of either case, then the other letters."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                k = ord(s.lower()[0])
                table[c] = k - 96 if 97 <= k <= 122 else 27 + (k * 2654435761 >> 7) % OTHERS
        _TABLE.append(table)
    return _TABLE[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of all texts in order, their n + 1 offsets, and whether each text has a letter."""
    size = np.array([len(t) + 2 if t else 2 for t in texts])
    s = _symbols()[np.frombuffer("".join(f"\n{t or ''}\n" for t in texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    keep[np.cumsum(size) - size] = True
    letters = np.bincount(text[s > 0], minlength=len(texts)) > 0
    s, text = s[keep], text[keep]
    good = text[2:] == text[:-2]
    code = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:]
    return code[good], np.concatenate(([0], np.cumsum(np.bincount(text[2:][good], minlength=len(texts))))), letters


class Space:
    """Vectors of the trigrams met so far; there are ``_SYMBOLS ** 3`` at most."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (_SYMBOLS, dimensions))
        self.place = np.full(_SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((4096, dimensions), np.float32)
        self.n = 0

    def places(self, code: np.ndarray) -> np.ndarray:
        at = self.place[code]
        if (at < 0).any():
            new = np.unique(code[at < 0])
            while self.n + len(new) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            a, b, c = new // _SYMBOLS**2, new // _SYMBOLS % _SYMBOLS, new % _SYMBOLS
            self.vectors[self.n : self.n + len(new)] = np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]
            self.place[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            at = self.place[code]
        return at

    def bundle(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The sum of the vectors of different trigrams, each as often as ``count`` says, in whole numbers.

        Each product is a sum of whole numbers below 2 ** 24 in all, which single precision adds exactly in any order.
        """
        at, out = self.places(code), np.zeros(self.vectors.shape[1], np.int64)
        while len(at):
            part = np.minimum(count, _ADDED)
            stop = max(1, int(np.searchsorted(np.cumsum(part), _ADDED, side="right")))
            out += (part[:stop].astype(np.float32) @ self.vectors[at[:stop]]).astype(np.int64)
            count = count.copy()
            count[:stop] -= part[:stop]
            left = count > 0
            at, count = at[left], count[left]
        return out

    def profile(self, code: np.ndarray) -> np.ndarray:
        some, count = np.unique(code, return_counts=True)
        return self.bundle(some, count)


_SPACES: dict[tuple[int, int], Space] = {}


def _space(dimensions: int, seed: int) -> Space:
    if (dimensions, seed) not in _SPACES:
        _SPACES[dimensions, seed] = Space(dimensions, seed)
    return _SPACES[dimensions, seed]


def prototypes(df: DataFrame, lang: str = "lang", text: str = "text", dimensions: int = DIMENSIONS, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from all rows of ``df`` that have both.

    Tasks bundle what they read into one vector of whole numbers a language, and the vectors are added on the executors:
    the driver sees ``dimensions`` numbers for each language, whatever the number of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        counts: dict[str, np.ndarray] = {}
        sums: dict[str, np.ndarray] = {}

        def bundle() -> None:
            for name, count in counts.items():
                some = np.flatnonzero(count)
                sums[name] = sums.get(name, 0) + _space(dimensions, seed).bundle(some, count[some])
            counts.clear()

        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20) if batch.num_rows else ():
                code, at, _ = trigrams(part.column(1).to_pylist())
                names = np.array(part.column(0).to_pylist(), object)
                who = np.repeat(np.arange(len(names)), np.diff(at))
                for name in dict.fromkeys(names):
                    if len(counts) >= _COUNTED and name not in counts:
                        bundle()
                    counts[name] = counts.get(name, 0) + np.bincount(code[(names == name)[who]], minlength=_SYMBOLS**3)
        bundle()
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], ["lang", "at", "v"])
        settle()

    known = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    small_batches(df.sparkSession)
    added = known.mapInArrow(run, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    rows = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v")).select("lang", F.col("v.v").alias("v")).collect()
    names = sorted(r["lang"] for r in rows)
    of = {r["lang"]: np.array(r["v"], float) for r in rows}
    out = np.array([of[n] for n in names]).reshape(len(names), dimensions)
    return names, out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS, seed: int = 11) -> DataFrame:
    """The key, ``lang_pred`` and ``score``, the cosine with that language's prototype, cut to 0 to 1."""
    names, protos = model

    def one(code: np.ndarray) -> tuple[str, float]:
        profile = _space(dimensions, seed).profile(code).astype(float)
        cosine = (protos * profile).sum(axis=1) / max(float(np.sqrt((profile * profile).sum())), 1e-12)
        best = int(cosine.argmax())
        return names[best], float(min(max(cosine[best], 0.0), 1.0))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, at, letters = trigrams(batch.column(1).to_pylist())
        found = [one(code[at[k] : at[k + 1]]) if letters[k] and names else ("und", 0.0) for k in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [key, "lang_pred", "score"])

    return map_arrow(df.select(f"`{key}`", f"`{text}`"), run, f"`{key}` {df.schema[key].dataType.simpleString()}, lang_pred string, score double", text)


def held_out(key: Column | str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
