"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at line breaks and after a word that ends in ``.``, ``!`` or ``?``; a sentence of more
than ``LONG`` words is also cut after words whose hash says so, so that a passage without stops is cut alike wherever
it stands. A span is a run of at least ``SENTENCES`` sentences with at least ``WORDS`` words, as short as it can be: the one
that begins at each sentence, and the one that ends at each sentence. Beside the sentences, and whatever their length, a text is
cut before each word whose hash is the least of some ``WINDOW`` words in a row; such cuts are ``WINDOW`` words apart at most and
fall alike in equal words, but for ``WINDOW`` - 1 words at either end. A run of these pieces with at least ``PASSAGE`` words, as
short as it can be, is a span too, so any passage of 51 words or more that occurs before loses all but at most 7 words at its
start and 8 at its end, wherever it stands in a sentence or line. Spans are compared by a 128-bit hash of their words, over all
texts; of a span that occurs more than once, the occurrence in the smallest id, and there the first, stays, and the
words that any other occurrence covers are removed, where at least ``WORDS`` words in a row are covered: a passage of 51 words is
sure of 36, and what repeats in fewer (a line, a stock phrase, the unchanged words between the edits of a near copy) stays.

Defined results: null and empty texts have no sentences and stay as they are; texts of fewer than ``WORDS`` words are never
changed; a text all of whose sentences are covered becomes empty, and its row stays; rows with a null
id are kept unchanged and are not compared; rows with the same id count as one text in the choice of the first;
all columns of the input, whatever their names, stay as they are but the text; an empty table gives an empty
result. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import IdFilter, discard, fresh, map_arrow, mix64, range_hashes, save, sums_of_ranges, utf8, words

SENTENCES, WORDS, LONG = 3, 36, 20
WINDOW, PASSAGE = 8, 28
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def content_cuts(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of the words that have the least hash of some ``WINDOW`` words in a row of their text."""
    h = mix64(hashes)
    least = h.copy()
    for step in (1, 2, 4):
        least[:-step] = np.minimum(least[:-step], least[step:])
    least[max(0, len(h) - WINDOW + 1) :] = 0
    least[: 1 - WINDOW][text[: 1 - WINDOW] != text[WINDOW - 1 :]] = 0
    for step in (1, 2, 4):
        least[step:] = np.maximum(least[step:], least[:-step])
    return np.flatnonzero(h == least)


class Sentences:
    """Sentences of the texts of a column.

    ``first`` and ``last``: word numbers [first, last) of each sentence; ``text``: its text; ``lo`` and ``hi``: its bytes with the
    white space after it. ``word_text`` and ``word_at``: the text of each word and the first word of each text; ``word_lo``: where
    the bytes of each word begin, those of a text's first word with the white space before it.
    """

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = utf8(column)
        data, offsets = self.data, self.offsets
        starts, ends, text = words(data, offsets)
        self.hashes = range_hashes(data, starts, ends)
        lines = np.concatenate(([0], np.cumsum(data == 10)))[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (text[1:] != text[:-1]) | (lines[1:] != lines[:-1]) | _STOP[data[ends[:-1] - 1]]
        if len(new):
            number = np.cumsum(new) - 1
            long = np.bincount(number)[number] > LONG
            new[1:] |= long[1:] & (mix64(self.hashes[:-1]) % np.uint64(8) == 0)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(starts))[: len(self.first)]
        self.text = text[self.first]
        at = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=len(offsets) - 1))))
        self.number = np.arange(len(self.first)) - at[self.text]
        self.at = at
        self.lo = starts[self.first]
        self.lo[self.number == 0] = offsets[:-1][self.text[self.number == 0]]
        self.hi = np.minimum(np.append(self.lo[1:], len(data))[: len(self.lo)], offsets[1:][self.text])
        self.word_text = text
        self.word_at = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1))))
        self.word_lo = starts
        self.word_lo[self.first[self.number == 0]] = offsets[:-1][self.text[self.number == 0]]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words [first, last) of every span of sentences and of pieces, and two 64-bit hashes of it."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        pieces = np.union1d(content_cuts(self.hashes, self.word_text), self.first[self.number == 0])
        runs = _runs(self.first, self.last, self.text, SENTENCES, WORDS), _runs(pieces, np.append(pieces[1:], len(self.hashes)), self.word_text[pieces], 1, PASSAGE)
        a, z = (np.concatenate(x) for x in zip(*runs, strict=True))
        size = (z - a).astype(np.uint64)
        other = mix64(self.hashes ^ np.uint64(0x8EBC6AF09C88C6E3))
        return a, z, mix64(sums_of_ranges(self.hashes, a, z) + size), mix64(sums_of_ranges(other, a, z) + size)


def _runs(first: np.ndarray, last: np.ndarray, text: np.ndarray, parts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words [first, last) of the shortest runs of ``parts`` parts and ``size`` words that begin or end at each part."""
    n = len(first)
    i = np.arange(n)
    e = np.maximum(np.searchsorted(last, first + size), i + parts - 1)
    forth = np.flatnonzero(e < n)
    forth = forth[text[e[forth]] == text[forth]]
    b = np.minimum(np.searchsorted(first, last - size, side="right") - 1, i - parts + 1)
    back = np.flatnonzero(b >= 0)
    back = back[(text[b[back]] == text[back]) & (e[b[back]] != back)]
    return first[np.concatenate((forth, b[back]))], last[np.concatenate((e[forth], back))]


def _own(s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different spans (first, last, hashes) and whether the same text has had each before."""
    lo, hi, h, g = s.spans()
    order = np.lexsort((lo, g, h, s.word_text[lo]))
    lo, hi, h, g = lo[order], hi[order], h[order], g[order]
    again = np.zeros(len(lo), bool)
    again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (s.word_text[lo][1:] == s.word_text[lo][:-1])
    new = np.ones(len(lo), bool)
    new[1:] = ~again[1:] | (lo[1:] != lo[:-1])
    return lo[new], hi[new], h[new], g[new], again[new]


def removals(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(id, first, last): the words [first, last) of each text, numbered from 0, that a non-first occurrence covers.

    Second, the written tables that it reads.
    """
    name = "id_" if text.lower() == "id" else "id"
    rows = df.select(F.col(f"`{key}`").cast("long").alias(name), F.col(f"`{text}`").alias(text)).where(f"{name} is not null")

    def every(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Sentences(batch.column(1))
        lo, _, h, g, again = _own(s)
        keep = ~again
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(g[keep].view(np.int64)), pa.array(batch.column(0).to_numpy()[s.word_text[lo[keep]]])], ["h", "g", "id"])

    shared = map_arrow(rows, every, "h long, g long, id long", text).groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most").select("h", "g", "least")
    shared = save(shared, "shared")
    seen = IdFilter(shared.select("h"))

    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Sentences(batch.column(1))
        lo, hi, h, g, again = _own(s)
        pick = again | seen.has(h.view(np.int64))
        lo, hi, h, g, again = lo[pick], hi[pick], h[pick], g[pick], again[pick]
        of = s.word_text[lo]
        number = lambda x: pa.array((x - s.word_at[of]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(batch.column(0).to_numpy()[of]), number(lo), number(hi), pa.array(again)], ["h", "g", "id", "first", "last", "again"])

    found = save(map_arrow(rows, wanted, "h long, g long, id long, first int, last int, again boolean", text), "found")
    seen.destroy()
    later = found.where("not again").join(shared, ["h", "g"]).where("id != least")
    return later.select("id", "first", "last").union(found.where("again").select("id", "first", "last")), [shared, found]


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the words of ``removals``."""
    return _applied(df, key, text, report=False)


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the text without the removed words, how many sentences it had, how many of them lost words, and which.

    ``removed`` names a sentence that is gone by its number, and one that lost a part as number:first-last (words [first, last) of it).
    """
    return _applied(df.select(f"`{key}`", f"`{text}`"), key, text, report=True)


def _stretches(mask: np.ndarray) -> np.ndarray:
    """Ranges [first, last) in which ``mask`` holds."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])))).reshape(-1, 2)


def _said(gone: np.ndarray, first: np.ndarray) -> tuple[int, str]:
    """How many of the sentences that begin at the words ``first`` lost words, and which."""
    out = []
    size, less = np.diff(np.append(first, len(gone))), np.add.reduceat(gone.astype(np.int64), first)
    hit = np.flatnonzero(less)
    for k in hit:
        out += [str(k)] if less[k] == size[k] else [f"{k}:{x}-{y}" for x, y in _stretches(gone[first[k] : first[k] + size[k]])]
    return len(hit), ",".join(out)


def _applied(df: DataFrame, key: str, text: str, report: bool) -> DataFrame:
    cuts, read = removals(df, key, text)
    gone = save(cuts.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("cuts")), "cuts")
    discard(*read)
    seen = IdFilter(gone.select("id"))
    names, kinds = df.columns, df.schema
    at, where = names.index(text), names.index(key)
    out = f"{key} {df.schema[key].dataType.simpleString()}, {text} string, n_sentences long, n_removed long, removed string" if report else kinds

    def cut(batch: pa.RecordBatch, cuts: list) -> pa.RecordBatch:
        s = Sentences(batch.column(at))
        column, lost, said = batch.column(at).to_pylist(), np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
        for k, ranges in enumerate(cuts):
            if ranges:
                a, n = int(s.word_at[k]), int(s.word_at[k + 1] - s.word_at[k])
                drop = np.zeros(n + 1, np.int64)
                np.add.at(drop, [r["first"] for r in ranges], 1)
                np.add.at(drop, [r["last"] for r in ranges], -1)
                gone_ = np.cumsum(drop[:n]) > 0
                for x, y in _stretches(gone_):
                    gone_[x:y] = y - x >= WORDS
                if report:
                    lost[k], said[k] = _said(gone_, s.first[s.at[k] : s.at[k + 1]] - a)
                lo = np.append(s.word_lo[a : a + n], s.offsets[k + 1])
                column[k] = b"".join(s.data[lo[x] : lo[y]].tobytes() for x, y in _stretches(~gone_)).decode()
        column = pa.array(column, pa.string())
        if report:
            return pa.RecordBatch.from_arrays([batch.column(where), column, pa.array(np.diff(s.at)), pa.array(lost), pa.array(said)], [key, text, "n_sentences", "n_removed", "removed"])
        return pa.RecordBatch.from_arrays([column if k == at else batch.column(k) for k in range(len(names))], names)

    def chosen(hit: bool):  # noqa: ANN202
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids = batch.column(where)
            there = seen.has(ids.fill_null(0).cast(pa.int64()).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(there == hit))
            return batch if hit or not batch.num_rows else cut(batch, [None] * batch.num_rows) if report else batch

        return run

    still = map_arrow(df, chosen(False), out, text)
    touched = map_arrow(df, chosen(True), kinds, text)
    its, its_cuts = fresh(names, "id", "cuts")
    joined = touched.join(gone.select(F.col("id").alias(its), F.col("cuts").alias(its_cuts)), F.col(f"`{key}`").cast("long") == F.col(its), "left").select(*(f"`{c}`" for c in names), its_cuts)
    return still.union(map_arrow(joined, lambda b: cut(b, b.column(len(names)).to_pylist()), out, text))
