"""Packing token sequences: cutting stock by column generation.

Documents are tokenised, closed with an end id and cut into pieces of at most ``capacity`` ids. The packing problem sees
only the histogram of piece lengths in steps of ``STEP`` (rounded up), whose size does not depend on the data. Its linear
program over patterns (how many pieces of each class fill one sequence) is solved by column generation: the simplex
method with an explicit basis inverse, in which a knapsack dynamic program over the dual prices finds the next
pattern. Pattern counts are rounded down, the few pieces left over are packed best-fit decreasing, and pieces take
the slots of their class by rank.

Defined results: a null or empty text is the end id alone; equal texts have equal ids; every id of every document lies in
exactly one piece; an empty table gives an empty result and no sequences; columns of the input other than the key
and the text are ignored, and so are null keys' values (such documents are packed like any other). Texts of any
length are read whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import fresh, map_arrow, range_hashes, utf8, words

CAPACITY, STEP, END = 2048, 16, 1
#: Rows that one task ranks, and words whose ids a worker remembers.
RANKED_ROWS = 200_000
REMEMBERED = 600_000


#: Kinds of bytes: white space 0, letter 1, digit 2, other printable character 3, and 4 for what makes a word go whole to the library.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b"'<")] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Second bytes of U+00C0 ... U+00FF, after the byte C3: letters but for two signs; NFC leaves them, and capitals are 32 below.
_ACCENTED = np.zeros(256, bool)
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False
_CAPITAL = _ACCENTED.copy()
_CAPITAL[0x9F:] = False
#: The tokenizer's characters for bytes, where they aren't the byte's own.
_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordEncoder:
    """Token ids of texts, unit by unit.

    White space never is part of a token of this tokenizer, so a text's ids are those of its words in order. A word of
    printable ASCII and letters of U+00C0 to U+00FF, without apostrophe or ``<``, falls into units, each of which the tokenizer's model
    encodes by itself: runs of letters, single digits, runs of other characters. Any other word is one unit and goes through the whole tokenizer. Ids of
    units that were met before come from a table by the unit's 64-bit hash; it is emptied when it is full.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.at, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _learn(self, hashes: list[int], units: list[bytes], plain: list[bool]) -> None:
        n = len(self.known)
        whole = iter(self.tokenizer.encode_batch_fast([u.decode() for u, p in zip(units, plain, strict=True) if not p], add_special_tokens=False))
        shown = lambda u: u.decode() if u.isascii() else u.decode("latin-1").translate(_CHARACTERS)
        found = [[t.id for t in self.model.tokenize(shown(u))] if p else next(whole).ids for u, p in zip(units, plain, strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(found) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[n + 1 : n + 1 + len(found)] = self.used + np.cumsum(size)
        self.used += len(flat)
        self.known.update(zip(hashes, range(n, n + len(found)), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``END``, and the n + 1 offsets of the texts."""
        data, offsets = utf8(column)
        starts, ends, text = words(data, offsets)
        kind, low = _KIND[data], _LOWER[data]
        second = np.flatnonzero(data == 0xC3) + 1  # texts are valid, so each has one
        second = second[_ACCENTED[data[second]]]
        kind[second - 1] = kind[second] = 1
        low[second] += _CAPITAL[data[second]] * np.uint8(32)
        odd = np.concatenate(([0], np.cumsum(kind == 4)))
        odd = odd[ends] > odd[starts]
        within = np.zeros(len(data) + 1, np.int8)  # +1 in words that are one unit
        within[starts[odd]] += 1
        within[ends[odd]] -= 1
        whole = np.cumsum(within[:-1], dtype=np.int8) > 0
        new = np.zeros(len(data), bool)
        new[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0) & ~whole[1:]
        new[starts] = True
        first_byte = np.flatnonzero(new)
        word = np.searchsorted(starts, first_byte, side="right") - 1
        last_byte = np.minimum(np.append(first_byte[1:], len(data))[: len(first_byte)], ends[word])
        starts, ends, text, odd = first_byte, last_byte, text[word], odd[word]
        data = np.where(whole, data, low)
        h, first, back = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = h.tolist()
        if len(self.known) > REMEMBERED:
            self._clear()
        entry = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw, at, n = data.tobytes(), first[new], len(self.known)
            self._learn(h[new].tolist(), [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], (~odd[at]).tolist())
            entry[new] = np.arange(n, n + len(new))
        entry = entry[back]
        size = self.at[entry + 1] - self.at[entry]
        n = len(offsets) - 1
        per = np.bincount(text, weights=size, minlength=n).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(per + 1)))
        out = np.full(int(at[-1]), END, np.uint32)
        to = np.cumsum(size) - size + text
        total = int(size.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + inner] = self.ids[np.repeat(self.at[entry], size) + inner]
        return out, at


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: Callable[[], str] | str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(key, start, length, ids, doc_tokens) for each piece; ``ids`` are little-endian unsigned 32-bit numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        ids, at = _ENCODERS[path].encode(batch.column(1))
        size = np.diff(at)
        n = -(-size // capacity)
        doc = np.repeat(np.arange(len(size)), n)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
        length = np.minimum(size[doc] - start, capacity)
        ends = np.concatenate(([0], np.cumsum(length))) * 4
        raw = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4", copy=False))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), raw, pa.array(size[doc])], [key, "start", "length", "ids", "doc_tokens"])

    return map_arrow(df.select(key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long", text)


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest value: how many of each class, any number of times, within ``room``; sizes rise."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for w, fit in enumerate(np.searchsorted(sizes, np.arange(room + 1), side="right").tolist()):
        if w and fit:
            worth = best[w - sizes[:fit]] + values[:fit]
            k = int(worth.argmax())
            if worth[k] > best[w - 1] + 1e-12:
                best[w], took[w] = worth[k], k
                continue
        best[w] = best[w - 1] if w else 0
    count, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            count[took[w]] += 1
            w -= sizes[took[w]]
    return float(best[room]), count


def _inverse(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots. The library's threaded routine was seen to hang in a driver process."""
    n = len(a)
    both = np.concatenate((a.astype(float), np.eye(n)), axis=1)
    for k in range(n):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in the linear program's solution.

    Ends within ``gap`` of the best dual bound, or after ``most`` columns with the solution so far, which is feasible.
    Demands are raised by under a hundredth of a piece each, by different amounts, so that the simplex method can't cycle.
    """
    m = len(sizes)
    demand = demand + 0.009 * (1 + np.arange(m)) / m
    bound = float(sizes @ demand) / room
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    for turn in range(most):
        duals = inverse.sum(axis=0)
        value, column = knapsack(duals, sizes, room)
        bound = max(bound, float(duals @ demand) / value)
        if value <= 1 + 1e-9 or x.sum() - bound <= gap * x.sum():
            break
        step = inverse @ column
        up = np.flatnonzero(step > 1e-11)
        out = int(up[(x[up] / step[up]).argmin()])
        t = max(0.0, x[out] / step[out])
        basis[:, out] = column
        x -= t * step
        x[out] = t
        inverse[out] /= step[out]
        step[out] = 0
        inverse -= np.outer(step, inverse[out])
        if turn % 100 == 99:
            inverse = _inverse(basis)
            x = inverse @ demand
    return basis.T.round().astype(np.int64), np.maximum(x, 0)


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of sequences that take every piece exactly once. Sizes and room in steps."""
    if not len(sizes):
        return []
    patterns, x = column_generation(sizes, demand.astype(float), room)
    out, left = [], demand.copy()
    for p, k in zip(patterns, np.floor(x).astype(np.int64), strict=True):
        k = int(min([k, *(left[c] // p[c] for c in np.flatnonzero(p))]))
        if k > 0:
            out.append((p, k))
            left = left - k * p
    while left.any():  # what rounding left: at most one sequence a pattern
        p, free = np.zeros(len(sizes), np.int64), room
        for c in np.argsort(-sizes, kind="stable"):
            n = min(int(left[c]), free // int(sizes[c]))
            p[c], free = n, free - n * int(sizes[c])
        k = int(min(left[c] // p[c] for c in np.flatnonzero(p)))
        out.append((p, k))
        left = left - k * p
    return out


def pack(rows: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset`` (with an underscore where a name is taken); ``length`` is from 1 to ``capacity``, ``order`` ranks equal lengths.

    Ranks are counted in two steps, within hash buckets and over the buckets' counts, so that no class of lengths
    is sorted in one task. The histogram that the driver sees has ``capacity / step`` rows at most.
    """
    spark = rows.sparkSession
    kclass, kbucket, kbefore, krank, kslot, kcount, kseq, koffset = fresh(rows.columns, "class", "bucket", "before", "rank", "slot", "count", "sequence_id", "offset")
    classed = rows.withColumn(kclass, F.ceil(F.col(length) / step).cast("int"))
    histogram = sorted((r[0], r[1]) for r in classed.groupBy(kclass).agg(F.count("*")).collect())
    sizes, demand = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    slots: dict[int, list[tuple[int, int, int]]] = {int(c): [] for c in sizes}
    base = 0
    for p, k in plan(sizes, demand, capacity // step):
        for c in np.flatnonzero(p):
            slots[int(sizes[c])].append((base, int(p[c]), k))
        base += k
    tables = {c: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for c, s in slots.items()}

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(demand.sum()) // RANKED_ROWS))
    dealt = classed.withColumn(kbucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = dealt.groupBy(kclass, kbucket).agg(F.count("*").alias(kcount)).withColumn(kbefore, F.sum(kcount).over(Window.partitionBy(kclass).orderBy(kbucket)) - F.col(kcount)).drop(kcount)
    ranked = dealt.withColumn(krank, F.row_number().over(Window.partitionBy(kclass, kbucket).orderBy(*order)) - 1).join(before, [kclass, kbucket])
    names = rows.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = batch.column(len(names)).to_numpy()
        rank = batch.column(len(names) + 1).to_numpy()
        seq, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for one in np.unique(c):
            first, each, times = tables[int(one)]
            pick = c == one
            ends = np.cumsum(each * times)
            k = np.searchsorted(ends, rank[pick], side="right")
            within = rank[pick] - (ends[k] - each[k] * times[k])
            seq[pick] = first[k] + within // each[k]
            slot[pick] = (capacity - int(one)) * capacity + within % each[k]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(seq), pa.array(slot)], [*names, kseq, kslot])

    fields = rows.select(*names, F.lit(0).cast("long").alias(kseq), F.lit(0).cast("long").alias(kslot)).schema
    placed = map_arrow(ranked.select(*names, kclass, (F.col(krank) + F.col(kbefore)).cast("long").alias(krank)), run, fields, None)
    ahead = Window.partitionBy(kseq).orderBy(kslot).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(koffset, F.coalesce(F.sum(length).over(ahead), F.lit(0)).cast("long")).drop(kslot)
