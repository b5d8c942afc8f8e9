"""Sampled subword segmentation: forward filtering, backward sampling over the piece lattice.

A space is the piece character U+2581; no piece has it after another character, so a text's lattice falls into units
(spaces and the run after them) that are independent. For every different unit forward filtering sums the weights of
all segmentations up to each character; backward sampling then draws a segmentation for each occurrence, piece by
piece from the end, in proportion to its weight. The random numbers come from the row's key and the place in its
text alone, so a row is segmented alike whatever batch or executor it is in.

A piece that is the r-th merge of the vocabulary weighs ``1 / (1 + r) ** theta``. A character without a piece, and a literal
U+2581, is spelled in byte pieces. Decoding joins the pieces and gives back the text byte by byte.

Defined results: a null text counts as empty and has no ids; rows with a null key use key 0, keys that are no whole numbers
a hash of their text; equal keys and texts get
equal ids; other columns are ignored; an empty table gives an empty result. Whole texts are read, and a unit of any length
is sampled exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_arrow, mix64, sums_of_ranges

THETA = 1.0
_SPACE, _LITERAL = 0x2581, 0x110000
#: Characters of units whose lattices are held at a time.
_HELD = 60_000


class Lattice:
    """Pieces of a vocabulary by the hash of their characters, with log weights."""

    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        plain = [k for k in plain if "▁" not in sp.id_to_piece(k).lstrip("▁")]
        ranks = {k: r for r, k in enumerate(sorted(plain, key=lambda k: (-sp.get_score(k), k)))}
        text = {k: sp.id_to_piece(k) for k in plain}
        self.longest = max(map(len, text.values()))
        cps = [np.frombuffer(text[k].encode("utf-32-le"), np.uint32) for k in plain]
        flat, size = np.concatenate(cps), np.array([len(c) for c in cps])
        ends = np.cumsum(size)
        h = self._hash(flat, ends - size, ends)
        order = np.argsort(h)
        self.index(h[order])
        self.ids = np.array(plain, np.int64)[order]
        self.weights = -theta * np.log1p(np.array([ranks[k] for k in plain], float))[order]
        self.byte_weight = -theta * np.log1p(n)
        self.byte_ids = np.zeros(256, np.int64)
        self.single = np.zeros(0x110001, bool)
        for k in plain:
            if len(text[k]) == 1:
                self.single[ord(text[k])] = True
        raw = [b""] * n
        for k in range(n):
            if sp.is_byte(k):
                b = int(sp.id_to_piece(k)[3:5], 16)
                self.byte_ids[b], raw[k] = k, bytes([b])
        for k in plain:
            raw[k] = text[k].replace("▁", " ").encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))

    @staticmethod
    def _hash(cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64(sums_of_ranges(mix64(cp.astype(np.uint64) + np.uint64(1)), lo, hi) + (hi - lo).astype(np.uint64))

    def _edges(self, cp: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For units of one length: weights and ids of the pieces of 1 … m characters that end at each character.

        The id of a character that is spelled in bytes is -1.
        """
        m = min(length, self.longest)
        weight, ids = np.full((len(lo), length, m), -np.inf), np.zeros((len(lo), length, m), np.int64)
        chars = mix64(cp[lo[:, None] + np.arange(length)].astype(np.uint64) + np.uint64(1))
        sums = np.zeros((len(lo), length), np.uint64)
        for size in range(1, m + 1):
            sums = sums[:, : length - size + 1] + chars[:, size - 1 :] * self._power(size - 1)
            h = mix64(sums.ravel() + np.uint64(size))
            some, k = self.find(h)
            row, column = np.divmod(some, length - size + 1)
            weight[row, column + size - 1, size - 1] = self.weights[k]
            ids[row, column + size - 1, size - 1] = self.ids[k]
            if size == 1:
                alone = ~self.single[cp[lo[:, None] + np.arange(length)]]
                weight[:, :, 0] = np.where(alone, self.byte_weight * 2, weight[:, :, 0])
                ids[:, :, 0] = np.where(alone, -1, ids[:, :, 0])
        return weight, ids

    def index(self, hashes: np.ndarray) -> None:
        """Make sorted hashes the table that ``find`` looks up."""
        self.hashes = hashes
        top = (hashes >> np.uint64(44)).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)  # most runs of characters are no piece and end here
        self.maybe[top] = True
        self.first = np.searchsorted(top, np.arange(1 << 20)).astype(np.int32)  # of the hashes that begin alike
        self.alike = int(np.bincount(top).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are in the table, and their places there; in no order."""
        top = (h >> np.uint64(44)).astype(np.int64)
        some = np.flatnonzero(self.maybe[top])
        place, found = self.first[top[some]], []
        for _ in range(self.alike):
            there = self.hashes[place] == h[some]
            found.append((some[there], place[there]))
            some, place = some[~there], np.minimum(place[~there] + 1, len(self.hashes) - 1)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    @staticmethod
    def _power(k: int) -> np.uint64:
        return np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))

    def sample(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one sampled segmentation of each text, and their n + 1 offsets."""
        size = np.array([len(t) if t else 0 for t in texts], np.int64)
        cp = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.zeros(len(cp) + 1, bool)
        begins = np.cumsum(size) - size
        first[begins] = True
        cp = np.where(cp == _SPACE, _LITERAL, np.where(cp == 32, _SPACE, cp))
        space = cp == _SPACE
        start = first[:-1].copy()
        start[1:] |= space[1:] & ~space[:-1]
        lo = np.flatnonzero(start)
        hi = np.append(lo[1:], len(cp))[: len(lo)]
        text = np.repeat(np.arange(len(size)), size)
        salt = mix64(mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
        noise = mix64(salt[text] + (np.arange(len(cp)) - begins[text]).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)
        noise = noise.astype(float) * 2.0**-53  # one number for each place at which a piece may end
        out = np.full(len(cp), -2, np.int64)
        h = self._hash(cp, lo, hi)
        occurrences = np.argsort(h, kind="stable")
        h = h[occurrences]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
        unit, ends = occurrences[heads], np.append(heads[1:], len(h))[: len(heads)]
        length = (hi - lo)[unit]
        by_length = np.argsort(length, kind="stable")
        k = 0
        while k < len(unit):
            n = int(length[by_length[k]])
            same = int(np.searchsorted(length[by_length], n, side="right"))
            stop = min(same, k + max(1, _HELD // n))
            pick = by_length[k:stop]
            self._draw(cp, lo, lo[unit[pick]], n, [occurrences[heads[u] : ends[u]] for u in pick], noise, out)
            k = stop
        return self._spelled(cp, out, text, len(texts))

    def _draw(self, cp: np.ndarray, starts: np.ndarray, lo: np.ndarray, n: int, places: list[np.ndarray], noise: np.ndarray, out: np.ndarray) -> None:
        weight, ids = self._edges(cp, lo, n)
        m = weight.shape[2]
        alpha = np.full((len(lo), n + 1), -np.inf)
        alpha[:, 0] = 0
        for i in range(1, n + 1):  # forward filtering
            w = min(i, m)
            paths = alpha[:, i - w : i][:, ::-1] + weight[:, i - 1, :w]
            top = paths.max(axis=1)
            weight[:, i - 1, :w] = np.exp(paths - top[:, None])
            weight[:, i - 1, w:] = 0
            total = weight[:, i - 1].sum(axis=1)
            alpha[:, i] = top + np.log(total)
            weight[:, i - 1] = np.cumsum(weight[:, i - 1], axis=1)
        who = np.repeat(np.arange(len(lo)), [len(p) for p in places])
        at = starts[np.concatenate(places)]
        pos = np.full(len(who), n)
        while len(who):  # backward sampling
            cum = weight[who, pos - 1]
            step = (cum <= (noise[at + pos - 1] * cum[:, -1])[:, None]).sum(axis=1)
            piece = ids[who, pos - 1, step]
            pos = pos - step - 1
            out[at + pos] = piece
            left = pos > 0
            who, at, pos = who[left], at[left], pos[left]

    def _spelled(self, cp: np.ndarray, out: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(out != -2)
        ids, who = out[begin], text[begin]
        odd = np.flatnonzero(ids == -1)
        if len(odd):
            raw = ["▁".encode() if c == _LITERAL else chr(c).encode() for c in cp[begin[odd]]]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(r) for r in raw]
            ids, who = np.repeat(ids, times), np.repeat(who, times)
            ids[ids == -1] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.concatenate(([0], np.cumsum(np.bincount(who, minlength=n))))

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        at = np.repeat(self.raw_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.raw[at].tobytes()


def key_numbers(keys: pa.Array) -> np.ndarray:
    """Keys as numbers: whole numbers as they are, null as 0, anything else by a hash of its text."""
    if pa.types.is_integer(keys.type):
        return keys.cast(pa.int64()).fill_null(0).to_numpy()
    return np.array([0 if k is None else int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little", signed=True) for k in keys.to_pylist()], np.int64)


_LATTICES: dict[tuple[str, float], Lattice] = {}


def lattice(path: str | None = None, theta: float = THETA) -> Lattice:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if (path, theta) not in _LATTICES:
        _LATTICES[path, theta] = Lattice(path, theta)
    return _LATTICES[path, theta]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, theta: float = THETA) -> DataFrame:
    """The key, the text and ``ids``: little-endian unsigned 32-bit numbers of a sampled segmentation."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = key_numbers(batch.column(0))
        ids, at = lattice(model, theta).sample(batch.column(1).to_pylist(), keys)
        raw = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], [key, text, "ids"])

    return map_arrow(df.select(key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, {text} string, ids binary", text, 1 << 20)


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", model: str | None = None, theta: float = THETA) -> DataFrame:
    """``df`` with the text of ``ids``; null ids give a null text."""
    schema = df.withColumn(to, F.lit(None).cast("string")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = lattice(model, theta)
        at = schema.names.index(ids)
        texts = [None if b is None else own.decode(np.frombuffer(b, "<u4").astype(np.int64)).decode() for b in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return map_arrow(df, run, schema, ids, 1 << 20)
