"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscan.sources.store import discard, save, shared_dir  # noqa: F401


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that are not among ``taken``, whatever their case."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


#: Most rows of an Arrow batch where the session leaves Spark's own number, so that a batch of texts stays small.
BATCH_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))


_STEADY: list[bool] = []


def steady() -> None:
    """Give freed arrays back to the system, so that a worker used again doesn't keep the peak of an earlier stage."""
    if not _STEADY:
        _STEADY.append(True)
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 2 << 20)  # arrays of 2 MB or more are mapped on their own
            libc.mallopt(-1, 8 << 20)  # and at most 8 MB stay free at the top of the heap


def settle() -> None:
    """At the end of a task: hand back what the allocators of Arrow and C hold free."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces_of(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most_bytes`` of ``text`` each; a longer single text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    long = sizes > most_bytes  # stands alone, whatever came before it
    new = (np.diff(group) != 0) | long[1:] | long[:-1]
    cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [batch.num_rows]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(lo, hi - lo)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, text: str | None = "text", most_bytes: int = 1 << 20) -> DataFrame:
    """Apply ``fn`` to the Arrow batches of ``df``, cut to ``most_bytes`` of ``text`` so that memory stays bounded."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for batch in batches:
            if batch.num_rows:
                for part in pieces_of(batch, text, most_bytes) if text else [batch]:
                    out = fn(part)
                    if out is not None and out.num_rows:
                        yield out
        settle()

    return df.mapInArrow(run, schema)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from batches that are sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
        cuts = np.flatnonzero(new)
        if len(cuts):  # rows from the last cut on may go on in the next batch
            done = [*held, batch.slice(0, int(cuts[-1]))]
            done = [b for b in done if b.num_rows]
            if done:
                yield pa.Table.from_batches(done)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Most values that are weighed by powers at a time, and so the size of the tables of powers.
_STRIDE = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd base modulo 2**64, and those of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _sum_of_long(values: Callable[[int, int], np.ndarray], lo: int, hi: int) -> np.uint64:
    total = 0
    for at in range(lo, hi, _STRIDE):
        part = values(at, min(at + _STRIDE, hi))
        total += int((part * _powers(len(part))[0][: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - lo, 1 << 64)
    return np.uint64(total % (1 << 64))


def _sums(values: Callable[[int, int], np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive sums of the ranges [start, end) of the 64-bit numbers that ``values`` gives for a stretch.

    At most ``_STRIDE`` numbers are held at a time, however long the ranges are.
    """
    out = np.zeros(len(starts), np.uint64)
    order = None if (starts[1:] >= starts[:-1]).all() else np.argsort(starts, kind="stable")
    a, z = (starts, ends) if order is None else (starts[order], ends[order])
    sums, k = np.zeros(len(a), np.uint64), 0
    while k < len(a):
        lo = int(a[k])
        stop = int(np.searchsorted(a, lo + _STRIDE // 2, side="left"))
        x, y = a[k:stop] - lo, z[k:stop] - lo
        short = y <= _STRIDE
        top = int(y[short].max(initial=0))
        if top:
            forth, back = _powers(top + 1)
            total = np.zeros(top + 1, np.uint64)
            np.cumsum(values(lo, lo + top) * forth[:top], out=total[1:])
            sums[k:stop][short] = (total[y[short]] - total[x[short]]) * back[x[short]]
        for i in np.flatnonzero(~short):
            sums[k + i] = _sum_of_long(values, int(a[k + i]), int(z[k + i]))
        k = stop
    if order is None:
        return sums
    out[order] = sums
    return out


def sums_of_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive sums of the ranges [start, end) of 64-bit values: equal values, equal sum."""
    return _sums(lambda lo, hi: values[lo:hi], starts, ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal bytes, equal hash."""
    return mix64(_sums(lambda lo, hi: _BYTE_CODES[data[lo:hi]], starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (id, component) per id that a link names.

    ``component`` is the smallest id reachable. Alternates large and small stars until nothing changes;
    each round is a written table, and no task holds the neighbours of a node.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*")
        return out.where("a != b").distinct()

    edges = save(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        old, edges = edges, save(star(star(edges, True), False), "star")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    out = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return out.union(roots)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the runs ``[^\\x20\\x09-\\x0D]+`` of concatenated texts."""
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inner = ~space
    starts = np.flatnonzero(inner & (first[:-1] | np.concatenate(([True], space[:-1]))))
    ends = np.flatnonzero(inner & (first[1:] | np.concatenate((space[1:], [True])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds within each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(mask, offsets[:-1][some], dtype=np.int64)
    return out


def distinct_per_text(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of ``n`` texts has."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


#: Most bits of an ``IdFilter`` (32 MB), whatever the number of ids.
FILTER_BITS = 1 << 28


class IdFilter:
    """A broadcast Bloom filter over the 64-bit ids in the one column of ``ids``.

    16 bits an id with two hashes, up to ``FILTER_BITS`` in all; beyond that the share of false hits grows. A false
    hit costs work only: whoever asks must drop it by a join.
    """

    def __init__(self, ids: DataFrame, most_bits: int = FILTER_BITS) -> None:
        bits = self.bits = min(most_bits, 1 << max(16, (16 * ids.count()).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(bits // 8, np.uint8)
            for b in batches:
                for h in _filter_places(b.column(0).to_numpy(), bits):
                    np.bitwise_or.at(out, h >> 3, (1 << (h & 7)).astype(np.uint8))
            full = out.view(np.int64)
            at = np.flatnonzero(full)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(full[at])], ["at", "word"])

        spark = ids.sparkSession
        parts = max(1, min(64, spark.sparkContext.defaultParallelism))
        out = np.zeros(bits // 64, np.int64)
        for r in ids.coalesce(parts).mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow().to_batches():
            out[r.column(0).to_numpy()] = r.column(1).to_numpy()
        self.sent = spark.sparkContext.broadcast(out.view(np.uint8))

    def destroy(self) -> None:
        """Free the executors' copies; a job that runs again sends them anew."""
        self.sent.unpersist()

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "sent": self.sent}

    def has(self, ids: np.ndarray) -> np.ndarray:
        there = np.ones(len(ids), bool)
        for h in _filter_places(ids, self.bits):
            there &= (self.sent.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
        return there


def _filter_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(x)) % np.uint64(bits)).astype(np.int64) for x in (1, 0x452821E638D01377)]
