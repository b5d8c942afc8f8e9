"""Media columns: payloads in content-defined chunks.

A text's payload is its UTF-8 bytes, padded with spaces to a positive multiple of ``ROW`` bytes; its stored form is a grey image
of ``ROW`` samples a line (binary PGM: a header, then one 8-bit sample a byte). Stored forms are cut where a rolling gear hash of the
last 32 bytes says so, chunks are named by digest, and each different chunk is stored once: the store holds, for each
different medium, its ordered list of digests and the bytes of the chunks it owns. Reading joins the chunks that other media own,
puts the list in order, and checks the length and the digest of the whole before any feature is computed.

Only chunks that media share are shuffled as bytes: a filter of bounded size over the shared digests lets all other
chunks stay in the row, and a join drops its false hits.

Defined results: a null or empty text is one row of spaces; equal texts have equal stored forms and values; rows of the
same key are independent; a null key stays; other columns are ignored; an empty table gives an empty result. A read that
doesn't give the stored digest fails the query. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import IdFilter, map_arrow, mix64, pieces_of, save

ROW, LEAST, MOST, MASK_BITS = 192, 512, 8192, 10
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def stored_form(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def payload_in(stored: bytes) -> bytes:
    """The samples of a stored form."""
    kind, size, top, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a stored form")
    return samples


def cuts(stored: bytes) -> list[int]:
    """Ends of the chunks: after a byte where the gear hash has ``MASK_BITS`` zeros, ``LEAST`` to ``MOST`` bytes apart."""
    data = np.frombuffer(stored, np.uint8)
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # h[i]: sum of gear[data[i - j]] << j for j < 32
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k) if len(h) > k else 0
        h = h + shifted
    ends = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, last, n = [], 0, len(data)
    while n - last > LEAST:
        k = int(np.searchsorted(ends, last + LEAST))
        end = int(ends[k]) if k < len(ends) else n
        end = min(end, last + MOST, n)
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _media(texts: list[str | None]) -> Iterator[tuple[bytes, bytes, list[int], list[bytes]]]:
    """Name, stored form, ends of its chunks and their digests, for each text."""
    for t in texts:
        stored = stored_form(payload_of(t))
        ends = cuts(stored)
        yield hashlib.sha256(stored).digest(), stored, ends, [_digest(stored[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def recipes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, medium, digests): what is stored for each row, without the bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        media = list(_media(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([m[0] for m in media], pa.binary()), pa.array([list(dict.fromkeys(m[3])) for m in media], pa.list_(pa.binary()))], [key, "n_bytes", "medium", "digests"])

    return map_arrow(df.select(key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, medium binary, digests array<binary>", text)


def _numbers(digests: list[bytes]) -> np.ndarray:
    """The first 8 bytes of each digest, as ``_number`` has them."""
    return np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)


def _number(digest: str) -> F.Column:
    number = F.conv(F.hex(F.substring(F.col(digest), 1, 8)), 16, -10)
    return number.cast("long")


_WRITTEN = "medium binary, size long, digests array<binary>, ends array<long>, away array<boolean>, bytes binary, task int"


def write(df: DataFrame, known: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Store the media of ``df``, whose ``recipes`` are ``known``: (media, shared).

    A row of ``media`` is a medium's list, with the bytes of the chunks that no other row has; ``shared`` has each other chunk once.
    Both are written to the shared folder.
    """
    several = known.select("medium", F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    seen = IdFilter(save(several.select(_number("digest").alias("number")), "several"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces_of(batch, text, 2 << 20) if batch.num_rows else ():
                rows = []
                for medium, stored, ends, names in _media(part.column(0).to_pylist()):
                    if medium not in met:
                        met.add(medium)
                        chunks = [stored[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                        away = seen.has(_numbers(names)).tolist()
                        rows.append((medium, len(stored), names, ends, away, b"".join(c for c, x in zip(chunks, away, strict=True) if not x), task))
                        for digest, body in {n: c for c, n, x in zip(chunks, names, away, strict=True) if x and n not in met}.items():
                            met.add(digest)
                            rows.append((medium, len(body), [digest], None, None, body, task))
                if rows:
                    kinds = (pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["medium", "size", "digests", "ends", "away", "bytes", "task"])

    written = save(df.select(text).mapInArrow(run, _WRITTEN), "media", compression="zstd")
    chunks = written.where("ends is null").select(F.col("digests")[0].alias("digest"), F.struct("medium", "task").alias("place"), "bytes")
    owners = chunks.groupBy("digest").agg(F.min("place").alias("place"))
    return written.where("ends is not null"), save(chunks.join(owners, ["digest", "place"]).select("digest", "bytes"), "shared", compression="zstd")


def feature(payload: bytes) -> str:
    """Lines, mean and deviation of the samples in thousandths, and the share of each quarter of the values in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    quarters = np.bincount(x >> 6, minlength=4) * 1000 // len(x)
    return f"{len(x) // ROW};{int(x.sum(dtype=np.int64) * 1000 // len(x))};{int(round(float(x.std()) * 1000))};" + ",".join(map(str, quarters))


def _features(medium: bytes, stored: bytes) -> tuple:
    if hashlib.sha256(stored).digest() != medium:
        raise ValueError(f"the chunks of {medium.hex()} don't give its stored form")
    payload = payload_in(stored)
    return medium, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), medium.hex(), feature(payload)


_READ = "medium binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(media: DataFrame, shared: DataFrame) -> DataFrame:
    """Each different medium read back from its chunks, verified, with its features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            ends, own, parts = row["ends"], row["bytes"], []
            there = {x["digest"]: x["bytes"] for x in row["found"] or ()}
            at = 0
            for lo, hi, name, away in zip([0, *ends[:-1]], ends, row["digests"], row["away"], strict=True):
                if away:
                    parts.append(there[name])
                else:
                    parts.append(own[at : at + hi - lo])
                    at += hi - lo
            out.append(_features(row["medium"], b"".join(parts)))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _READ.replace(" long", "").replace(" string", "").replace(" binary", "").split(", "))

    some = F.exists("away", lambda x: x)
    lists = media.where(some).groupBy("medium").agg(*(F.first(c).alias(c) for c in ("digests", "ends", "away", "bytes")))
    refs = media.where(some).select("medium", F.explode(F.array_distinct(F.transform(F.filter(F.arrays_zip("digests", "away"), lambda x: x["away"]), lambda x: x["digests"]))).alias("digest")).distinct()
    found = refs.join(shared, "digest").groupBy("medium").agg(F.collect_list(F.struct("digest", "bytes")).alias("found"))
    near = media.where(~some).select("medium", "digests", "ends", "away", "bytes", F.lit(None).cast("array<struct<digest:binary,bytes:binary>>").alias("found"))
    return map_arrow(near, run, _READ, "bytes").union(map_arrow(lists.join(found, "medium"), run, _READ, "bytes"))


def columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``df`` its size and what was read back from its stored medium."""
    known = save(recipes(df, key, text), "recipes")
    values = save(read(*write(df, known, text)).dropDuplicates(["medium"]), "read")
    return known.select(key, "n_bytes", "medium").join(values, "medium").drop("medium")
