"""From positioned text segments to lines, blocks and typed nodes.

Line grouping compares with the line so far, and the mode of a document (body, abstract, bibliography) feeds back into
what a block is: both are folds. Rows are dealt by document and sorted, and pass through Python in Arrow batches; what is
held is one page, and of a document only its mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import scalars as S

# Overlap that makes one line, word gap and paragraph gap in heights, heading size, margin band.
LINE_OVERLAP, SPACE_GAP, PARAGRAPH_GAP, HEADING_SIZE, MARGIN = 0.4, 0.2, 1.6, 1.15, 0.1


def _page_lines(segments: list[tuple]) -> list[dict]:
    """Consecutive segments (x, y, w, h, text) are one line while they overlap its hull enough in height."""
    out: list[dict] = []
    for x, y, w, h, text in segments:
        if not text.strip():
            continue
        line = out[-1] if out else None
        if line is not None:
            shared = min(line["y"] + line["h"], y + h) - max(line["y"], y)
            if shared >= LINE_OVERLAP * min(line["h"], h):
                gap = x - (line["x"] + line["w"])
                line["text"] += (" " if gap > SPACE_GAP * h and not line["text"].endswith(" ") else "") + text
                left, low = min(line["x"], x), min(line["y"], y)
                line["w"], line["h"] = max(line["x"] + line["w"], x + w) - left, max(line["y"] + line["h"], y + h) - low
                line["x"], line["y"] = left, low
                continue
        out.append({"x": x, "y": y, "w": w, "h": h, "text": text})
    return out


def _page_blocks(lines: list[dict]) -> list[list[dict]]:
    """Lines split where the gap below one is negative, or large against the median of the positive gaps."""
    gaps = [a["y"] - (b["y"] + b["h"]) for a, b in zip(lines, lines[1:], strict=False)]
    usual = median([g for g in gaps if g > 0] or [0])
    out: list[list[dict]] = []
    for k, line in enumerate(lines):
        if not k or gaps[k - 1] < 0 or (usual > 0 and gaps[k - 1] > PARAGRAPH_GAP * usual):
            out.append([])
        out[-1].append(line)
    return out


_BLOCKS = "document long, page int, ordinal int, text string, first string, lines int, words int, height double, page_height double, x double, y double, w double, h double, in_margin boolean"


def _page_rows(document: int, page: int, first: int, segments: list[tuple], top: float) -> list[tuple]:
    lines = _page_lines(segments)
    usual, out = median([x["h"] for x in lines] or [0]), []
    for ls in _page_blocks(lines):
        x, y = min(l["x"] for l in ls), min(l["y"] for l in ls)
        w, h = max(l["x"] + l["w"] for l in ls) - x, max(l["y"] + l["h"] for l in ls) - y
        text = " ".join(l["text"].strip() for l in ls)
        words = len(text.split())
        margin = len(ls) == 1 and words <= 8 and not MARGIN * top <= y + h / 2 <= (1 - MARGIN) * top
        out.append((document, page, first + len(out), text, ls[0]["text"].strip(), len(ls), words, float(median(l["h"] for l in ls)), float(usual), x, y, w, h, margin))
    return out


def _types(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _batches(rows: Iterator[tuple], schema: str, most: int = 4000) -> Iterator[pa.RecordBatch]:
    types, held = _types(schema), []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.types, strict=True)], schema=types)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.types, strict=True)], schema=types)


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("document").sortWithinPartitions("document", *order)


def blocks(segments: DataFrame) -> DataFrame:
    """Blocks of (document, page, reading_order, x, y, w, h, text, page_h) segments, in order; y grows upwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, held, top, number = None, [], 0.0, 0
            for b in batches:
                for document, page, x, y, w, h, text, page_h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (document, page) != at:
                        if at is not None:
                            done = _page_rows(*at, number, held, top)
                            number = number + len(done) if at[0] == document else 0
                            yield from done
                        at, held, top = (document, page), [], float(page_h)
                    held.append((x, y, w, h, text))
            if at is not None:
                yield from _page_rows(*at, number, held, top)

        return _batches(rows(), _BLOCKS)

    wanted = _sorted(segments, "page", "reading_order").select("document", "page", "x", "y", "w", "h", F.coalesce("text", F.lit("")).alias("text"), "page_h")
    return wanted.mapInArrow(run, _BLOCKS)


def detect(rows: DataFrame) -> DataFrame:
    """``rows`` (blocks) with what their first line could be; no fold is needed for this."""
    first, text = F.col("first"), F.col("text")
    return rows.select("*", S.caption_kind(first).alias("caption"), S.caption_number(first).alias("caption_number"), S.theorem_kind(first).alias("theorem"), S.theorem_number(first).alias("theorem_number"), S.display_math(text, F.col("lines")).alias("math"), S.equation_label(text).alias("equation_label"), S.section_number(first).alias("section"), S.section_level(first).alias("level"), S.heading_keyword(first).alias("keyword"), S.alpha_ratio(first).alias("alpha"))


_NODES = "document long, page int, ordinal int, kind string, confidence double, level int, number string, text string"


def _kind(b: dict, mode: str) -> tuple[str, float, int | None, str | None, str]:
    """Kind, confidence, level, number and the mode from here on."""
    if b["caption"]:
        return b["caption"], 0.75, None, b["caption_number"], mode
    if b["theorem"]:
        return b["theorem"], 0.7 if b["theorem_number"] else 0.6, None, b["theorem_number"], mode
    if b["math"] is not None:
        return "display_math", b["math"], None, b["equation_label"], mode
    if mode != "bibliography" and b["section"] and b["words"] <= 14 and b["lines"] <= 2:
        return ("subsection" if b["level"] >= 2 else "section"), 0.75, b["level"], b["section"], "body"
    if b["keyword"] and b["words"] <= 6 and b["lines"] <= 2:
        opened = "abstract" if b["keyword"] == "abstract" else "bibliography" if b["keyword"] in ("references", "bibliography") else "body"
        return "heading", 0.7, 1, None, opened
    if mode != "bibliography" and b["lines"] == 1 and b["words"] <= 8 and b["alpha"] >= 0.6 and b["page_height"] > 0 and b["height"] > HEADING_SIZE * b["page_height"]:
        return "heading", 0.55, None, None, mode
    if b["in_margin"]:
        return "unknown", 0.3, None, None, mode
    return *{"abstract": ("abstract", 0.7), "bibliography": ("bibliography_entry", 0.5)}.get(mode, ("paragraph", 0.6)), None, None, mode


def _typed(rows: DataFrame) -> DataFrame:
    """Typed nodes of blocks that come in order, each document's together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            document, mode = None, "body"
            for batch in batches:
                for b in batch.to_pylist():
                    if b["document"] != document:
                        document, mode = b["document"], "body"
                    kind, confidence, level, number, mode = _kind(b, mode)
                    yield document, b["page"], b["ordinal"], kind, confidence, level, number, b["text"]

        return _batches(rows(), _NODES)

    wanted = ["document", "page", "ordinal", "text", "lines", "words", "height", "page_height", "in_margin", "caption", "caption_number", "theorem", "theorem_number", "math", "equation_label", "section", "level", "keyword", "alpha"]
    return rows.select(*wanted).mapInArrow(run, _NODES)


def classify(rows: DataFrame) -> DataFrame:
    """Typed nodes: caption, theorem, display math, heading, then what the document's mode says."""
    return _typed(_sorted(rows, "ordinal"))


def nodes(segments: DataFrame) -> DataFrame:
    """Typed nodes of segments; blocks leave in order, so nothing is dealt a second time."""
    return _typed(detect(blocks(segments)))
