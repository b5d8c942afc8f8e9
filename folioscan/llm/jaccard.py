"""Exact set-similarity join on word shingles, by signature trees.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct shingles.

1. ``sketch`` reads every text once: size, 128-bit fingerprint of the set and routing keys. Equal fingerprints are one
   class, which goes on as one set. Copies within a task name the first of them, so no join meets a hot class.
2. Routing keys bring together whatever can link. Sizes fall into bands; a set's hashes are dealt to ``m`` buckets,
   where linked sets of the band differ in fewer than ``m`` hashes, so at least one bucket that is not empty has the
   same hashes in both: the key is the hash of a bucket's content. No link is lost by it (see ``_routes``).
3. A set belongs to the hub of each of its routing keys, the smallest class that has the key. All keys with the same
   hub make one group, so a cluster that shares a hundred keys is a few groups, not a hundred. Two sets that share a
   key share that key's hub: any linked pair is in some group together.
4. The sets of a group are leaves of a signature tree; a node holds the OR of the bitmaps below it and their size
   range. Pairs of nodes are traversed from the leaves' parents up to the root. Where the largest possible overlap
   can't reach the threshold, or all leaves below are one component already, a pair of nodes is pruned; of the others
   first the most promising leaf pair is followed down, then all that are left. Surviving leaf pairs are verified
   at once on the full sets, and each link found prunes what comes after. All links come from this traversal.
5. A group beyond ``BLOCK`` sets (or ``BLOCK_TOKENS`` hashes) is cut into blocks, each a task with a tree of its own. Its
   blocks are then cut anew by component and size; the roots of the new trees are traversed against each other, and
   only the sets of block pairs that survive are sent on. Blocks of one component are sent nowhere.

Links between sets that a known path joins aren't verified: a result by component loses nothing.

Defined results: texts are lower-cased for A-Z only; a null text, or one without words, has size 0, is its own
component and links with nothing; with fewer words than a shingle the whole sequence is the one shingle; other
columns of the input are ignored, whatever their names; an empty table gives an empty result. Every row gives a row:
a component is named by its smallest key that is not null, a row with a null key takes part like any other (its component is
null if no linked row has a key), and rows of one key but different texts are separate rows with components of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import IdFilter, components, discard, fresh, map_arrow, mix64, pieces_of, range_hashes, runs_of, save, settle, small_batches, steady, utf8, words

#: Most sets, and most hashes in them, that one task compares with each other.
BLOCK, BLOCK_TOKENS = 2048, 4_000_000
#: Children of a node of a signature tree.
FANOUT = 8
#: Routing rows, and hashes of sets, for each partition that groups them.
ROUTES_A_PARTITION, TOKENS_A_PARTITION = 1_500_000, 4_000_000
#: Bits of the bitmap of a block's root.
ROOT_BITS = 1 << 15
_SALTS = 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, and the n + 1 offsets of each text's set."""
    data, offsets = utf8(column)
    data, n = _LOWER[data], len(offsets) - 1
    starts, ends, text = words(data, offsets)
    h = range_hashes(data, starts, ends)
    count = np.bincount(text, minlength=n)
    sums = np.zeros(len(h), np.uint64)
    if len(h) >= k:
        sums[: len(h) - k + 1] = sum(h[i : len(h) - k + 1 + i] * _MULTIPLIERS[i] for i in range(k))
    place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    left = np.repeat(count, count) - place
    whole = left >= k
    firsts = np.cumsum(count) - count
    for t in np.flatnonzero((count > 0) & (count < k)):
        at, c = int(firsts[t]), int(count[t])
        sums[at] = (h[at : at + c] * _MULTIPLIERS[32 : 32 + c]).sum(dtype=np.uint64) + np.uint64(c)
        whole[at] = True
    s, t = mix64(sums[whole]), text[whole]
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    s, t = s[new], t[new]
    return s, np.concatenate(([0], np.cumsum(np.bincount(t, minlength=n))))


def most_apart(a: int, b: int, percent: int) -> int:
    """The most hashes in which sets of sizes up to ``a`` and ``b`` that link can differ."""
    return ((100 - percent) * (a + b)) // (100 + percent)


def _buckets(n: int, differ: int) -> int:
    """The fewest buckets of which ``n`` hashes fill more than ``differ``, with three deviations to spare."""
    m = differ + 2
    while True:
        empty = math.exp(-n / m)
        filled, deviation = m * (1 - empty), math.sqrt(m * empty * max(0.0, 1 - (1 + n / m) * empty))
        if filled - 3 * deviation > differ + 0.5 or m > 4 * n + 64:
            return m
        m += max(1, m // 50)


@cache
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(first size, last size, last size that also joins from above, buckets), ever larger. Sizes 1 … 2**40."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo, int(lo * 1.25))
        reach = hi * 100 // percent
        d = most_apart(hi, reach, percent)
        out.append((lo, hi, reach, 0 if d == 0 else _buckets(lo, d) if lo < 1 << 24 else d + max(4, d // 8)))
        lo = hi + 1
    return out


def _routes(s: np.ndarray, band: int, buckets: int, differ: int) -> np.ndarray:
    """Routing keys of one set within a band.

    ``differ`` bounds the hashes, and so the buckets, in which linked sets differ. A set with more than ``differ``
    buckets that are not empty therefore shares the content of one of them with whatever it links to. A set with
    fewer adds the keys of further deals of its hashes until one has enough, else a key for the whole band: of two
    linked sets either one stops first, and the other has all keys of that deal too, or both have the band's key.
    """
    out = []
    for salt in range(_SALTS):
        b = (mix64(s + np.uint64((band * _SALTS + salt + 1) * 0x632BE59BD9B4E019 % (1 << 64))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        b = b[order]
        at = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1))
        content = np.add.reduceat(mix64(s[order] ^ np.uint64(0x9FB21C651E98DF25)), at)
        out.append(mix64(content + (b[at] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band * 64 + salt)))
        if len(at) > differ:
            return np.concatenate(out)
    return np.concatenate([*out, mix64(np.array([band], np.uint64) + np.uint64(0x8CB92BA72F3D8DD7))])


def routes(s: np.ndarray, percent: int) -> np.ndarray:
    """All routing keys of a set of sorted hashes."""
    out, n = [], len(s)
    for k, (lo, hi, reach, buckets) in enumerate(bands(percent)):
        if lo > n:
            break
        if n <= reach and buckets:
            out.append(_routes(s, k, buckets, most_apart(hi, reach, percent)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap for a set of ``n``: eight to sixteen for each element, a power of two from 128 to 32768."""
    return 1 << min(15, max(7, (8 * n).bit_length()))


def bitmaps(tokens: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The sets' tokens as bitmaps of equal length, rows of 64-bit words; set i is tokens[at[i] : at[i + 1]]."""
    n = len(at) - 1
    out = np.zeros((n, bits // 64), np.uint64)
    step = max(1, (1 << 22) // bits)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        mask = np.zeros((hi - lo) * bits, bool)
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])) * bits
        mask[row + (tokens[at[lo] : at[hi]] % np.uint64(bits)).astype(np.int64)] = True
        out[lo:hi] = np.packbits(mask, bitorder="little").view(np.uint64).reshape(hi - lo, -1)
    return out


def _fingerprints(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(x))))) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
    f, g = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
    return f, g


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, t): ``t`` is a hash of the text; a row is known again by its key and ``t``."""
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("t", F.xxhash64("text"))


def sketch(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """For each row: id, t, its number ``uid``, set size, fingerprint (f, g), the first row of the task with the same set, routing keys.

    Only the first has routing keys, so that a large group of copies is as many routing rows as there are tasks.
    """
    rows = _rows(df, key, text).withColumn("uid", F.monotonically_increasing_id())
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20) if batch.num_rows else ():
                s, at = shingle_sets(part.column(1), k)
                f, g = _fingerprints(s, at)
                uid = part.column(3).to_numpy()
                first, keys = uid.copy(), []
                for i in range(part.num_rows):
                    own = int(uid[i])
                    if at[i + 1] > at[i]:
                        first[i] = seen.setdefault((int(f[i]), int(g[i])), own)
                    keys.append(routes(s[at[i] : at[i + 1]], percent).view(np.int64) if at[i + 1] > at[i] and first[i] == own else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(at)), pa.array(f), pa.array(g), pa.array(first), pa.array(keys, pa.list_(pa.int64()))], ["id", "t", "uid", "n", "f", "g", "first", "routes"])
        settle()

    return rows.mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, t long, uid long, n long, f long, g long, first long, routes array<long>")


def _hubs(routed: DataFrame, partitions: int) -> DataFrame:
    """(uid, hub) for each row (route, uid) that isn't alone with its route: the hub is the smallest uid there.

    The rows come sorted, so a route of any number of rows passes through in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        last_route, hub = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            route, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(route), bool)
            new[1:] = route[1:] != route[:-1]
            new[0] = last_route is None or route[0] != last_route
            at = np.flatnonzero(new)
            hubs = np.concatenate(([hub], uid[at]))[np.cumsum(new)]
            last_route, hub = route[-1], hubs[-1]
            pairs = np.column_stack((uid, hubs))[uid != hubs]
            if len(pairs):
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["uid", "hub"])
        settle()

    return routed.repartition(partitions, "route").sortWithinPartitions("route", "uid").mapInArrow(run, "uid long, hub long").distinct()


def _sets(df: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(rep, n, tokens) of the classes in ``wanted`` (rep, n, f, g, x): a filter of bounded size picks rows, a join drops its false hits."""
    seen = IdFilter(wanted.select("x"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        there = seen.has(batch.column(1).to_numpy())
        if not there.any():
            return None
        batch = batch.filter(pa.array(there))
        parts = []
        for part in pieces_of(batch, "text", 1 << 20):
            s, at = shingle_sets(part.column(0), k)
            f, g = _fingerprints(s, at)
            tokens = pa.Array.from_buffers(pa.large_binary(), len(f), [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(s)]).cast(pa.binary())
            parts.append(pa.RecordBatch.from_arrays([part.column(1), pa.array(f), pa.array(g), tokens], ["x", "f", "g", "tokens"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    rows = _rows(df, key, text).select("text", F.xxhash64("id", "t").alias("x"))
    found = map_arrow(rows, run, "x long, f long, g long, tokens binary", "text", 4 << 20).join(wanted, ["x", "f", "g"])
    return found.dropDuplicates(["rep"]).select("rep", "n", "tokens")


class SignatureTree:
    """Leaves are sets, ordered by side, component and size.

    A node has the OR of the bitmaps below it, their size range, and the most elements that share a bit with another
    one of their set. Leaves may be trees themselves, with a size range each.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, hidden: np.ndarray, maps: np.ndarray, comp: np.ndarray, side: np.ndarray) -> None:
        self.order = np.lexsort((lo, comp, side))
        maps, lo, hi, hidden = maps[self.order], lo[self.order], hi[self.order], hidden[self.order]
        self.levels = [(maps, lo, hi, hidden)]
        while len(lo) > 1:
            at = np.arange(0, len(lo), FANOUT)
            maps, lo, hi, hidden = np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hidden, at)
            self.levels.append((maps, lo, hi, hidden))
        self.side = self.ranges(side[self.order])

    @staticmethod
    def ranges(label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the least and the greatest label below each node; ``label`` is in the order of the leaves."""
        lo = hi = label
        out = [(lo, hi)]
        while len(lo) > 1:
            at = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            out.append((lo, hi))
        return out

    def alive(self, pairs: np.ndarray, level: int, percent: int, comp: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pairs of nodes of a level below which a link of two components may be, and how near each comes.

        An overlap is at most the smaller of the largest sizes, and at most the bits that both ORs have plus the
        elements that share a bit with another one.
        """
        maps, lo, hi, hidden = self.levels[level]
        out, scores = [], []
        for part in np.array_split(np.arange(len(pairs)), len(pairs) * maps.shape[1] // (1 << 20) + 1):
            i, j = pairs[part, 0], pairs[part, 1]
            good = np.minimum(hi[i], hi[j]) * 100 >= percent * np.maximum(lo[i], lo[j])
            for a, z in (comp[level], self.side[level]):
                good &= ~((a[i] == z[i]) & (a[j] == z[j]) & (a[i] == a[j]))
            part, i, j = part[good], i[good], j[good]
            shared = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64)
            most = np.minimum(np.minimum(hi[i], hi[j]), shared + np.minimum(hidden[i], hidden[j]))
            need = np.maximum(-(-(percent * (lo[i] + lo[j])) // (100 + percent)), 1)
            good = most >= need
            out.append(part[good])
            scores.append((shared / need)[good])
        return np.concatenate(out), np.concatenate(scores)

    def children(self, pairs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children at ``level`` of pairs one level up, each once, and which of ``pairs`` each is from."""
        n, each = len(self.levels[level][1]), FANOUT * FANOUT
        i = np.repeat(pairs[:, 0] * FANOUT, each) + np.tile(np.repeat(np.arange(FANOUT), FANOUT), len(pairs))
        j = np.repeat(pairs[:, 1] * FANOUT, each) + np.tile(np.tile(np.arange(FANOUT), FANOUT), len(pairs))
        good = (i < n) & (j < n) & ((i < j) if level == 0 else (i <= j))
        return np.column_stack((i[good], j[good])), np.repeat(np.arange(len(pairs)), each)[good]

    def descend(self, pairs: np.ndarray, level: int, percent: int, label: np.ndarray, nearest: bool = False) -> np.ndarray:
        """Leaf pairs below pairs of different nodes of a level that may link and differ in label, the nearest first.

        All of them, or, ``nearest``, one for each of ``pairs``: the one that the nearest children lead to.
        """
        comp = self.ranges(label)
        keep, score = self.alive(pairs, level, percent, comp)
        pairs = pairs[keep]
        while level > 0 and len(pairs):
            level -= 1
            parts, scores = [], []
            for k in range(0, len(pairs), 4096):
                below, above = self.children(pairs[k : k + 4096], level)
                keep, near = self.alive(below, level, percent, comp)
                if nearest:
                    order = np.lexsort((-near, above[keep]))
                    keep, near = keep[order], near[order]
                    first = np.flatnonzero(np.diff(above[keep], prepend=-1))
                    keep, near = keep[first], near[first]
                parts.append(below[keep])
                scores.append(near)
            pairs, score = np.concatenate(parts), np.concatenate(scores)
        return pairs[np.argsort(-score, kind="stable")]


def tree_links(sizes: np.ndarray, maps: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int, verify: Callable[[int, int], bool]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join all sets whose links lead to each other, found by dual traversal, and the components then.

    ``comp``: sets that are known to be joined; ``side``: only sets of different sides are compared. ``verify`` says
    whether two sets link.
    """
    tree = SignatureTree(sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), maps, comp, side)
    label, found = comp[tree.order], []

    def close(pairs: np.ndarray) -> None:
        for k in range(0, len(pairs), 4096):
            part = pairs[k : k + 4096]
            part = part[label[part[:, 0]] != label[part[:, 1]]]
            for a, b in part.tolist():
                x, y = label[a], label[b]
                if x != y and verify(int(tree.order[a]), int(tree.order[b])):
                    label[label == max(x, y)] = min(x, y)
                    found.append((int(tree.order[a]), int(tree.order[b])))

    i, j = np.triu_indices(FANOUT, 1)
    for level in range(len(tree.levels) - 1):
        n = len(tree.levels[level][1])
        base = np.arange(0, n, FANOUT)
        siblings = np.column_stack(((base[:, None] + i).ravel(), (base[:, None] + j).ravel()))
        siblings = siblings[siblings[:, 1] < n]
        if level:
            close(tree.descend(siblings, level, percent, label, nearest=True))
        close(tree.descend(siblings, level, percent, label))
    out = np.empty_like(label)
    out[tree.order] = label
    return found, out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes link."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


_ROOT = "hub long, block long, lo long, hi long, hidden long, c_lo long, c_hi long, bitmap binary"


def _trees(dealt: DataFrame, sets: DataFrame, percent: int, roots: bool) -> DataFrame:
    """Links (a, b) in the tasks (hub, i, j) of ``dealt`` (hub, i, j, own, rep, comp); sets of different ``own`` are compared if i and j differ.

    ``roots``: also the root of each task's tree, as a row with a hub.
    """
    spark = dealt.sparkSession
    rows = dealt.join(sets, "rep").select("hub", "i", "j", "own", "rep", "comp", "n", "tokens")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(dealt.agg(F.sum("w")).first()[0] or 0) // TOKENS_A_PARTITION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for t in runs_of(batches, ["hub", "i", "j"]):
            hub, i, j, own, rep, comp, n = (t.column(c).to_numpy() for c in ("hub", "i", "j", "own", "rep", "comp", "n"))
            raw = t.column("tokens").combine_chunks()
            raw = raw if isinstance(raw, pa.Array) else raw.chunk(0)
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // 8
            tokens = np.frombuffer(raw.buffers()[2], np.uint64, count=int(at[-1]))
            new = (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cut = np.concatenate(([0], np.flatnonzero(new) + 1, [len(hub)]))
            a, b, tops = [], [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                m = hi - lo
                if m < 2 and not roots:
                    continue
                bits = min(bitmap_bits(int(n[lo:hi].max())), 1 << max(7, ((1 << 28) // m).bit_length() - 1))
                own_at = at[lo : hi + 1]
                maps = bitmaps(tokens[own_at[0] : own_at[-1]], own_at - own_at[0], bits)
                side = own[lo:hi] if i[lo] != j[lo] else np.arange(m)
                verify = lambda x, y, s=own_at: linked(tokens[s[x] : s[x + 1]], tokens[s[y] : s[y + 1]], percent)
                found, label = tree_links(n[lo:hi], maps, comp[lo:hi].copy(), side, percent, verify)
                for x, y in found:
                    a.append(int(rep[lo + x]))
                    b.append(int(rep[lo + y]))
                if roots:
                    mask = np.zeros(ROOT_BITS, bool)
                    top, hidden = tokens[own_at[0] : own_at[-1]] % np.uint64(ROOT_BITS), 0
                    mask[top.astype(np.int64)] = True
                    for x in range(m):
                        hidden = max(hidden, int(n[lo + x]) - len(np.unique(top[own_at[x] - own_at[0] : own_at[x + 1] - own_at[0]])))
                    tops.append((int(hub[lo]), int(i[lo]), int(n[lo:hi].min()), int(n[lo:hi].max()), hidden, int(label.min()), int(label.max()), np.packbits(mask, bitorder="little").tobytes()))
            if a or tops:
                columns = list(zip(*tops, strict=True)) if tops else [[]] * 8
                pad = [None] * len(a)
                kinds = [pa.int64()] * 7 + [pa.binary()]
                none = [None] * len(tops)
                yield pa.RecordBatch.from_arrays([pa.array([*a, *none], pa.int64()), pa.array([*b, *none], pa.int64()), *(pa.array([*pad, *c], k) for c, k in zip(columns, kinds, strict=True))], ["a", "b", *(f.split()[0] for f in _ROOT.split(", "))])
        settle()

    return rows.repartition(partitions, "hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(run, "a long, b long, " + _ROOT)


def _block_pairs(roots: DataFrame, percent: int) -> DataFrame:
    """(hub, i, j): the pairs of blocks of a hub whose roots may have a link below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["hub"]):
            hub, block, lo, hi, hidden, c_lo, c_hi = (t.column(c).to_numpy() for c in ("hub", "block", "lo", "hi", "hidden", "c_lo", "c_hi"))
            cut = np.concatenate(([0], np.flatnonzero(hub[1:] != hub[:-1]) + 1, [len(hub)]))
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                maps = np.stack([np.frombuffer(m, np.uint64) for m in t.column("bitmap").slice(x, y - x).to_pylist()])
                one = c_lo[x:y] == c_hi[x:y]
                label = np.where(one, c_lo[x:y], -1 - np.arange(y - x))  # a block of several components has a label of its own
                tree = SignatureTree(lo[x:y], hi[x:y], hidden[x:y], maps, label, np.arange(y - x))
                i, j = np.triu_indices(FANOUT, 1)
                for level in range(len(tree.levels) - 1):
                    n = len(tree.levels[level][1])
                    base = np.arange(0, n, FANOUT)
                    pairs = np.column_stack(((base[:, None] + i).ravel(), (base[:, None] + j).ravel()))
                    found = block[x:y][tree.order[tree.descend(pairs[pairs[:, 1] < n], level, percent, label[tree.order])]]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), hub[x])), pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], ["hub", "i", "j"])

    return roots.repartition("hub").sortWithinPartitions("hub").mapInArrow(run, "hub long, i long, j long")


_WEIGHT = "greatest(1 / {}, w / {})"


def _large(groups: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame | None:
    """Links between the blocks of large ``groups`` (hub, rep, w) whose sets are of several components as yet."""
    named = groups.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("hub", "rep", "w", F.coalesce("component", "rep").alias("comp"))
    mixed = named.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("hub")
    named = save(named.join(mixed, "hub"), "named")
    if named.isEmpty():
        return None
    sizes = named.groupBy("hub", "comp", "w").agg((F.count("*") * F.expr(_WEIGHT.format(BLOCK, BLOCK_TOKENS))).alias("share"))
    before = F.sum("share").over(Window.partitionBy("hub").orderBy("comp", "w").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("share")
    place = F.col("before") + F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) / (1 << 20) * F.col("share")
    blocked = save(named.join(sizes.withColumn("before", before), ["hub", "comp", "w"]).select("hub", "rep", "w", "comp", F.floor(place).cast("long").alias("own")), "blocked")
    found = save(_trees(blocked.withColumn("i", F.col("own")).withColumn("j", F.col("own")), sets, percent, True), "roots")
    pairs = _block_pairs(found.where("hub is not null").select(*(f.split()[0] for f in _ROOT.split(", "))), percent)
    sent = pairs.select("hub", "i", "j", F.explode(F.array("i", "j")).alias("own"))
    across = save(_trees(blocked.join(save(sent, "sent"), ["hub", "own"]), sets, percent, False), "across")
    out = save(found.where("a is not null").select("a", "b").union(across.select("a", "b")), "links")
    discard(named, blocked, found, across)
    return out


def _joined(df: DataFrame, key: str, text: str, k: int, percent: int, least: Callable[[], object]) -> DataFrame:
    """(id, t, uid, n, c): every row, with the smallest ``least`` of the rows of its component; null for empty sets."""
    spark = df.sparkSession
    seen = save(sketch(df, key, text, k, percent), "sketch")
    some = seen.where("n > 0")
    heads = some.groupBy("first").agg(F.max("n").alias("n"), F.max("f").alias("f"), F.max("g").alias("g"), F.max(F.when(F.col("uid") == F.col("first"), F.xxhash64("id", "t"))).alias("x"), F.min(least()).alias("least"))
    same = Window.partitionBy("f", "g", "n")
    heads = save(heads.withColumn("rep", F.min("first").over(same)).withColumn("least", F.min("least").over(same)), "heads")
    rows = seen.agg(F.sum(F.size("routes"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROUTES_A_PARTITION))
    stars = _hubs(seen.where("routes is not null").select(F.explode("routes").alias("route"), "uid"), partitions)
    stars = save(stars, "stars")
    slim = save(seen.drop("routes"), "slim")
    discard(seen)
    met, seen = stars, slim
    stars = save(stars.join(heads.select(F.col("first").alias("uid"), "rep", F.col("n").alias("w")), "uid").where("rep != hub").select("hub", "rep", "w").distinct(), "groups")
    discard(met)
    size = stars.groupBy("hub").agg(F.count("*").alias("m"), F.sum("w").alias("all"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("all") / BLOCK_TOKENS)).cast("long")
    big = save(size.select("hub", blocks.alias("blocks")).where("blocks > 1"), "big")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    others = stars.join(big, "hub", "left").select("hub", F.pmod(F.xxhash64("rep"), blocks).alias("own"), "rep", "w")
    hubs = stars.select("hub").distinct().join(big, "hub", "left").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("own"), F.col("hub").alias("rep"), F.lit(1).cast("long").alias("w"))
    dealt = others.union(hubs).select("hub", F.col("own").alias("i"), F.col("own").alias("j"), "own", "rep", "w", F.col("rep").alias("comp"))
    needed = stars.select("rep").union(stars.select("hub")).distinct()
    wanted = save(heads.where("first = rep").join(needed, "rep").select("rep", "n", "f", "g", "x"), "wanted")
    sets = save(_sets(df, wanted, key, text, k), "sets")
    links = save(_trees(dealt, sets, percent, False).select("a", "b"), "links")
    comp = comp_table = save(components(links), "components")
    if not big.isEmpty():
        more = _large(stars.join(big.select("hub"), "hub").select("hub", "rep", "w").union(big.select("hub", F.col("hub").alias("rep"), F.lit(1).cast("long"))), sets, comp, percent)
        if more is not None and not more.isEmpty():
            comp = comp_table = save(components(links.union(more)), "components")
            discard(more)
    joined = comp.join(heads.where("first = rep").select(F.col("rep").alias("id"), "least"), "id")
    named = joined.join(joined.groupBy("component").agg(F.min("least").alias("c")), "component").select(F.col("id").alias("rep"), "c")
    heads_c = heads.join(named, "rep", "left").select("first", F.coalesce("c", "least").alias("c"))
    discard(stars, big, wanted, sets, links)
    out = seen.select("id", "t", "uid", "n", "first").join(heads_c, "first", "left").select("id", "t", "uid", "n", "c")
    out.folioscan_read = [seen, heads, comp_table]
    return out


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``df``: id, n (set size) and component (smallest id that is not null reachable by links)."""
    found = _joined(df, key, text, k, percent, lambda: F.col("id"))
    return found.select("id", "n", F.coalesce("c", "id").alias("component"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` per component, unchanged: that of the smallest key (nulls last), of these the smallest text hash.

    Rows without words all stay. Only the rows that may go are moved; a row is known by its key and text, and of rows
    that are equal in both the first that is met stays.
    """
    every = _joined(df, key, text, k, percent, lambda: F.struct(F.col("id").isNull().alias("none"), "id", "t", "uid"))
    found = every.where("n > 0")
    best = F.col("id").eqNullSafe(F.col("c.id")) & (F.col("t") == F.col("c.t"))
    rest = found.where(F.col("uid") != F.col("c.uid")).select("id", "t", best.alias("best")).distinct()
    kt, kx, kid, kk, kb = fresh(df.columns, "t", "x", "id", "k", "best")
    rest = save(rest.select(F.col("id").alias(kid), F.col("t").alias(kk), F.col("best").alias(kb)), "rest")
    discard(*every.folioscan_read)
    seen = IdFilter(rest.select(F.xxhash64(kid, kk)))
    marked = df.withColumn(kt, F.xxhash64(F.col(f"`{text}`"))).withColumn(kx, F.xxhash64(F.col(f"`{key}`"), F.col(kt)))
    where = len(df.columns) + 1

    def chosen(hit: bool) -> DataFrame:
        return map_arrow(marked, lambda b: b.filter(pa.array(seen.has(b.column(where).to_numpy()) == hit)), marked.schema, None)

    suspects = chosen(True).join(rest, F.col(f"`{key}`").eqNullSafe(F.col(kid)) & (F.col(kt) == F.col(kk)), "left")
    once = suspects.where(F.col(kb)).dropDuplicates([kid, kk])
    names = [f"`{c}`" for c in df.columns]
    return chosen(False).select(*names).union(suspects.where(F.col(kb).isNull()).select(*names)).union(once.select(*names))
