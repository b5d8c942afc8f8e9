"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

A table hashes a vector by some cross-polytopes: signs are flipped at random and a fast Walsh-Hadamard transform
applied three times, and the coordinate of the largest magnitude, with its sign, is the value. A vector lies in its home
bucket of each table and also visits the ``PROBES`` buckets next in magnitude; two vectors meet where one is at home and
the other at home or visiting. The number of functions grows with the logarithm of the number of vectors, so that
buckets stay small (``functions_for``), and that of tables with it, so that links are still found (``tables_for``).

Only ids go to the buckets. The hub of a bucket is the smallest vector at home there, and all buckets with the same hub
make one group: whoever meets is in a group together, and a cluster that meets in forty buckets is compared once or
twice and not forty times. Vectors go to their groups with the list of their hubs; every pair of a group is compared by
its cosine in double precision, and a pair that shares several groups counts in that of the smallest hub. Tasks send
numbers of links and a spanning forest, never the pairs. Equal vectors are one class, with a weight. A group of more
than ``BLOCK`` vectors is cut into blocks, and pairs of blocks are dealt to tasks.

Defined results: a vector that is null, empty, zero, or has null or non-finite components, and one with a null label, links with
nothing; vectors of different length or label are never compared, whatever their hashes; ties in magnitude go to the lower
coordinate; a row with a null id takes part like any other, and a component is named by its smallest id that is not
null; rows of one id are rows of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import components, discard, mix64, runs_of, save, settle, small_batches, steady

PROBES, BLOCK = 4, 4096
ROWS_A_PARTITION = 1_000_000
BYTES_A_PARTITION = 64 << 20


def functions_for(n: int, dimensions: int) -> int:
    """Cross-polytopes of a table for ``n`` vectors: two at least, and so many that there are as many buckets as vectors."""
    values = 2 << max(1, (dimensions - 1).bit_length())
    return max(2, int(np.ceil(np.log(max(n, 2)) / np.log(values))))


def tables_for(functions: int) -> int:
    """With four probes a table of 2, 3, 4 functions has 0.89, 0.74, 0.58 of the pairs of cosine 0.98 at 768 dimensions; so many miss none in practice."""
    return 2 + 2 * functions


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, functions: int, probes: int, seed: int = 7) -> np.ndarray:
    """For each row and table the home bucket and then the probed ones, ``1 + probes`` numbers."""
    n, own = x.shape
    d = 1 << max(1, (own - 1).bit_length())
    x = np.concatenate((x, np.zeros((n, d - own))), axis=1)
    rng = np.random.default_rng([seed, d])
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        ways, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(functions):
            y = x
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : min(1 + probes, d)]
            value = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            far = np.take_along_axis(size, top[:, :1], 1) - np.take_along_axis(size, top, 1)
            ways = (ways[:, :, None] * (2 * d) + value[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + far[:, None, :] ** 2).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
            ways, cost = ways[rows[:, None], best], cost[rows[:, None], best]
        out[:, t, : ways.shape[1]] = ways
        out[:, t, ways.shape[1] :] = ways[:, :1]
    return out


def _classes(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Every row with the number of its class (null if it can't link), and one row per class with its weight and smallest id."""
    x = F.col("x")
    sound = x.isNotNull() & F.col("l").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("string").alias("l"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = rows.withColumn("h", F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws("|", F.hex(F.col("l").cast("binary")), F.concat_ws(",", F.transform("x", lambda v: (v + F.lit(0.0)).cast("string")))), 256)))
    rows = rows.select("id", "l", "x", F.conv(F.substring("h", 1, 15), 16, 10).cast("long").alias("f"), F.conv(F.substring("h", 16, 15), 16, 10).cast("long").alias("g"))
    classes = rows.where("f is not null").groupBy("f", "g").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("l").alias("l"), F.first("x").alias("x"))
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    return rows.select("id", "f", "g"), classes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visits(classes: DataFrame, n: int, functions: int | None, tables: int | None, probes: int) -> DataFrame:
    """A row (g, away, rep) for each class and bucket it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                vectors, reps, labels = batch.column(1), batch.column(2).to_numpy(), batch.column(0).to_pylist()
                at = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
                size, flat = np.diff(at), vectors.flatten().to_numpy(zero_copy_only=False)
                for d in np.unique(size):
                    pick = np.flatnonzero(size == d)
                    own = functions or functions_for(n, int(d))
                    many = tables or tables_for(own)
                    code = codes(_unit(flat[at[pick][:, None] + np.arange(d)].astype(float)), many, own, probes)
                    named = np.array([hash_of(labels[k]) for k in pick], np.uint64) + np.uint64(int(d))
                    bucket = mix64(named[:, None, None] + mix64(code.view(np.uint64) + (np.arange(many, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :, None]))
                    who = np.repeat(np.arange(len(pick)), many * (1 + probes))
                    away = np.tile(np.arange(1 + probes) > 0, len(pick) * many)
                    keep = ~away | (code != code[:, :, :1]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)[keep]), pa.array(away[keep]), pa.array(reps[pick][who[keep]])], ["g", "away", "rep"])
        settle()

    return classes.select("l", "x", "rep").mapInArrow(run, "g long, away boolean, rep long")


def hash_of(label: str) -> int:
    """A 64-bit number of a label; vectors whose labels share it may share a group, where the labels themselves are compared."""
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "little")


def _hubs(visits: DataFrame, partitions: int) -> DataFrame:
    """(rep, hub): the hub of a bucket is the smallest rep at home there; buckets without one are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        last, hub, sound = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            g, away, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            new[0] = last is None or g[0] != last
            at, which = np.flatnonzero(new), np.cumsum(new)
            hubs, homes = np.concatenate(([hub], rep[at]))[which], np.concatenate(([sound], ~away[at]))[which]
            last, hub, sound = g[-1], hubs[-1], homes[-1]
            pairs = np.column_stack((rep, hubs))[homes & (rep != hubs)]
            if len(pairs):
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["rep", "hub"])
        settle()

    return visits.repartition(partitions, "g").sortWithinPartitions("g", "away", "rep").mapInArrow(run, "rep long, hub long").distinct()


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component under the links a - b and the forest ``root``."""
    while True:
        new = root.copy()
        np.minimum.at(new, root[a], root[b])
        np.minimum.at(new, root[b], root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _first_shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest number that rows of ``p`` and ``q`` share; rows are sorted, padded with -1 and -2."""
    out = np.empty(len(p), np.int64)
    step = max(1, (1 << 22) // max(1, p.shape[1] * q.shape[1]))
    for k in range(0, len(p), step):
        x, y = p[k : k + step], q[k : k + step]
        out[k : k + step] = x[np.arange(len(x)), (x[:, :, None] == y[:, None, :]).any(axis=2).argmax(axis=1)]
    return out


def _compare(hub: int, u: np.ndarray, own: np.ndarray | None, hubs: list[np.ndarray], weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector that count in this group, and the components they make."""
    m = len(u)
    links, root = np.zeros(m, np.int64), np.arange(m)
    width = max(map(len, hubs))
    p, q = np.full((m, width), -1, np.int64), np.full((m, width), -2, np.int64)
    for k, h in enumerate(hubs):
        p[k, : len(h)] = q[k, : len(h)] = h
    step = max(1, (1 << 20) // m)
    for lo in range(0, m, step):
        near = u[lo : lo + step] @ u[lo:].T >= least
        if own is not None:
            near &= own[lo : lo + step, None] != own[None, lo:]
        a, b = np.nonzero(near)
        a, b = a[b > a] + lo, b[b > a] + lo
        if width > 1 and len(a):
            good = _first_shared(p[a], q[b]) == hub
            a, b = a[good], b[good]
        if len(a):
            links += np.bincount(a, weights=weight[b], minlength=m).astype(np.int64) + np.bincount(b, weights=weight[a], minlength=m).astype(np.int64)
            root = _forest(a, b, root)
    return links, root


def _links(dealt: DataFrame, partitions: int, least: float) -> DataFrame:
    """(kind 0: rep, links found) and (kind 1: rep, a smaller one in the same component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for t in runs_of(batches, ["hub", "i", "j"]):
            hub, i, j, own, rep, weight = (t.column(c).to_numpy() for c in ("hub", "i", "j", "own", "rep", "weight"))
            label = t.column("l").combine_chunks().dictionary_encode()
            label = (label if isinstance(label, pa.DictionaryArray) else label.combine_chunks()).indices.to_numpy()
            vectors, hubs = t.column("x").to_pylist(), t.column("hubs").to_pylist()
            size = np.array([len(v) for v in vectors])
            order = np.lexsort((rep, size, label, j, i, hub))
            new = np.zeros(len(order), bool)
            for c in (hub, i, j, label, size):
                new[1:] |= c[order][1:] != c[order][:-1]
            cut = np.concatenate(([0], np.flatnonzero(new), [len(order)]))
            a, b, kind = [], [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                k = order[lo:hi]
                u = _unit(np.frombuffer(b"".join([vectors[x] for x in k]), float).reshape(hi - lo, -1))
                split = own[k] if i[k[0]] != j[k[0]] else None
                links, root = _compare(int(hub[k[0]]), u, split, [np.frombuffer(hubs[x], np.int64) for x in k], weight[k], least)
                some, tree = np.flatnonzero(links), np.flatnonzero(root != np.arange(hi - lo))
                a += [rep[k[some]], rep[k[tree]]]
                b += [links[some], rep[k[root[tree]]]]
                kind += [np.zeros(len(some), np.int32), np.ones(len(tree), np.int32)]
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kind, a, b)], ["kind", "a", "b"])
        settle()

    return dealt.repartition(partitions, "hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(run, "kind int, a long, b long")


def _packed(rows: DataFrame) -> DataFrame:
    """Vectors and lists of hubs as bytes, which tasks read without a copy for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = list(b.columns)
                for name in ("x", "hubs"):
                    c = b.column(name)
                    at = (c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py()) * 8
                    flat = c.flatten().to_numpy(zero_copy_only=False)
                    columns[b.schema.get_field_index(name)] = pa.Array.from_buffers(pa.large_binary(), len(c), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.select("rep", "l", "weight", "x", "hubs").mapInArrow(run, "rep long, l string, weight long, x binary, hubs binary")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, tables: int | None = None, functions: int | None = None, probes: int = PROBES) -> DataFrame:
    """One row per row of ``df``: id, n_links (other rows linked directly) and component (smallest id reachable)."""
    spark = df.sparkSession
    small_batches(spark)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    member, classes = _classes(df, key, vector, label)
    n, numbers = classes.agg(F.count("*"), F.sum(F.size("x"))).first()
    visits = _visits(classes, n, functions, tables, probes)
    rows = n * (1 + probes) * (tables or tables_for(functions_for(n, (numbers or 1) // max(n, 1) or 1)))
    hubs = save(_hubs(visits, max(shuffled, -(-rows // ROWS_A_PARTITION))), "hubs")
    size = hubs.groupBy("hub").agg(F.count("*").alias("m"))
    big = save(size.select("hub", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")).where("blocks > 1"), "big")
    every = hubs.union(hubs.select(F.col("hub").alias("rep"), "hub").distinct())
    lists = every.groupBy("rep").agg(F.sort_array(F.collect_list("hub")).alias("hubs"))
    vectors = classes.join(lists, "rep")
    spread = save(_packed(vectors), "vectors").join(every, "rep").join(big, "hub", "left")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("rep"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = spread.select("hub", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "rep", "weight", "l", "x", "hubs")
    volume = every.count() * 8 * ((numbers or 0) // max(n, 1) + 8)
    found = save(_links(dealt, max(shuffled, -(-volume // BYTES_A_PARTITION)), least), "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    comp = save(components(found.where("kind = 1").select("a", "b")), "components").select(F.col("id").alias("rep"), "component")
    linked = comp.join(classes.select("rep", "least"), "rep")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("c")), "component").select("rep", "c")
    rated = classes.join(counts, "rep", "left").join(named, "rep", "left")
    rated = rated.select("f", "g", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("c", "least").alias("c"))
    discard(hubs, big)
    return member.join(rated, ["f", "g"], "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component"))
