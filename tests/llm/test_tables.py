"""Joins and stores against brute force, and on odd tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioscan.llm import jaccard, media, urls, vectors


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(k)
    word = lambda: r.choice("abcdefgh") + r.choice("ijklmnop") + str(r.randint(0, 30))
    rows = []
    for _ in range(12):
        own = [word() for _ in range(r.choice([3, 6, 9, 40, 120]))]
        for _ in range(r.choice([1, 3, 25])):
            w = list(own)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, " \n"), (len(rows) + 4, "one"), (len(rows) + 5, "ONE")]
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(sets, links)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.id: (x.n, x.component) for x in jaccard.classes(df, k=k, percent=percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (5, "a b c d e", 2), (5, "a b c d e", 3), (6, "A B C D E", 4), (None, None, 5), (None, "p q r s t u", 6)], "doc_id long, text string, component int")
    key = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or 0)
    assert sorted(((x.id, x.component) for x in jaccard.classes(df).collect()), key=key) == [(5, 5), (5, 5), (6, 5), (None, 5), (None, None), (None, None)]
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    left = sorted(x.component for x in kept.collect())
    assert left in ([2, 5, 6], [3, 5, 6])
    assert jaccard.classes(df.limit(0)).count() == 0 and jaccard.representatives(df.limit(0)).count() == 0


def test_jaccard_rows_of_one_key(spark):
    """A row is judged by its own text: what else bears its key doesn't matter."""
    a, b = "a b c d e f g", "one two three four five six"
    df = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((x.id, x.component) for x in jaccard.classes(df).collect()) == [(3, 3), (5, 3), (5, 5)]
    assert sorted(map(tuple, jaccard.representatives(df).collect())) == [(3, a), (5, b)]
    clash = df.select(df.doc_id.alias("id"), "text", df.doc_id.alias("T"), df.doc_id.alias("x"), df.doc_id.alias("uid"), df.doc_id.alias("__id"))
    assert sorted((r.id, r.text) for r in jaccard.representatives(clash, key="id").collect()) == [(3, a), (5, b)]
    names = df.select(df.doc_id.cast("string").alias("doc_id"), "text")
    assert sorted((x.id, x.component) for x in jaccard.classes(names).collect()) == [("3", "3"), ("5", "3"), ("5", "5")]


def test_jaccard_blocks_of_one_group(spark, monkeypatch):
    """A group of many blocks, most of one component and some of none: members are sent a bounded number of times."""
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    sent, trees = [], jaccard._trees
    monkeypatch.setattr(jaccard, "_trees", lambda dealt, *a: sent.append(dealt.count()) or trees(dealt, *a))
    r = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(r.choice([1, 2, 3]) if k % 10 else 60):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {x.id: x.component for x in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == groups(sets, links)
    assert len(sent) >= 2 and sum(sent[1:]) <= 4 * sent[0]


def test_routes_meet_for_every_linked_pair():
    r = random.Random(9)
    for _ in range(400):
        n = r.choice([6, 7, 13, 50, 300])
        a = [r.getrandbits(63) for _ in range(n)]
        b = list(a)
        for _ in range(jaccard.most_apart(n, n, 85) // 2):
            b[r.randrange(n)] = r.getrandbits(63)
        if 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b)):
            x, y = (np.sort(np.array(sorted(set(s)), np.uint64)) for s in (a, b))
            assert (set(a) == set(b)) or set(jaccard.routes(x, 85).tolist()) & set(jaccard.routes(y, 85).tolist())


def test_dual_traversal_never_prunes_a_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 80).astype(np.uint64)
    sets = []
    for _ in range(70):
        s = base.copy()
        s[rng.integers(0, 80, rng.integers(0, 12))] = rng.integers(0, 1 << 62)
        sets.append(np.unique(s))
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    maps = jaccard.bitmaps(np.concatenate(sets), at, 256)
    sizes, every = np.diff(at), np.arange(70)
    links = {(i, j) for i in range(70) for j in range(i + 1, 70) if jaccard.linked(sets[i], sets[j], 85)}
    for i, j in links:
        shared = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared)
    tried = []
    found, label = jaccard.tree_links(sizes, maps, every.copy(), every, 85, lambda x, y: tried.append((x, y)) or jaccard.linked(sets[x], sets[y], 85))
    want = groups(range(70), links)
    assert {tuple(sorted(p)) for p in found} <= links and len(tried) < 70 * 69 // 4
    got = groups(range(70), [(int(x), int(y)) for x, y in found])
    assert got == want and label.tolist() == [want[k] for k in range(70)]
    side = every % 2
    found, _ = jaccard.tree_links(sizes, maps, every.copy(), side, 85, lambda x, y: jaccard.linked(sets[x], sets[y], 85))
    assert all(side[x] != side[y] for x, y in found)
    assert groups(range(70), found) == groups(range(70), [p for p in links if side[p[0]] != side[p[1]]])


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = []
    for k in range(260):
        c = centres[k % 12] + rng.normal(size=24) * rng.choice([0.05, 0.1, 0.14])
        rows.append((k, c.tolist() if k % 10 else centres[0].tolist(), int(k % 12 % 5)))
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] + [1.0] * 23, 1), (904, [None] + [1.0] * 23, 1), (905, rows[1][1], None), (906, [float("inf")] + [1.0] * 23, 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = {r.id: (r.n_links, r.component) for r in vectors.near_duplicates(df).collect()}
    links = {(a, b) for a, b in zip(*np.nonzero(near))}
    assert sum(got[k][0] for k in range(260)) >= 0.99 * len(links) and all(got[k][0] <= near[k].sum() for k in range(260))
    want = groups(range(260), [(a, b) for a, b in links if a < b])
    assert sum(got[k][1] == want[k] for k in range(260)) >= 258
    assert all(got[k] == (0, k) for k in range(900, 907)) and got[907] == (1, 907) and got[908] == (1, 907)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    h = vectors._hadamard(np.eye(16))
    assert (h @ h.T == 16 * np.eye(16)).all()


def test_media_round_trip(spark):
    r = random.Random(6)
    part = "".join(r.choice("abcdefghij ") for _ in range(6000))
    texts = [None, "", "a", "é" * 96, "é" * 97, part, part + "x", "y" * 300 + part, part, "z" * 40000, *("".join(r.choice("abcé \n") for _ in range(r.randint(0, 5000))) for _ in range(40))]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(None, "no id", 0)], "doc_id long, text string, size int").repartition(4)
    got = {x.doc_id: x for x in media.columns(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((192 - len(raw) % 192) % 192 if raw else 192)
        x = got[k]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.stored_form(payload)
        assert (x.media_bytes, x.media_sha256, x.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
    assert media.columns(df.limit(0)).count() == 0


def test_chunks_resynchronise():
    r = random.Random(7)
    body = bytes(r.getrandbits(8) for _ in range(60000))
    cut = lambda b: {b[x:y] for ends in [media.cuts(b)] for x, y in zip([0, *ends[:-1]], ends)}
    assert b"".join(body[x:y] for ends in [media.cuts(body)] for x, y in zip([0, *ends[:-1]], ends)) == body
    assert len(cut(body) & cut(b"inserted" + body)) >= 0.8 * len(cut(body))
    assert all(media.LEAST < len(c) + 1 <= media.MOST + 1 or c == body[-len(c) :] for c in cut(body))


def test_url_list_as_of(spark):
    d = lambda n: dt.date(2024, 1, n)
    events = spark.createDataFrame([("x.org", d(3), "add", "block"), ("x.org", d(10), "remove", "block"), ("a.x.org", d(5), "add", "allow"), ("y.net", d(1), "add", "block"), ("y.net", d(1), "remove", "block"), (None, d(1), "add", "block")], "key string, day date, op string, action string")
    rows = [(1, "x.org", d(2)), (2, "x.org", d(3)), (3, "b.x.org", d(9)), (4, "x.org", d(10)), (5, "a.x.org", d(20)), (6, "a.x.org", d(6)), (7, "y.net", d(4)), (8, None, d(4)), (9, "x.org", None), (10, "", d(4)), (2, "x.org", d(3)), (11, "ax.org", d(5))]
    out = urls.rate(spark.createDataFrame(rows, "page_id long, host string, day date"), events).collect()
    assert len(out) == len(rows)
    assert {x.page_id: x.verdict for x in out} == {1: "pass", 2: "block", 3: "block", 4: "pass", 5: "allow", 6: "allow", 7: "pass", 8: "pass", 9: "pass", 10: "pass", 11: "pass"}
    assert {x.page_id: x.n_active for x in out}[6] == 2
    empty = urls.rate(spark.createDataFrame(rows, "page_id long, host string, day date"), events.limit(0)).collect()
    assert {x.verdict for x in empty} == {"pass"} and len(empty) == len(rows)


def test_url_hosts(spark):
    df = spark.createDataFrame([("http://u@A.b.Org:80/x",), ("nope",), (None,), ("https://localhost",)], "url string")
    from pyspark.sql import functions as F

    got = [(x.h, x.k) for x in df.select(urls.host_of(F.col("url")).alias("h"), urls.keys_of(urls.host_of(F.col("url"))).alias("k")).collect()]
    assert got == [("a.b.org", ["a.b.org", "b.org"]), ("", []), ("", []), ("localhost", ["localhost"])]
