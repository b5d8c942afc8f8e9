from __future__ import annotations

import random

import pyarrow as pa

from folioscan.llm import spans


def brute(rows):
    """Texts without the sentences that a non-first repeated span covers, by comparing word lists."""
    seen, cut = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        s = spans.Sentences(pa.array([text], pa.string()))
        parts = [s.data[a:b].tobytes().decode() for a, b in zip(s.lo, s.hi)]
        words = [p.split() for p in parts]
        n = len(parts)
        size = lambda a, b: sum(map(len, words[a : b + 1]))
        found = set()
        for i in range(n):
            e = next((e for e in range(i + 2, n) if size(i, e) >= spans.WORDS), None)
            b = next((b for b in range(i - 2, -1, -1) if size(b, i) >= spans.WORDS), None)
            found |= {(i, e)} if e is not None else set()
            found |= {(b, i)} if b is not None else set()
        gone = set()
        for a, b in sorted(found):
            first = seen.setdefault(tuple(w for x in words[a : b + 1] for w in x), (doc, a))
            if first != (doc, a):
                gone |= set(range(a, b + 1))
        cut[doc] = text if not gone else "".join(p for k, p in enumerate(parts) if k not in gone)
    return cut


def test_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(1, 12))) + r.choice([". ", "! ", "\n", "? "])
    passages = ["".join(sentence() for _ in range(9)) for _ in range(4)] + [" ".join(word() for _ in range(90)) + "\n"]
    rows = [(k, "".join(r.choice([sentence(), sentence(), sentence(), r.choice(passages)]) for _ in range(r.randint(0, 14)))) for k in range(60)]
    rows += [(60, rows[3][1]), (61, None), (62, ""), (63, "one."), (64, " \n "), (65, "é à. " * 40)]
    got = spans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {x.doc_id: x.text for x in got} == want
    assert sum(x.n_removed > 0 for x in got) > 10


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a. b. c." * 30, 1), (None, None, 2), (7, "x", 3)], "doc_id long, text string, cuts int")
    out = spans.dedup(df)
    assert out.columns == df.columns and sorted(out.collect(), key=str) == sorted(df.collect(), key=str)
    assert spans.report(df.limit(0)).count() == 0


def test_passage_without_stops_is_found_inside_other_text(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = [(k, " ".join(word() for _ in range(15 + k)) + " " + passage + " " + " ".join(word() for _ in range(9))) for k in range(2)]
    a, b = sorted(spans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert a.n_removed == 0 and len(b.text.split()) < 16 + 9 + 30


def test_passages_inside_sentences_against_brute_force_on_words(spark):
    r = random.Random(11)
    fresh = iter(range(10**6))
    word = lambda: f"{r.choice('abcdefgh')}{next(fresh)}" + r.choice(["", "", "", "", ".", "\n"])
    passages = [[f"p{k}x{n}" + ("." if r.random() < 0.03 * (k % 3) else "") for n in range(51 + k)] for k in range(20)]
    docs = []
    for k in range(80):
        words = [word() for _ in range(r.randint(0, 40))] + [x + r.choice([""] * 19 + ["\n"]) for x in passages[k % 20]] + [word() for _ in range(r.randint(0, 40))]
        docs.append((k, " ".join(words)))
    texts = {k: t.split() for k, t in docs}
    covered = {}  # the words that a non-first occurrence of so many words in a row covers
    for size in (spans.WORDS, 51):
        seen, covered[size] = set(), {k: set() for k in texts}
        for k, t in texts.items():
            for a in range(len(t) - size + 1):
                here = tuple(t[a : a + size])
                covered[size][k] |= set(here) if here in seen else set()
                seen.add(here)
    got = {x.doc_id: x for x in spans.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, t in texts.items():
        gone = set(t) - set(got[k].text.split())
        assert len(covered[51][k] - gone) <= 15 and gone <= covered[spans.WORDS][k]
        assert bool(gone) == (got[k].n_removed > 0) == (k >= 20)

def test_short_repeats_stay_and_passages_of_51_words_go(spark):
    fresh = iter(range(10**6))
    new = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    for size, gone in ((28, False), (35, False), (51, True), (52, True), (60, True)):
        passages = [new(size) for _ in range(40)]
        rows = [(k, " ".join((new(11 + k % 13), passages[k % 40], new(17)))) for k in range(80)]
        got = {x.doc_id: x for x in spans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all((got[k].n_removed > 0) == (gone and k >= 40) and (gone or got[k].text == t) for k, t in rows)
