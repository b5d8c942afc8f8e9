"""PII, quality, language, sampling and packing against plain Python, and on odd tables."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from folioscan.llm import language, packing, pii, quality, sampling

ODD = [None, "", " ", "\n\n", "x", "é" * 300, "a " * 3000, "日本語 テキスト", "\x00\x7f"]


def odd_table(spark):
    rows = [(k, t, k % 3, "s") for k, t in enumerate(ODD)] + [(0, "x", 1, None), (None, "null id. a@b.cd", 1, "s"), (3, "\n\n", 0, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int, score string")


def base(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"\D", "", m[0])
            if k == "ip" and not all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_pii_base_spans_equal_the_patterns():
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("ab@@.-+1 2()0%\né9") for _ in range(r.randint(0, 70)))
        assert [s for s in pii.find(t) if s[0] in pii.BASE_KINDS] == base(t)


def test_pii_added_kinds_and_redaction():
    t = "see https://x.org/a?b=1. token = \"abcdef0123456789\" and DE89370400440532013000 mail a.b@c.de, 4111 1111 1111 1111"
    assert [(k, t[a:b]) for k, a, b in pii.find(t)] == [("email", "a.b@c.de"), ("card", "4111 1111 1111 1111"), ("url", "https://x.org/a?b=1"), ("iban", "DE89370400440532013000"), ("secret", "abcdef0123456789")]
    assert pii.redact(t) == 'see [URL]. token = "[SECRET]" and [IBAN] mail [EMAIL], [CARD]'


def test_redaction_leaves_no_tail_of_an_overlapping_span():
    t = "from 10.0.0.1 4111111111111111 on"
    found = pii.find(t)
    redacted = pii.redact(t)
    assert redacted.startswith("from [IP") and not any(t[hi - 6 : hi] in redacted for _, _, hi in found)
    assert pii.redact("abcdefgh!", [("secret", 0, 4), ("email", 2, 7), ("ip", 3, 5)]) == "[SECRET]h!"


def test_pii_tables(spark):
    df = odd_table(spark)
    out = pii.digest(pii.detect(df))
    assert out.count() == df.count() and pii.digest(pii.detect(df.limit(0))).count() == 0
    assert pii.scrub(df).schema == df.schema
    assert out.where("doc_id is null").first().n_email == 1
    row = out.where("doc_id = 4").first()
    assert row.base_sha256 == pii.base_digest([]) and row.spans == ""


def test_quality_learns_and_keeps_schema(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = [(k, " ".join(word() for _ in range(60)).capitalize() + ".", 1) for k in range(120)]
    bad = [(k + 1000, " ".join(word().upper() + "!!" for _ in range(60)), 0) for k in range(40)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    feats = quality.features(df)
    model = quality.fit_on(feats, df.select("doc_id", "quality"))
    got = quality.score(feats, model).join(df, "doc_id").collect()
    assert all((x.score >= quality.THRESHOLD) == (x.quality == 1) for x in got)
    assert quality.keep(df, model).count() == 120
    odd = odd_table(spark)
    assert quality.score(quality.features(odd), model).where("score between 0 and 1").count() == odd.count()
    assert quality.keep(odd.limit(0), model).schema == odd.schema
    none = quality.fit_on(feats, df.select("doc_id", "quality").limit(0))
    assert {round(x.score, 6) for x in quality.score(feats, none).collect()} == {0.5}


def test_quality_score_is_the_density_difference():
    rng = np.random.default_rng(0)
    k = len(quality.STATISTICS)
    a, b = rng.normal(size=(300, k)), rng.normal(size=(300, k)) * 2 + 1
    for x in (a, b):
        x[:, quality.STATISTICS.index("words")] = 9 + rng.normal(size=300) * 0.1
    covs = [np.cov(x.T, bias=True) for x in (a, b)]
    model = quality.Model(np.zeros(k), np.ones(k), [a.mean(0), b.mean(0)], [np.linalg.inv(np.linalg.cholesky(c)) for c in covs], [np.linalg.slogdet(c)[1] for c in covs], 0.0)
    x = a[:5]
    log = [-0.5 * (np.einsum("ij,jk,ik->i", x - m.mean(0), np.linalg.inv(c), x - m.mean(0)) + np.linalg.slogdet(c)[1]) for m, c in zip((a, b), covs)]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_language(spark):
    r = random.Random(4)
    speak = {"en": "the of and tion ing er th", "fr": "le la que é ment eau oi", "de": "der die sch ung ich ei ö"}
    rows = [(k, "".join(r.choice(speak[lang].split()) + r.choice(["", "", " "]) for _ in range(r.randint(20, 60))), lang) for k, lang in ((k, r.choice(list(speak))) for k in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.prototypes(df.where(~language.held_out()))
    out = language.identify(df, model).withColumn("held_out", language.held_out()).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang_pred == x.lang for x in out) >= 0.98 * len(out) and all(0 <= x.score <= 1 for x in out)
    assert {x.doc_id for x in out} == {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    odd = {x.doc_id: x for x in language.identify(odd_table(spark), model).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == "und" and odd[5].lang_pred in speak
    nobody = language.prototypes(df.limit(0))
    assert {x.lang_pred for x in language.identify(df, nobody).collect()} == {"und"}


def test_trigram_vector_binds_permuted_letters():
    s = language.Space(64, 1)
    a, b, c = s.letters[1], s.letters[2], s.letters[3]
    code = np.array([(1 * language._SYMBOLS + 2) * language._SYMBOLS + 3])
    assert (s.profile(code) == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_sampling_is_lossless_and_seeded(spark):
    df = odd_table(spark).unionByName(spark.createDataFrame([(77, "▁ literal▁ <0x41> <s> \t tab  two", 0, "")], "doc_id long, text string, spans int, score string"))
    rows = sampling.decode(sampling.encode(df)).collect()
    assert len(rows) == df.count() and all((x.text or "") == x.decoded for x in rows)
    again = {x.doc_id: x.ids for x in sampling.encode(df.repartition(3)).collect()}
    assert all(again[x.doc_id] == x.ids for x in rows if x.doc_id not in (0, 3))
    assert sampling.encode(df.limit(0)).count() == 0


def test_sampling_follows_the_weights():
    lat = sampling.lattice(theta=0.3)
    piece = {lat.raw[lat.raw_at[i] : lat.raw_at[i + 1]].tobytes().decode(): (int(i), w) for i, w in zip(lat.ids, lat.weights)}

    def ways(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in piece and " " not in s[1:k]:
                for rest, w in ways(s[k:]):
                    yield (piece[s[:k]][0], *rest), piece[s[:k]][1] + w

    text, n = "the re", 20000
    every = {p: np.exp(w) for p, w in ways(text)}
    total = sum(every.values())
    ids, at = lat.sample([text] * n, np.arange(n))
    seen = {}
    for k in range(n):
        p = tuple(ids[at[k] : at[k + 1]].tolist())
        seen[p] = seen.get(p, 0) + 1
    assert set(seen) <= set(every)
    for p, w in every.items():
        q = w / total
        assert abs(seen.get(p, 0) / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3


def test_sampling_finds_pieces_whose_hashes_begin_alike():
    own = object.__new__(sampling.Lattice)
    top = np.array([0, 0, 5, 5, 5, (1 << 20) - 1, (1 << 20) - 1], np.uint64)
    own.index(top << np.uint64(44) | np.arange(7, dtype=np.uint64))
    assert sorted(zip(*(x.tolist() for x in own.find(own.hashes[::-1])), strict=True)) == [(k, 6 - k) for k in range(7)]
    assert not len(own.find(own.hashes + np.uint64(7))[0])
    whole = sampling.lattice()
    some, place = whole.find(whole.hashes)
    assert len(some) == len(whole.hashes) and (some == place).all()


def test_word_encoder_equals_the_tokenizer():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(8)
    texts = ["it's I'LL don't x<|endoftext|>y <|STARTOFTEXT|>", "İstanbul ΣΑΣ é \x1c\x85\xa0a　b ﬁ Å \x00\x7f~`", *ODD] + ["".join(r.choice("aB1!' <|é,.\n") for _ in range(60)) for _ in range(300)]
    ids, at = e.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]


def test_word_encoder_asks_the_tokenizer_for_no_accented_word():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    every = "".join(map(chr, range(0xC0, 0x100)))
    texts = [every, *every, "".join(c + "7," for c in every)] + ["".join(r.choice("aZéÉßÿÞÇ3.- \n") for _ in range(80)) for _ in range(300)]
    mixed = ["".join(r.choice("aé×÷e\u0301\u00adœ'À\u0327 ") for _ in range(60)) for _ in range(300)]
    want = lambda t: [*whole.encode(t, add_special_tokens=False).ids, packing.END]
    whole, asked = e.tokenizer, []
    e.tokenizer = type("Seen", (), {"encode_batch_fast": lambda _, units, **more: asked.extend(units) or whole.encode_batch_fast(units, **more)})()
    ids, at = e.encode(pa.array([t.replace("×", "").replace("÷", "") for t in texts]))
    assert not asked
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == want(t.replace("×", "").replace("÷", ""))
    ids, at = e.encode(pa.array(mixed))
    assert asked
    for k, t in enumerate(mixed):
        assert ids[at[k] : at[k + 1]].tolist() == want(t)


def test_column_generation_reaches_the_bound():
    # 3 of size 5 and 2 + 2 + 1 combinations: the best is known by hand
    used = packing.plan(np.array([3, 5, 7]), np.array([40, 20, 40]), 10)
    assert sum(k * p for p, k in used).tolist() == [40, 20, 40] and sum(k for _, k in used) == 50
    assert packing.plan(np.array([], int), np.array([], int), 10) == []


def test_packing_places_every_piece(spark):
    r = random.Random(2)
    rows = [(k, " ".join("word" for _ in range(r.choice([0, 1, 30, 500, 700, 3000, 5000])))) for k in range(150)] + [(1000, None), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pieces(df)
    out = packing.pack(pieces.select("doc_id", "start", "length", "doc_tokens"), ["doc_id", "start"]).collect()
    assert len(out) == pieces.count() and sum(x.length for x in out) == sum(len((t or "").split()) + 1 for _, t in rows)
    sequences = {}
    for x in out:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(packing.pieces(df.limit(0)).drop("ids"), ["doc_id", "start"]).count() == 0
