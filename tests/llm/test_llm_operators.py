"""The training-data operators against brute force, exact round trips and defined edge cases."""

import collections
import hashlib
import io
import math
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import ann, bpe, caches, langid, lm, minhash, packing, queries, toxicity, urlfilter, vecdedup, warc
from lexiloom.llm.common import words_of
from lexiloom.llm.components import components

SF = "/root/testdata/sf0.001"

LONG = "word " * 30_000
WORD_BPE, BYTE_BPE, PIECES = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, sig string, component string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, "x", "y") for i, t, lang in rows], DOCS)


EDGES = [(1, None, None), (2, "", "en"), (3, LONG, "en"), (4, "Héllo <|endoftext|> wörld\t\n 12", "de"), (4, "Héllo <|endoftext|> wörld\t\n 12", "de"), (None, "a b c d e f", "fr"), (6, " \n\t", None), (7, "x" * 5000, "en")]


# packing


def test_best_fit_takes_the_tightest_window():
    where, offset, room = packing.best_fit_decreasing(np.array([5, 4, 3, 3, 2, 1]), 8)
    assert where.tolist() == [0, 1, 0, 1, 2, 1] and room.tolist() == [0, 0, 6]
    for w in range(3):
        spans = sorted((offset[i], [5, 4, 3, 3, 2, 1][i]) for i in np.flatnonzero(where == w))
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_best_fit_against_brute_force():
    lengths = np.random.default_rng(1).integers(1, 64, 500)
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
    assert sorted(packing.best_fit_decreasing(lengths, 64)[2].tolist()) == sorted(rooms)


def test_word_encoder_as_the_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(WORD_BPE), packing.encoder(WORD_BPE)
    texts = ["Big BIG big <|ENDOFTEXT|> <|endoftext|>x", "İSTANBUL ΣΊΣΥΦΟΣ Kelvin ﬁn", "A\u0301 a\u0301 É\u00a0E", "<|startoftext|>in <|StartOfText|>", "", None, "x" * 3000, "it's IT'S 12 3.4 日本 👍🏽", "tab\tnew\nline\x0bvt\x85nel"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs_of(spark, EDGES), WORD_BPE).collect()
    tok = Tokenizer.from_file(WORD_BPE)
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r["doc_id"], r["doc_tokens"]].append(r)
    for i, t, _ in EDGES:
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(whole[i, len(want) // 4], key=lambda r: r["start"])
        assert want in {b"".join(r["ids"] for r in pieces), b"".join(r["ids"] for r in pieces[::2])}
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    assert packing.pack_documents(docs_of(spark, []), WORD_BPE).count() == 0


# BPE


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    wide = ("a\u00a0b \u3000 c\u2003\n d" + "x y" * 7 + " \u00a0") * 50
    texts = [t for _, t, _ in EDGES] + [wide, "<|endoftext|>" * 3, "I'll don't 're  two  spaces\n\n\nlines \t tab", "日本語 émoji 😂👍🏽", "\x1c\x85  odd   spaces ", "aaaaaaaaaaaaaaaaaaab", "%%%***&&& 123456 ²³"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.decode_documents(bpe.encode_documents(df, BYTE_BPE), BYTE_BPE).collect()
    tok = Tokenizer.from_file(BYTE_BPE)
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False) == (texts[r["doc_id"]] or "")
    assert bpe.encode_documents(df.limit(0), BYTE_BPE).count() == 0
    clash = df.select(F.lit(None).cast("long").alias("doc_id"), "text").withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "n_tokens": F.lit(2)})
    got = bpe.decode_documents(bpe.encode_documents(clash, BYTE_BPE, keep=("doc_id", "ids", "decoded")), BYTE_BPE)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "n_tokens"] and got.where("doc_id is null").count() == len(texts)


def test_bpe_cuts_long_texts_where_no_word_crosses(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "SLICE", 7)
    codec, tok = bpe.codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in ("one two  three\n\n four" * 9, "a\u00a0 b\u2003  c \u00a0\n d's 12 " * 9, "\u00a0" * 30, "  " * 30 + "x"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_bpe_compatibility_decides_as_merging_does():
    codec = bpe.codec(BYTE_BPE)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    sound = np.array([codec.merge(codec.bytes_of[t]) == [t] for t in x]) & np.array([codec.merge(codec.bytes_of[t]) == [t] for t in y])
    fine = codec.compatible(x, y)
    for a, b, ok, s in zip(x.tolist(), y.tolist(), fine, sound):
        if s:
            assert ok == (codec.merge(codec.bytes_of[a] + codec.bytes_of[b]) == [a, b])
    assert codec.merge(b"") == []


# near duplicates


def brute_groups(rows, percent):
    def shingles(t):
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    ids = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return collections.Counter((rows[k][0], len(sets[k]), ids[g] if sets[k] else rows[k][0]) for k, g in enumerate(group))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(100 + k, t) for k, (_, t, _) in enumerate(EDGES)] + [(None, "a b c d e f"), (3, LONG.upper()), (1, "one two"), (2, "One two"), (9, "one three")]
    hot = " ".join(f"hot{k}" for k in range(12))
    for c in range(6):
        base = [f"w{c}_{k}" for k in range(60)]
        for copy in range(12):
            words = list(base)
            for k in rng.integers(0, 60, copy // 2):
                words[k] = f"new{rng.integers(1e9)}"
            rows.append((1000 + 20 * c + copy, f"{hot} {' '.join(words)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1)).withColumn("n_shingles", F.lit("x"))
    got = minhash.near_duplicates(df, 85).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(df.limit(0), 85).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1300, dtype=np.uint64)
    for n in (1, 3, 40, 1000):
        s = np.unique(pool[:n])
        assert len(minhash.signature(s, 180)) == 180
    a, b = np.unique(pool[:1000]), np.unique(pool[100:1100])
    assert abs((minhash.signature(a, 2048) == minhash.signature(b, 2048)).mean() - 900 / 1100) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# language model


def test_lattice_sums_all_segmentations():
    lattice = lm.Lattice([lm.MARK.encode(), (lm.MARK + "a").encode(), (lm.MARK + "ab").encode(), b"a", b"b", b"ab", b"c"])
    rng = np.random.default_rng(0)
    lattice.start(rng.normal(size=7))

    def brute(word):
        def inner(at):
            if at == len(word):
                return math.exp(lattice.log_end)
            return sum(math.exp(lattice.logp[i]) * inner(at + len(p)) for p, i in lattice.inner.items() if word.startswith(p, at))

        return sum(math.exp(lattice.logp[i]) * inner(len(p)) for p, i in lattice.first.items() if word.startswith(p))

    words = [b"", b"a", b"ab", b"abab", b"abcab", b"aabbc"]
    assert np.allclose(np.exp(lattice.score(words)), [brute(w) for w in words])
    total, used, ends = lattice.forward(words, np.ones(len(words)))
    assert np.allclose(np.exp(total), [brute(w) for w in words]) and ends == len(words)
    assert used[lattice.starts].sum() == pytest.approx(len(words))
    words += [b"abcab" * 40, b"zz"[:0]]
    assert np.allclose([lattice.rolling(w) for w in words], lattice.score(words))


def test_lattice_of_a_very_long_word():
    import tracemalloc

    pieces, weights = lm.load_pieces(PIECES)
    lattice = lm.Lattice(pieces)
    lattice.start(weights)
    rng = np.random.default_rng(2)
    word = bytes(rng.integers(97, 123, lm.LONG_WORD + 1).astype(np.uint8))
    assert lattice.score([word])[0] == pytest.approx(lattice.forward([word])[0][0])
    word = bytes(rng.integers(97, 123, 400_000).astype(np.uint8))
    tracemalloc.start()
    assert np.isfinite(lattice.score([b"short", word])).all()
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_every_ordinary_piece_is_an_arc():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ordinary = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    ordinary = {p.encode() for p in ordinary if lm.MARK not in p[1:]}
    assert max(map(len, ordinary)) > 19
    assert ordinary <= set(lm.load_pieces(PIECES)[0])


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 3)  # the others are joined
    monkeypatch.setattr(lm, "BATCH_BYTES", 20)
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The dog sat down", None, "", "the the the unseenword", LONG, "the cat sat"])] + [(0, "the cat sat"), (None, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = lm.score_documents(df, PIECES, "coalesce(doc_id, 99) % 3 <> 1").collect()
    words = lambda t: [*(t or "").lower().split(), None]
    train = collections.Counter(w for i, t in rows if (99 if i is None else i) % 3 != 1 for w in words(t))
    n, v = sum(train.values()), len(train)
    want = collections.Counter()
    for i, t in rows:
        want[i, len(words(t)), sum(train[w] > 0 for w in words(t)), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 5)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    # The whole score: known words' arcs beside the sum over all segmentations, under pieces fitted here in plain Python.
    lattice = lm.Lattice(lm.load_pieces(PIECES)[0])
    lattice.start(lm.load_pieces(PIECES)[1])
    types = [w for w in train if w is not None]

    def paths(word):
        """Forward and backward sums over nodes, and arcs (from, to, piece), in linear space."""
        raw, p = word.encode(), np.exp(lattice.logp)
        arcs = [(-1, len(x), i) for x, i in lattice.first.items() if raw.startswith(x)]
        arcs += [(at, at + n, i) for at in range(len(raw)) for n in range(1, lattice.longest + 1) if at + n <= len(raw) and (i := lattice.inner.get(raw[at : at + n])) is not None]
        ahead, back = {-1: 1.0}, {len(raw): math.exp(lattice.log_end)}
        for a, b, i in sorted(arcs):
            ahead[b] = ahead.get(b, 0.0) + ahead.get(a, 0.0) * p[i]
        for a, b, i in sorted(arcs, reverse=True):
            back[a] = back.get(a, 0.0) + back.get(b, 0.0) * p[i]
        return ahead, back, arcs, p

    for _ in range(lm.ROUNDS):
        used = np.zeros(len(lattice.pieces))
        for w in types:
            ahead, back, arcs, p = paths(w)
            for a, b, i in arcs:
                used[i] += ahead.get(a, 0.0) * p[i] * back.get(b, 0.0) / back[-1]
        lattice.fit(used, float(len(types)))
    of_count = [sum(train[w] == c for w in types) for c in (1, 2, 3, 4)]
    discount, freed = lm.discounts(of_count, len(types))
    ends = train[None]

    def score(w):
        if w is None:
            return math.log10(ends / n)
        c = train[w]
        return math.log10((c - discount[min(c, 3)]) / n * (c > 0) + freed / n * paths(w)[1][-1])

    long_words = {"x" * 5000}
    for r in got:
        whole = [t for i, t in rows if i == r["doc_id"] and len(words(t)) == r["n_tokens"]]
        if not long_words & set(words(whole[0])):
            assert any(r["score"] == pytest.approx(sum(map(score, words(t))), rel=1e-6) for t in whole)
    same = {r["score"] for r in got if r["doc_id"] == 0}
    assert len(same) == 1
    empty = lm.score_documents(df.limit(0), PIECES, "true")
    assert empty.count() == 0


# toxicity and language


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("etaoinsr"), rng.integers(2, 7))) for _ in range(300)]
    rows = []
    for i in range(240):
        words = list(rng.choice(vocab, 80))
        if i % 3 == 0:
            for k in rng.integers(0, 80, 4):
                words[k] = rng.choice(["idiot", "scumbag"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 160] + [(1, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    edge = docs_of(spark, EDGES).select("doc_id", "text", F.lit(1).alias("score"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i >= 160]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(edge.select("doc_id", "text"), model).collect())
    clean = " ".join(rng.choice(vocab, 100))
    probe = spark.createDataFrame([(1, clean), (2, clean + " you idiott and scumbagg " * 3), (3, (clean + " ") * 30 + " idiot scumbag idiot")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(probe, model).collect()}
    assert s[1] < 0.5 < s[3] and s[2] > s[1]
    assert toxicity.fit(docs.limit(0), labels) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs.limit(2), None).collect()} == {0.0}


def test_toxicity_of_long_documents_only(spark):
    """Labelled texts of any length teach; repeated rows score alike; clashing columns give way."""
    rng = np.random.default_rng(14)
    vocab = ["".join(rng.choice(list("etaoinsr"), rng.integers(2, 7))) for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocab, 6_000))
        if i % 2:
            k = rng.integers(0, 5_000)
            words[k : k + 6] = ["idiot", "scumbag"] * 3
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[1][:2]] * 3, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.mean([(s >= 0.5) == y for s, y in zip(model.scores([t for _, t, _ in rows]), [y for _, _, y in rows])]) > 0.95
    clash = docs_of(spark, EDGES + EDGES[:2])
    got = toxicity.score_toxicity(clash, model, keep=("doc_id", "score", "lang")).collect()
    assert got[0].__fields__ == ["doc_id", "lang", "score"] and len(got) == len(EDGES) + 2
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_word_buckets_are_shared_by_misspellings():
    (a, na), (b, nb) = toxicity.bag([b"scumbag"]), toxicity.bag([b"scumbagg"])
    assert len(set(a) & set(b)) >= 10 and na.tolist() == [len(a)] and nb.tolist() == [len(b)]
    both, n = toxicity.bag([b"scumbag", "élan".encode(), b"x"])
    assert sorted(both[: n[0]]) == sorted(a) and n.tolist() == [len(a), 4 + 3 + 2 + 1, 1 + 1]


def test_caches_are_bounded_and_exact():
    made = []
    cache = caches.BoundedCache(lambda keys: made.extend(keys) or [len(k) for k in keys], 20 * caches.ENTRY_BYTES)
    for n in range(200):
        keys = {b"often", b"w%d" % n, b"x" * 500}
        held = cache.values(keys)
        assert [held[k] for k in keys] == [len(k) for k in keys]
    assert made.count(b"often") <= 60 and len(cache.held) < 60
    ids = caches.IdCache(lambda keys: [np.frombuffer(k, np.uint8).astype(np.uint32) for k in keys], slots=16, most_ids=100)
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = [bytes(rng.integers(97, 100, rng.integers(0, 4)).astype(np.uint8)) for _ in range(30)] + [b"q" * 300]
        flat, n = ids.lookup(words)
        assert flat.astype(np.uint8).tobytes() == b"".join(words) and n.tolist() == [len(w) for w in words]
    assert ids.lookup([])[0].tolist() == [] and ids.encode_groups([[], [b"ab"]])[0] == b""


def test_toxicity_sample_is_of_documents_that_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 80)
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("etaoinsr"), rng.integers(2, 7))) for _ in range(300)]
    rows = [(i, " ".join([*rng.choice(vocab, 60), *["idiot"] * (2 * (i % 3 == 0))]), int(i % 3 == 0)) for i in range(180)]
    long = [(1_000 + i, "word " * 2_000, 1) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows + long], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows + long] + [(10_000 + i, i % 2) for i in range(4_000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is not None
    assert np.mean([(model.score(t) >= 0.5) == y for _, t, y in rows]) > 0.9


def test_language(spark):
    rng = np.random.default_rng(6)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "de": "ich ein sch der ung ver zu kei heit lich".split(), "fr": "que eau ent ou eux ment oi ai elle tre".split(), "es": "cion ado que os la ar ción es mente ida".split()}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(40)), lang) for i, lang in enumerate(list(syllables) * 40)]
    docs = spark.createDataFrame(rows + [(900, "no label here", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 4 <> 9 and doc_id % 5 > 0"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 5 == 0]) > 0.9
    edge = langid.identify(docs_of(spark, EDGES).select("doc_id", "text"), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in edge if r["doc_id"] in (1, 2, 6)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in edge)
    assert langid.fit(docs.limit(0)) is None
    assert langid.identify(docs.limit(1), None).first()["lang_pred"] == "und"


def test_language_of_long_documents_only(spark):
    texts = {"en": "the hand and one ring in her den ", "de": "ich schreibe eine lange verordnung "}
    rows = [(i, ("1 " * 15_000 + texts["de"] * 900) if i % 2 else texts["en"] * 5, ["en", "de"][i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    assert all(r["lang_pred"] == ["en", "de"][r["doc_id"] % 2] for r in langid.identify(docs, model).collect())


def test_toxicity_scores_against_plain_loops(spark):
    """The scores of the registered query's model, word by word and window by window."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learnt = "crc32(cast(doc_id as string)) % 5 <> 0"
    model = toxicity.fit(docs.where(learnt), labels.where(learnt))
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF).collect()}
    logit = (model.embed.astype(np.float32) @ model.softmax).tolist()
    memo = {}

    def word(w):
        if w not in memo:
            whole = f"<{w.lower()}>"
            grams = [whole] + [whole[i : i + n] for n in toxicity.GRAMS for i in range(len(whole) - n + 1)]
            hashes = [xxhash.xxh3_64_intdigest(whole)] + [rolled(g) for g in grams[1:]]
            memo[w] = sum(logit[h % toxicity.BUCKETS] for h in hashes) / len(hashes)
        return memo[w]

    def rolled(gram):
        h, mask = 0, (1 << 64) - 1
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
        h = (h + len(gram)) & mask
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    assert len(got) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        w = [word(x.decode()) for x in words_of((r["text"] or "").encode())]
        step = toxicity.WINDOW // 2
        starts = [0] if len(w) <= toxicity.WINDOW else range(0, len(w) - step, step)
        best = max(sum(w[a : a + toxicity.WINDOW]) / len(w[a : a + toxicity.WINDOW]) for a in starts) if w else 0.0
        want = 1 / (1 + math.exp(-(best + model.bias)))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-5)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5) and got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_languages_against_plain_loops(spark):
    """Features counted gram by gram, the family by its softmax, then votes of the pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    got = {r["doc_id"]: r for r in queries.op8_language(spark, SF).collect()}
    assert len(got) == docs.count()
    w, bias = model.weights.astype(float), model.bias
    for r in docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect():
        row, text = got[r["doc_id"]], (r["text"] or "").lower().encode()
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        raw = b" " + b" ".join(bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text).split()) + b" "
        x = np.zeros(langid.DIMS)
        for n, salt in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
            for at in range(len(raw) - n + 1):
                x[((int.from_bytes(raw[at : at + n], "big") * salt) & 0xFFFFFFFF) >> 19] += 1
        x = np.sqrt(x)
        z = x / np.linalg.norm(x) @ w + bias
        k = len(model.families)
        p = np.exp(z[:k] - z[:k].max())
        p /= p.sum()
        group = model.within[int(p.argmax())]
        sure = {pair: 1 / (1 + math.exp(-4 * z[k + i])) for i, pair in enumerate(model.pairs)}
        chance = {i: sum(s if i == a else 1 - s for (a, b), s in sure.items() if i in (a, b)) for i in group}
        votes = {i: sum((s >= 0.5) == (i == a) for (a, b), s in sure.items() if i in (a, b)) for i in group}
        best = max(group, key=lambda i: (votes[i], chance[i], -i))
        assert row["lang_pred"] == model.langs[best]
        assert row["score"] == pytest.approx(min(1.0, p.max() * (chance[best] / (len(group) - 1) if len(group) > 1 else 1)), abs=1e-4)


def test_nearest_recall_on_the_tables(spark):
    from lexiloom.llm import measure

    assert measure.op9_nearest(spark, SF)["recall"] >= 0.9


def test_packing_is_close_to_full(spark):
    """Padding against the least there could be, in one partition and in many."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for parts, most in ((1, 0.02), (8, 0.06)):
        pieces = packing.pack_documents(docs.repartition(parts), WORD_BPE).select("sequence_id", "length").toPandas()
        windows, tokens = pieces["sequence_id"].nunique(), int(pieces["length"].sum())
        assert 1 - tokens / (windows * packing.WINDOW) < most, (parts, windows)


# WARC


def test_warc_every_split_size(spark):
    big = "".join(map(str, range(2000)))
    rows = [(1, "http://a/ x\n", "small"), (2, None, None), (3, "http://b/", big), (5, "http://c/", big), (4, "http://d/", big), (5, "http://c/", big), (None, "http://e/", big), (7, "u", LONG * 5), (8, "u", "\x1f\u008b\x08" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("payload", F.lit(0))
    want = None
    for split in (64, 1000, 1 << 25):
        got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_length"], r["payload_digest"]) for r in warc.archive(pages, split).collect()), key=repr)
        assert want in (None, got)
        want = got
    types = collections.Counter((r[0], r[1], r[2]) for r in want)
    assert types == collections.Counter({("urn:page:1", "response", None): 1, ("urn:page:2", "response", None): 1, ("urn:page:3", "revisit", "urn:page:5"): 1, ("urn:page:4", "revisit", "urn:page:5"): 1, ("urn:page:5", "response", None): 2, ("urn:page:none", "revisit", "urn:page:5"): 1, ("urn:page:7", "response", None): 1, ("urn:page:8", "response", None): 1})
    assert dict((r[0], r[3:]) for r in want)["urn:page:2"] == (0, hashlib.sha1(b"").hexdigest())
    assert dict((r[0], r[3:]) for r in want)["urn:page:3"] == (len(big), hashlib.sha1(big.encode()).hexdigest())
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_paths(spark, tmp_path):
    """Folders and lists of files, with commas in their names."""
    folder = tmp_path / "a,b"
    folder.mkdir()
    for name in ("x,1.warc.gz", "y.warc.gz"):
        (folder / name).write_bytes(b"".join(warc.encode_record(f"urn:{name}:{k}", None, b"text", hashlib.sha1(b"text").hexdigest(), None) for k in range(3)))
    (folder / "other.txt").write_text("WARC/1.0")
    assert warc.read_warc(spark, f"file://{folder}", split_bytes=50).count() == 6
    assert warc.read_warc(spark, [f"file://{folder}/x,1.warc.gz"]).count() == 3
    assert warc.read_warc(spark, []).count() == 0


def test_warc_rejects_false_magic():
    good = warc.encode_record("urn:x", "http://x/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    fake = zlib.compress(b"not a record")
    other = warc.MAGIC + b"\x00" * 20
    data = other + good + fake + warc.MAGIC + good

    class Stream:
        def read_at(self, n, at):
            return io.BytesIO(data[at : at + n]).read()

    for cut in range(0, len(data), 7):
        found = [o for lo, hi in ((0, cut), (cut, len(data))) for o, _ in warc.scan(Stream(), len(data), lo, hi)]
        assert found == [len(other), len(data) - len(good)]


# URL filters


def test_url_filter(spark):
    import datetime as dt

    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = [("h", "a.example.com", "add", d(5)), ("h", "a.example.com", "remove", d(40)), ("h", "a.example.com", "add", d(90)), ("d", "example.com", "add", d(30)), ("f", "b.org/x/", "add", d(0)), ("f", "b.org/x/", "remove", d(0)), ("f", "b.org/x/y/", "add", d(1)), ("h", "a.example.com", "add", d(5)), (None, "c", "add", d(0)), ("h", None, "add", d(0))]
    urls = ["http://a.example.com/q", "https://A.example.com:80/x/y/z", "http://example.com", "http://b.org/x/y/file", "http://b.org/x/yy", "http://ab.org/", None, "nonsense"]
    caps = [(u, d(n)) for u in urls for n in (0, 4, 5, 29, 30, 39, 40, 89, 90, 200)] + [(urls[0], None), (urls[0], d(5))]
    df = spark.createDataFrame(caps, "url string, fetched_on date").withColumn("key", F.lit(1)).withColumn("lists", F.lit("old"))
    got = urlfilter.filter_urls(df, spark.createDataFrame(entries, "list string, key string, action string, on_date date")).collect()
    live = [("h", "a.example.com", 5, 40), ("h", "a.example.com", 90, 9999), ("d", "example.com", 30, 9999), ("f", "b.org/x/y/", 1, 9999)]

    def brute(u, on):
        if u is None or on is None or "://" not in u:
            return 0, None
        rest = u.split("://")[1]
        host = rest.split("/")[0].split(":")[0].lower()
        path = "/" + rest.split("/", 1)[1] if "/" in rest else ""
        n = (on - d(0)).days
        hits = [(li, k) for li, k, lo, hi in live if lo <= n < hi and ((host + path).startswith(k) if "/" in k else host == k or host.endswith("." + k))]
        return len(hits), (min(hits, key=lambda h: (-len(h[1]), h[1]))[1] if hits else None)

    assert len(got) == len(caps)
    for r in got:
        assert (r["n_active"], r["matched_key"]) == brute(r["url"], r["fetched_on"]), r
        assert r["blocked"] == (r["n_active"] > 0) and r["key"] == 1
    none = urlfilter.filter_urls(df, spark.createDataFrame([], "list string, key string, action string, on_date date"))
    assert none.where("blocked").count() == 0 and none.count() == len(caps)


@pytest.mark.parametrize(
    "url,blocked",
    [
        ("http://b.org/x/f", True), ("HTTP://b.org/x/f", True), ("Https://B.ORG/x/f", True), ("http://user:pw@b.org/x/f", True), ("http://a@c@b.org:8080/x/f", True),
        ("http://b.org./x/f", True), ("http://b.org../x/f", True), ("git+ssh://b.org/x/f", True), ("http://b.org/X/f", False), ("http://b.org@c.org/x/f", False),
        ("http://b.org.evil.com/x/f", False), ("http://c.org/?u=http://b.org/x/f", False), ("http://c.org/#@b.org/x/f", False), ("b.org/x/f", False), ("http:///x/f", False),
        ("http://[::1]:80/x/f", False), ("http://b.org/x/" + "deep/" * 20_000, True), ("http://" + "b." * 50_000 + "org/x/f", False),
    ],
)
def test_url_forms(spark, url, blocked):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    got = urlfilter.filter_urls(spark.createDataFrame([(url, day)], "url string, fetched_on date"), spark.createDataFrame([("f", "b.org/x/", "add", day)], "list string, key string, action string, on_date date"))
    assert got.first()["blocked"] == blocked


def test_url_forms_in_sql(spark, tmp_path):
    """The query and its SQL agree on hosts written in unusual ways."""
    import duckdb

    from lexiloom.llm import queries

    urls = ["http://Site1.example/fr/a", "HTTP://u:p@site1.example/fr/b", "http://site1.example./fr/", "http://site1.example:80/fr/x/y", None, "no url", "http://" + "x." * 200 + "org/", "http://[::1]/fr/a", "ftp://sub.site1.example/"]
    rows = [(i, urls[i % len(urls)], None) for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    compare.same_rows(queries.op2_url_filter(spark, str(tmp_path)), con, queries.OP2_SQL)


# vectors


def vectors_of(spark, x, ids=None, labels=None):
    n = len(x)
    rows = [(int(ids[i]) if ids is not None else i, [float(v) for v in x[i]], int(labels[i]) if labels is not None else 0) for i in range(n)]
    bad = [(9001, None, 0), (9002, [0.0] * x.shape[1], 0), (9003, [float("nan")] + [1.0] * (x.shape[1] - 1), 0), (9004, [None] + [1.0] * (x.shape[1] - 1), 0), (9005, [float("inf")] + [1.0] * (x.shape[1] - 1), 0), (9006, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).withColumn("rank", F.lit(0))


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:260] = x[200]  # ties
    got, read = collections.defaultdict(list), {}
    for r in ann.nearest(vectors_of(spark, x), "vec_id % 20 = 0", k=10, report=read).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    y = x.astype(float)
    for q in range(0, 1500, 20):
        s = (y * y[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s[i] - v) < 1e-9 for _, i, v in mine)
        assert [i for _, i, _ in mine] == sorted((i for _, i, _ in mine), key=lambda i: (-s[i], i))
        hit += len({i for _, i, _ in mine} & set(order))
    assert hit / (75 * 10) >= 0.9
    assert read["parts"] == 10 and read["parts_a_query"] < 10 and read["share_of_rows_read"] < 0.9  # by parts, not by reading all
    few = ann.nearest(vectors_of(spark, x[:4]), "true", k=10)
    assert few.count() == 12
    assert ann.nearest(vectors_of(spark, x[:1]).limit(0), "true").count() == 0


def test_vector_duplicates(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base, base[:20] + 0.2 * rng.normal(size=(20, 32)), np.repeat(base[:1], 40, 0) + 0.15 * rng.normal(size=(40, 32)), np.repeat(base[1:2], 9, 0), base[2:3] * 3]).astype(np.float32)
    labels = rng.integers(0, 2, len(x))
    ids = rng.permutation(len(x))
    df = vectors_of(spark, x, ids, labels).union(spark.createDataFrame([(7000, [1.0] * 32, None), (7001, [1.0] * 32, None)], "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("c")).withColumn("rank", F.lit(0)))
    got = {r["vec_id"]: r for r in vecdedup.near_duplicates(df).collect()}
    assert len(got) == len(x) + 8
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    group = minhash._groups(link)
    for i in range(len(x)):
        want = int(ids[group == group[i]].min())
        r = got[int(ids[i])]
        assert (r["n_links"], r["component_id"], r["kept"]) == (int(link[i].sum()), want, want == ids[i])
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (7000, 7001, 9001, 9002, 9003, 9004, 9005, 9006))
    assert vecdedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_several_dimensions(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.1, 0.0], 0), (3, [0.0, 1.0, 0.0], 0), (10, [1.0, 2.0], 0), (11, [1.0, 2.0], 0), (12, [2.0, 4.0], 1), (20, [3.0], 0), (20, [3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vecdedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (10, 1, 10), (11, 1, 10), (12, 0, 12), (20, 1, 20), (20, 1, 20)]
    near = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, "vec_id % 10 = 0").collect())
    assert near == [(10, 1, 12, 10.0), (10, 2, 11, 5.0)]


def test_wide_keys_lose_no_link(spark, monkeypatch):
    """Keys as for labels of 2^21 vectors."""
    plan = vecdedup.plan
    monkeypatch.setattr(vecdedup, "plan", lambda threshold, largest: plan(threshold, 1 << 21))
    assert plan(0.93, 1 << 21)[0] == 24 and plan(0.93, 1 << 40)[0] == 30
    rng = np.random.default_rng(19)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {(r["n_links"], r["component_id"]) for r in vecdedup.near_duplicates(df).collect()} == {(1, i) for i in range(40)}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.normal(size=(40, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    turn = vecdedup.rotations(64, 2)
    codes, factor, _ = vecdedup.encode(x, turn, 8, 8)
    bound = vecdedup.upper_bounds(q @ turn[:, :64], codes, factor)
    true = q @ x.T
    slack = vecdedup.SIGMAS * np.sqrt((1 - factor**2) / factor**2 / 63)
    assert abs((bound - slack[None] - true).mean()) < 0.005
    assert (bound >= true).mean() > 0.9999
