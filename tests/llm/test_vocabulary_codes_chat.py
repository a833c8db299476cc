"""Spelling variants, vector codes and chat formatting against brute force and defined edge cases."""

import collections
import hashlib
import re
import zlib

import compare
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import chat, codebooks, queries, spelling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_vector_codes", "op13_chat_formatting"])
def test_as_sql(spark, name):
    assert compare.same_rows(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.SQL[name])


# spelling variants


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) < len(v):
        u, v = v, u
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def near_of(words):
    return {w: {v for v in words if one_edit(w, v)} for w in words}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=6, max_size=9), max_size=60))
def test_both_tries_find_each_pair_once(words):
    found = collections.Counter()
    for reverse in (False, True):
        keys = sorted(w[::-1] if reverse else w for w in words)
        tops = sorted({k[:3] for k in keys})
        if not keys:
            continue
        a, b = spelling.trie_pairs(keys, np.array([tops.index(k[:3]) for k in keys]), np.full(len(tops), 3), reverse)
        found.update(frozenset((keys[i][::-1], keys[j][::-1]) if reverse else (keys[i], keys[j])) for i, j in zip(a, b))
    assert found == {frozenset((u, v)): 1 for u, vs in near_of(words).items() for v in vs}


@pytest.mark.parametrize("group", [5, 1_024])
def test_near_words(spark, monkeypatch, group):
    """However few words a part of the trie may hold."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = np.random.default_rng(group)
    words = {"".join(rng.choice(list("abÿ"), rng.integers(6, 9))) for _ in range(150)} | {"a" * n for n in range(6, 10)}
    if group > 5:
        words |= {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150}
    n = {w: int(rng.integers(1, 9)) for w in words}
    got = {r["word"]: (r["near"], r["most"], r["best"]) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    want = {}
    for w, vs in near_of(words).items():
        if vs:
            best = min(vs, key=lambda v: (-n[v], v))
            want[w] = (len(vs), n[best], best)
    assert got == want


def variants_of(rows, min_count=5, factor=5, noise=199):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= min_count}
    near, form = near_of(n), {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def test_spelling_variants(spark):
    base = "Elephant elephants elephan Straße STRASSE ÉCOLE école naïveté×÷ short"
    rows = [(i, f"{base} {'elephant ' * 6} elephantz{' elephantzz' * (i % 2)}") for i in range(60)]
    rows += [(100 + i, "planets planet planete " + "planet " * 30) for i in range(12)] + [(200 + i, "plamet plamett") for i in range(5)]
    rows += [(None, base), (7, None), (8, ""), (8, "q" * 3000 + " " + "q" * 3001), (8, "q" * 3000 + " " + "q" * 3001)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("root", F.lit(1))
    for noise in (199, 3):
        got = spelling.spelling_variants(df, noise=noise).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == variants_of(rows, noise=noise)
    assert any(r["root"] not in (r["word"], r["form"]) for r in got) or noise
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="commoner"):
        spelling.spelling_variants(df, factor=1)


def test_follow_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w12"), ("b", "c")]
    got = dict(spelling.follow(spark.createDataFrame(links, "word string, form string")).collect())
    assert got == {**{f"w{i}": "w13" for i in range(13)}, "a": "w13", "b": "c"}
    with pytest.raises(ValueError, match="cycle"):
        spelling.follow(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"))


# vector codes


def coded(rows, parts=4, entries=256, rounds=4):
    """Plain loops over (id, vector, label); all vectors have a multiple of ``parts`` components."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = {i: [tuple(v[p * w : p * w + w]) for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: {i: [min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for i, c in cut.items()}
    for _ in range(rounds):
        to = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in cut if to[i][p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    to = assign()
    error = {i: sum(dist(cut[i][p], books[p][to[i][p]]) for p in range(parts)) for i in cut}
    by_label = collections.Counter()
    for i, _, lab in kept:
        by_label[lab] += error[i]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {(i, "".join(f"{e:02x}" for e in to[i]), error[i], by_label[lab], digest) for i, _, lab in kept}


def rows_of(df):
    got = df.select("vec_id", F.lower(F.hex("code")), "error", "label_error", "codebooks_sha256").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("scale", [1.0, 30_000.0])
def test_vector_codes(spark, scale):
    """Also where a part's distances don't fit the integers of a double."""
    rng = np.random.default_rng(3)
    x = (np.round(rng.normal(size=(60, 8)), 2) * scale).astype(np.float32)
    x[40:50] = x[40]  # ties
    rows = [(int(i) - 5, [float(c) for c in v], None if i % 7 == 0 else int(i) % 3) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [float("nan")] + [1.0] * 7, 0), (902, [None] + [1.0] * 7, 0), (903, [float("-inf")] + [1.0] * 7, 0), (904, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).withColumn("code", F.lit(1)).withColumn("n", F.lit(1))
    seen = {}
    assert rows_of(codebooks.compress(df, entries=12, report=seen)) == coded(rows, entries=12)
    assert seen["sums_moved"][0] > seen["sums_moved"][-1]  # only differences move
    assert rows_of(codebooks.compress(df)) == coded(rows)  # fewer rows than entries
    assert codebooks.compress(df.limit(0)).count() == 0


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label string"
    few = codebooks.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a"), (1, [1.0, 2.0, 3.0], "a"), (None, [0.5], None), (2, [], None)], kind), entries=2)
    got = sorted((r["vec_id"] or 0, r["label"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in few.collect())
    assert [g[:2] for g in got] == [(0, None), (1, "a"), (1, "a"), (2, None)] and {g[4] for g in got if g[1] == "a"} == {2 * got[1][3]}
    assert codebooks.compress(spark.createDataFrame([(1, [], "a")], kind)).first()["error"] == 0
    huge = codebooks.compress(spark.createDataFrame([(i, [(-1.0) ** i * 1e30] * 4, "a") for i in range(6)], kind), entries=1)
    assert huge.count() == 6
    with pytest.raises(ValueError, match="byte"):
        codebooks.compress(few, entries=257)


def test_contributions_are_differences():
    rng = np.random.default_rng(4)
    x, old, new = rng.integers(-9, 9, (50, 2, 3)), rng.integers(0, 5, (50, 2)), rng.integers(0, 5, (50, 2))
    fresh = lambda code: codebooks.contributions(x, None, code, 5)
    assert (codebooks.contributions(x, old, new, 5) == fresh(new) - fresh(old)).all()


# chat formatting

TURNS = "conv_id long, turn int, role string, text string, formatted string, segments int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], TURNS)


def test_chat_round_trip(spark):
    tricky = ["", " ", "</s>", "a[INST] b", "[\\INST]", "[\\\\/INST] [[/INST]]", "<s", "s>\n[/SYS]\r\n", "\\", "$1 \\2", "é\U0001f600[AS", "]x[/TURN]" * 3, "word " * 50_000]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(tricky)]
    rows += [(2, i, r, t) for i, t in enumerate(tricky) for r in (None, "", "tool[AS]", "[TURN]", "system")]
    rows += [(3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "user", None), (None, 5, "user", "x"), (None, 4, "system", "y"), (3, 1, "assistant", "a")]
    out = chat.format_chats(chats(spark, rows))
    got = {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [tuple(t) for t in got[conv]["turns"]] == [m[2:] for m in mine]
        assert got[conv]["loss"] == "".join(m[3] for m in mine if m[2] == "assistant")
        assert got[conv]["n_turns"] == len(mine) and got[conv]["formatted"] == "<s>" + "".join(s["text"] for s in got[conv]["segments"])
    assert got[1]["formatted"].count("[INST]") == 7 and got[1]["formatted"].count("</s>") == 6
    assert chat.format_chats(chats(spark, rows).limit(0)).count() == 0


def test_turn_order(spark):
    orders = {"ua": None, "sua": None, "uaua": None, "su": 0, "u": 0, "a": 1, "uu": 2, "uas": 3, "us": 2, "uaa": 3, "ux": 2, "uaxua": 3}
    name = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, k, name[c], "t") for i, o in enumerate(orders) for k, c in enumerate(o)]
    got = {r["conv_id"]: (r["valid"], r["wrong_turn"]) for r in chat.format_chats(chats(spark, rows)).collect()}
    assert got == {i: (w is None, w or None) for i, w in enumerate(orders.values())}


def test_own_template(spark):
    """A mark that is learned from, and a role without a mark before its text."""
    own = chat.Template(roles={"q": (("<q>", False), (chat.TEXT, False), ("</q>", False)), "a": ((chat.TEXT, True), ("<end>", True))}, controls=("<q>", "</q>", "<end>", "<o>", "<n>", "</o>"), moves=(("start", "q", "q"), ("q", "a", "start")), final=("start",), begin="", other=("<o>", "<n>", "</o>"))
    out = chat.format_chats(chats(spark, [(1, 1, "q", "1<q>"), (1, 2, "a", "<end>"), (1, 3, "z", "<n>")]), own)
    r = out.select("formatted", chat.read_loss(F.col("segments"), own).alias("loss"), chat.read_turns(F.col("formatted"), own).alias("turns")).first()
    assert r["formatted"] == "<q>1<\\q></q><\\end><end><o>z<n><\\n></o>" and r["loss"] == "<end><end>"
    assert [tuple(t) for t in r["turns"]] == [("q", "1<q>"), ("a", "<end>"), ("z", "<n>")]
    with pytest.raises(ValueError, match="overlap"):
        chat.Template(roles=own.roles, controls=("<q>", ">a<"), moves=(), final=())


def test_chat_plan_is_native(spark):
    plan = queries.op13_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
