import base64
import math
import os
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from kelpie.llm import distinctive, leaks, lookalike, nearcopies, neighbours, sentences, tokens
from kelpie.llm.queries import oracle_sql, queries
from tests.test_oracles import compare

WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, data, name):
    compare(spark, duck, data, queries()[name], oracle_sql()[name])


def texts_frame(spark, rows):
    """(id, text) with other columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "clash", 7, "x") for i, t in rows], "id long, text string, term string, c int, form string")


# --- nearest vectors


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "key string, vec array<float>")


def brute_nearest(rows, k, dim):
    ok = {(key, tuple(v)) for key, v in rows if key is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    keys = sorted(ok)
    x = np.array([v for _, v in keys], np.float32).astype(np.float64).reshape(-1, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a, (key, _) in enumerate(keys):
        s = np.round(x @ x[a], 6)
        out[key] = [n for _, n in sorted((-s[b], keys[b][0]) for b in range(len(keys)) if keys[b][0] != key)[:k]]
    return out


def test_neighbours_of_a_small_collection(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 8)).astype(np.float32)
    rows = [(f"k{i}", base[i % 12].tolist()) for i in range(12)]
    rows += [(f"dup{i:03}", base[0].tolist()) for i in range(40)]  # one vector with many keys
    rows += [(f"scaled{i}", (base[1] * (i + 2)).tolist()) for i in range(3)]
    rows += [("k3", base[3].tolist())] * 3  # repeated rows
    rows += [(None, base[2].tolist()), ("null", None), ("empty", []), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [float("nan")] + [1.0] * 7), ("inf", [float("inf")] + [1.0] * 7), ("hole", [None] + [1.0] * 7)]
    got = defaultdict(list)
    for r in neighbours.nearest(vector_frame(spark, rows), 5, 8).orderBy("key", F.desc("similarity"), "neighbour").collect():
        got[r.key].append(r.neighbour)
    assert dict(got) == brute_nearest(rows, 5, 8)


def test_neighbours_edge_tables(spark):
    assert neighbours.nearest(vector_frame(spark, []), 5, 8).count() == 0
    one = neighbours.nearest(vector_frame(spark, [("a", [1.0] * 8)]), 5, 8)
    assert one.count() == 0
    two = neighbours.nearest(vector_frame(spark, [("a", [1.0] * 8), ("b", [2.0] * 8)]), 5, 8).collect()
    assert {(r.key, r.neighbour, r.similarity) for r in two} == {("a", "b", 1.0), ("b", "a", 1.0)}


@pytest.mark.parametrize("most", [256, 4])
def test_learned_parts_reach_the_recall(spark, monkeypatch, most):
    monkeypatch.setattr(neighbours, "BLOCK", 150)  # parts of several blocks too
    monkeypatch.setattr(neighbours, "MOST_PARTS", most)  # with few parts a level, two levels
    assert len(neighbours.levels_for(3000, 200, most)) == (1 if most == 256 else 2)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 16))
    x = (np.repeat(centres, 20, 0) + 0.25 * rng.standard_normal((3000, 16))).astype(np.float32)
    rows = [(str(i), v.tolist()) for i, v in enumerate(x)]
    truth = {(a, b) for a, near in brute_nearest(rows, 5, 16).items() for b in near}
    found = {(r.key, r.neighbour) for r in neighbours.nearest(vector_frame(spark, rows), 5, 16, part_size=200, sample=1500).collect()}
    assert len(found & truth) / len(truth) >= 0.9


def test_parts_are_balanced():
    x = neighbours.unit(np.random.default_rng(0).standard_normal((1000, 8)))
    sizes = np.bincount(neighbours.balanced_parts(x, 16))
    assert sizes.min() >= 60 and sizes.max() <= 65


def test_packing_is_lossless():
    x = np.random.default_rng(0).standard_normal((50, 8)).astype(np.float32)
    x[::2] = x[::2].astype(np.float16)
    assert (neighbours.unpacked(neighbours.packed(x), 8) == x).all()


# --- near copies


def made_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 90))] for _ in range(n)]
    rows = [" ".join(b) for b in base]
    for b in base[: n // 2]:
        c = list(b)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(c))
            c[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        rows.append(" ".join(c[20:] + c[:20] if rng.random() < 0.3 else c))
    return rows


def brute_copies(rows, s, least):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None and len(t) >= least:
            w = WORD.findall(t.lower())
            g = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
            if g:
                sets[i] = g
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize(("hot", "block"), [(64, 8192), (3, 4)])
def test_near_copies_equal_all_pairs(spark, hot, block):
    rows = list(enumerate(made_texts(60, 5)))
    boiler = " ".join(f"boiler{i}" for i in range(45))  # triples that many texts share
    rows += [(1000 + i, boiler + " " + " ".join(f"own{i}x{k}" for k in range(20 + i))) for i in range(12)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (0, rows[0][1]), (2002, None), (2003, ""), (None, rows[0][1]), (2004, "word " * 60), (2005, "word " * 61), (2006, "x" * 300), (2007, "一二三。四五六。七八九。" * 30)]
    got = {(r.id_a, r.id_b) for r in nearcopies.near_copy_pairs(texts_frame(spark, rows), hot=hot, block=block).collect()}
    assert got == brute_copies(rows, 0.5, 200)


@pytest.mark.parametrize(("hot", "block"), [(64, 8192), (3, 4)])
def test_groups_of_near_copies(spark, hot, block):
    rows = list(enumerate(made_texts(40, 9)))
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(600, None), (601, "short"), (500, rows[3][1])]
    pairs = brute_copies(rows, 0.5, 200)
    sets = lookalike.UnionFind()
    for a, b in pairs:
        sets.join(a, b)
    groups = defaultdict(set)
    for x in {i for pair in pairs for i in pair}:
        groups[sets.find(x)].add(x)
    want = {i: (min(g), sum(i in pair for pair in pairs)) for g in groups.values() for i in g}
    got = {r.id: (r.group, r.links) for r in nearcopies.near_copy_groups(texts_frame(spark, rows), hot=hot, block=block).collect()}
    assert got == want
    assert nearcopies.near_copy_groups(texts_frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    sets = lookalike.UnionFind()
    for a, b in edges:
        sets.join(a, b)
    least = {}
    for x in sorted({i for e in edges for i in e}):
        least.setdefault(sets.find(x), x)
    want = {x: least[sets.find(x)] for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in nearcopies.components(df).collect()} == want


def test_near_copies_with_saturated_buckets(spark, monkeypatch):
    count = nearcopies.count_tables
    rows = list(enumerate(made_texts(30, 6)))
    for full in (128, 255):
        monkeypatch.setattr(nearcopies, "count_tables", lambda texts, buckets, full=full: (count(texts, buckets)[0], np.full(buckets, full, np.uint8)))
        got = {(r.id_a, r.id_b) for r in nearcopies.near_copy_pairs(texts_frame(spark, rows)).collect()}
        assert got and got == brute_copies(rows, 0.5, 200)


def test_near_copies_of_nothing(spark):
    assert nearcopies.near_copy_pairs(texts_frame(spark, [])).count() == 0
    assert nearcopies.near_copy_pairs(texts_frame(spark, [(1, None), (2, "short")])).count() == 0


def test_pivot_table_never_discards_a_true_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, 90)), np.unique(rng.choice(pool, 90))
        both = len(np.intersect1d(a, b))
        alike = both >= 0.3 * (len(a) + len(b) - both)
        da, db = nearcopies.distances(a), nearcopies.distances(b)
        passes = nearcopies.may_be_alike(da, db, len(a), len(b), 0.3)
        member = lambda x, k: int((x % nearcopies.CLASSES == k).sum())
        size = 1 << 20  # a reference's own bits, as many in each class
        assert [len(a) + size - 2 * member(a, k) for k in range(3)] == [int(x) + size for x in da[:3]]
        worst = int(nearcopies.unions_differ(da, db, len(a), len(b)))
        ca, cb = (len(a) - da) // 2, (len(b) - db) // 2
        greatest = 0
        for union in (*rng.integers(0, 2, (20, nearcopies.CLASSES)), (ca > cb).astype(int), (ca < cb).astype(int)):
            r = union.sum() * size
            greatest = max(greatest, abs((len(a) + r - 2 * (ca * union).sum()) - (len(b) + r - 2 * (cb * union).sum())))
        assert greatest == worst <= len(a) + len(b) - 2 * both  # the closed form is the maximum over all unions
        assert passes or not alike


# --- distinctive terms


def brute_distinctive(rows):
    df, found, seen = Counter(), [], set()
    for i, t in set(rows):
        if t is None or not t.strip():
            continue
        seen.add(i)
        tf = Counter(WORD.findall(t.lower()))
        df.update(tf.keys())
        found += [(i, w, n) for w, n in tf.items()]
    total = len(seen)
    bar = (1 + math.log(3)) * math.log(total / 5.5)
    return {(i, w) for i, w, n in found if n >= 2 and len(w) >= 3 and (1 + math.log(n)) * math.log(total / df[w]) >= bar - 1e-9}


def test_standing_out(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["common", "words", "only", "here"]) for _ in range(20)) + f" rare{i % 40} " * rng.randint(0, 4)) for i in range(300)]
    rows += [(900, "Ünïque ünïque ünïque"), (901, None), (902, " \n "), (903, ""), (904, "ab ab ab ab"), (905, "lone lone lone"), (905, "lone lone lone")]
    got = {(r.id, r.term) for r in distinctive.standing_out(texts_frame(spark, rows)).collect()}
    assert got == brute_distinctive(rows) and (900, "ünïque") in got
    assert distinctive.standing_out(texts_frame(spark, [])).count() == 0
    assert distinctive.standing_out(texts_frame(spark, [(1, None)])).count() == 0


def test_one_long_record_hides_no_case(spark):
    rows = [(i, "filler") for i in range(3000)]
    rows[0], rows[1] = (0, "rare " * 3), (1, "rare " * 40)
    rows[2:7] = [(i, "seldom " * n) for i, n in zip(range(2, 7), (3, 3, 3, 3, 200))]
    got = {(r.id, r.term) for r in distinctive.standing_out(texts_frame(spark, rows)).collect()}
    assert got == brute_distinctive(rows) == {(0, "rare"), (1, "rare"), *((i, "seldom") for i in range(2, 7))}


def test_the_bar_alone_decides(spark, monkeypatch):
    """Also in collections so small that a term of all records reaches the bar, whatever a mixture would say of its counts."""
    small = [[(i, "aaa " * (50 if i == n - 1 else 2)) for i in range(n)] for n in (1, 2, 3, 5, 6)]
    for rows in small:
        scored = distinctive.term_scores(texts_frame(spark, rows), (3, 5.5), least_tf=2, least_chars=3).collect()
        assert {(r.id, r.term) for r in scored} == brute_distinctive(rows)
        assert all(r.score >= 0.5 - 1e-9 and (r.tf, r.df) == (len(dict(rows)[r.id].split()), len(rows)) for r in scored)

    def unwanted(*_, **__):
        raise AssertionError("a fit that decides nothing")

    monkeypatch.setattr(distinctive, "fit_two_poisson", unwanted)
    for rows in small:
        got = distinctive.standing_out(texts_frame(spark, rows))
        assert got.columns == ["id", "term"] and {tuple(r) for r in got.collect()} == brute_distinctive(rows)
        assert got.count() == (len(rows) if len(rows) < 6 else 0)


def test_scores_separate_the_elite(spark):
    """Counts drawn from two Poissons: the fit recovers them, and the posterior ranks a term's occurrences by count."""
    rng = np.random.default_rng(0)
    draws = np.where(rng.random(20000) < 0.1, rng.poisson(6, 20000), rng.poisson(0.2, 20000))
    counts, times = np.unique(draws[draws > 0], return_counts=True)
    weight, high, low = distinctive.fit_two_poisson(counts[None].astype(float), times[None].astype(float), 20000.0, rounds=200)
    assert weight[0] == pytest.approx(0.1, abs=0.02) and high[0] == pytest.approx(6, abs=0.4) and low[0] == pytest.approx(0.2, abs=0.05)
    post = distinctive.elite_posterior(np.arange(8.0), weight, high, low)
    assert (np.diff(post) > 0).all() and post[1] < 0.1 and post[6] > 0.99
    rows = [(i, "everywhere " + ("burst " * 6 if i % 10 == 0 else "burst" if i % 10 < 3 else "")) for i in range(200)]
    scored = {(r.id, r.term): r.score for r in distinctive.scored_terms(texts_frame(spark, rows)).collect()}
    assert len(scored) == sum(len(set(t.split())) for _, t in rows)
    assert scored[(0, "burst")] > 0.99 > 0.5 > scored[(1, "burst")]


def test_counts_at_the_bar_always_belong_to_the_elite():
    rng = np.random.default_rng(1)
    for total in (30, 3000, 30_000, 10**9):
        times = rng.integers(0, 5, (400, 12)).astype(float)
        times[:, 0] += rng.integers(0, max(2, min(total // 3, 10**6)), 400)
        counts = np.sort(np.concatenate([rng.integers(1, 6, (400, 6)), 2 ** rng.integers(0, 12, (400, 6))], 1).cumsum(1), 1).astype(float)
        df = np.minimum(times.sum(1), total)
        need = distinctive.tfidf_bar(total)
        bar = distinctive.least_count(df, total, need)
        at = np.isfinite(bar)
        assert ((1 + np.log(bar[at])) * np.log(total / df[at]) >= need - 1e-6).all()
        assert ((bar[at] == 2) | ((1 + np.log(np.maximum(bar[at] - 1, 1))) * np.log(total / df[at]) < need)).all()
        weight, high, low = distinctive.fit_two_poisson(counts, times, float(total), elite=bar)
        for more in (0, 1, 10, 1000):
            assert (distinctive.elite_posterior(bar[at] + more, weight[at], high[at], low[at]) >= 0.5 - 1e-9).all()


# --- texts that look the same


SAME = [
    ("Offset ﬁle", "Offset file"), ("ＡＢ１：ｘ", "AB1:x"), ("café", "café"), ("paypal", "pаypаl"), ("a b", "a b"), ("a b", "a　b"), ("word", "w​o­rd﻿"), ("Å", "Å"),
    ("5 µm", "5 μm"), ("ё", "ё"), ("ﬃ", "ffi"), ("SOS", "ЅОЅ"), ("éx", "e‍́x"), ("ｶﾞ", "ガ"), ("Ethan", "Ethаn͏"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("m2", "m²"), ("a  b", "a b"), ("a\nb", "a b"), ("a-b", "a–b"), ("1", "l"), ("0", "O"), ("x.", "x"), ("10", "1O")]


def test_looks(spark):
    rows, same, different = [], set(), set()
    for k, (a, b) in enumerate(SAME):
        rows += [(10 * k, f"{k}: {a}"), (10 * k + 1, f"{k}: {b}")]
        same.add((10 * k, 10 * k + 1))
    for k, (a, b) in enumerate(DIFFERENT):
        rows += [(1000 + 10 * k, f"{k}; {a}"), (1001 + 10 * k, f"{k}; {b}")]
    rows += [(5000, None), (5001, ""), (5002, "​"), (5003, "﻿"), (0, rows[0][1]), (5004, rows[0][1])]
    got = {(r.id_a, r.id_b) for r in lookalike.look_same(texts_frame(spark, rows)).collect()}
    assert got == same | {(1, 5004)} | different
    assert lookalike.look_same(texts_frame(spark, [])).count() == 0
    forms = {r.id: r.canonical for r in lookalike.canonical_text(texts_frame(spark, rows)).dropDuplicates(["id"]).collect()}
    assert forms[5000] is None and forms[5001] == "" and forms[0] == forms[1]
    links = Counter(i for pair in got for i in pair)
    classes = {r.id: (r["class"], r.links) for r in lookalike.look_classes(texts_frame(spark, rows)).collect()}
    assert {i: n for i, (_, n) in classes.items()} == links and all(classes[a][0] == classes[b][0] == min(a, classes[a][0]) for a, b in got)


def test_letters_of_the_public_table(spark):
    groups = lookalike.lookalike_groups(spark)
    of = {c: k for k, g in enumerate(groups) for c in g}
    for a, b in ("AА", "DᎠ", "FϜ", "RᎡ", "UՍ", "bЬ", "rг", "oο", "eе", "TТ", "BΒ", "k𝐤", "t𝑡", "Lꓡ", "IІ", "SᏚ", "XꓫΧ"[:2]):
        assert of[a] == of[b], (a, b)
    for a, b in ("Il", "Oo", "Оо", "Сс", "fſ", "iı"):
        assert of.get(a) is None or of.get(a) != of.get(b), (a, b)
    rewrite = lookalike.Rewriter(lookalike.representatives({}, groups))
    assert rewrite("Пaсcword") == rewrite("Пасcwоrd") and rewrite("𝐬𝐚𝐦𝐞") == rewrite("same") and rewrite("Case") != rewrite("case")


def test_representatives_follow_frequency_and_are_stable(spark):
    groups = lookalike.lookalike_groups(spark)
    few = lookalike.representatives({"а": 9, "a": 3}, groups)
    assert few["a"] == "а" and "а" not in few
    for counts in ({}, {"а": 9, "ﬁ": 50, "f": 1}, {"　": 4}):
        rewrite = lookalike.Rewriter(lookalike.representatives(counts, groups))
        for a, b in SAME:
            assert rewrite(a) == rewrite(b) == rewrite(rewrite(a)), (a, b, counts)
        for a, b in DIFFERENT:
            assert rewrite(a) != rewrite(b)


# --- token ids


have_tokenizers = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json")), reason="no vocabulary files")


@have_tokenizers
def test_ids_and_back(spark):
    texts = ["Hello world", "", None, " \n\t", "naïve café 👩‍🔬 ‍", "<|endoftext|>", "日本語" * 50, "a" * 30000, "\u0000x"]
    df = texts_frame(spark, list(enumerate(texts)))
    got = {r.id: r for r in tokens.encode(df, "id", offsets=True).collect()}
    assert len(got) == len(texts) and got[1].ids == [] == got[2].ids and 50256 not in got[5].ids
    back = {r.id: r.text for r in tokens.decode(tokens.encode(df, "id"), "id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    r = got[4]
    assert r.starts[0] == 0 and r.ends[-1] == len(texts[4]) and all(a < b for a, b in zip(r.starts, r.ends)) and r.starts == sorted(r.starts)
    cut = spark.createDataFrame([(1, tokens.tokenizer(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json")).encode("é🙂").ids[:-1])], "id long, ids array<int>")
    assert "�" in tokens.decode(cut, "id").first().text
    assert tokens.encode(texts_frame(spark, []), "id").count() == 0


@have_tokenizers
def test_ids_equal_the_rank_file(spark, data):
    tiktoken = pytest.importorskip("tiktoken")
    import sys

    sys.path.insert(0, os.path.dirname(os.path.realpath(tokens.TOKENIZER_DIR)))
    import public_tokenizers as public

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: encoding.encode_ordinary(r.text or "") for r in rows.collect()}
    assert {r.doc_id: r.ids for r in tokens.encode(rows).collect()} == want


# --- leaks


def brute_leaks(docs, items):
    def norm(t):
        return unicodedata.normalize("NFC", regex.sub(r"[\p{Cf}]", "", t)).casefold()

    out = set()
    for i, t, lang in items:
        if not t:
            continue
        zh = lang == "zh"
        n, find = (24, r"[\p{L}\p{N}]") if zh else (12, r"[\p{L}\p{N}\p{M}]+")
        w = regex.findall(find, norm(t))
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, x in docs:
            v = regex.findall(find, norm(x)) if x else []
            if any(tuple(v[k : k + n]) in runs for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 40))), rng.choice(["en", None])) for i in range(20)]
    items += [(50, None, "en"), (51, "", "en"), (52, "汉字测试" * 10, "zh"), (0, items[0][1], items[0][2])]
    docs = []
    for d in range(60):
        filler = [rng.choice(vocabulary) for _ in range(80)]
        w = items[d % 20][1].split()
        at = rng.randrange(max(1, len(w) - 8))
        part = w[at : at + rng.randint(8, 16)]
        text = " ".join(filler[:40]) + " **" + "*, \n".join(part).upper() + "** " + " ".join(filler[40:])
        docs.append((d, unicodedata.normalize("NFD", text) if d % 2 else text.replace("w1", "w​1")))
    docs += [(100, None), (101, ""), (102, "前 " + "汉字，测试" * 7), (103, "汉字测试" * 5), (104, "x " * 20000 + items[3][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, lang string, doc_id int")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(d, e).collect()} == brute_leaks(docs, items)
    assert leaks.leaked(d.limit(0), e).count() == 0 == leaks.leaked(d, e.limit(0)).count()
    row = leaks.aligned(d, e).where("doc_id = 104 and item_id = 3").first()
    assert row.share == 1.0 and row.longest_run == len(items[3][1].split())


def test_letters_of_an_item_without_chinese_ones(spark):
    latin = "transformerarchitecturescale"
    items = spark.createDataFrame([(1, "我们讨论 " + latin + " 的效果", "zh"), (2, "短文" * 4, "zh")], "item_id long, text string, lang string")
    docs = spark.createDataFrame([(1, f"We study {latin}."), (2, f"We study 的 {latin}."), (3, "We study transformer scale.")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items).collect()} == {(1, 1), (2, 1)}


def test_edited_copies(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(8 if i < 3 else 40)), "en") for i in range(6)] + [(9, "three words only", "en"), (10, None, "en")]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [(100 + i, " ".join(filler(50) + t.split() + filler(50))) for i, t, _ in items if t]
    w = items[4][1].split()
    docs.append((200, " ".join(filler(3000) + [x for k, x in enumerate(w) if k % 9 != 4] + filler(30))))  # a word in nine is gone
    docs.append((201, " ".join(filler(20) + [x if k % 6 else "other" for k, x in enumerate(w)])))  # a word in six is another
    docs.append((202, " ".join(w[:9] + filler(60))))  # a quarter of it
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, lang string")
    got = {(r.doc_id, r.item_id): r.share for r in leaks.edited_copies(d, e).collect()}
    assert set(got) == {(100 + i, i) for i in range(6)} | {(200, 4), (201, 4)}
    assert got[100, 0] == 1.0 and 0.8 < got[200, 4] < 0.9 and 0.6 < got[201, 4] < 0.8
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(d, e).collect()} == {(103, 3), (104, 4), (105, 5)}


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint64)) for _ in range(60)]
    score, longest = leaks.align(pairs)
    for (a, b), s, n in zip(pairs, score, longest):
        h, run = np.zeros((len(a) + 1, len(b) + 1)), np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                h[i, j] = max(0, h[i - 1, j - 1] + (leaks.MATCH if same else leaks.MISMATCH), h[i - 1, j] + leaks.GAP, h[i, j - 1] + leaks.GAP)
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        assert s == h.max() and n == run.max()


# --- sentences


CUT = [
    ["Title of it", "\n\n", "He met Dr. Smith at 6:03 p.m.", " ", "They left, etc.", " ", "No. 9 cost 3.5 km.", "  ", "26,059 of them stayed."],
    ["“Is it so?” asked Ann near the door.", " ", "The note said “stop! Ask Tom.” and ended.", " ", '"Wait. It broke," the log said.'],
    ["It ran! 🙂", " ", "(It stopped at 5 p.m.)", " ", "Then J. R. Vena saw i.e. the end… ", "Done?!", "\n\n", "- a list mark", "\n \n", "(2) Another one."],
    ["Am 7. Mai 2013 verwirft die Strömung etwa 82 Einträge z. B. in Plum.", " ", "Laut Prof. Dr. Rurish prüft die Tabelle (vgl. Abb. 6) ca. 13 Läufe."],
    ["Selon M. Vath hier, la clé (cf. p. 6) mesure 34,2 kg.", " ", "« La clé réduit tout. Demandez à Vaun\xa0! » écrivit M. Vath hier.", " ", "Qui gêne la clé\xa0?"],
    ["«¿Es única la montaña?», preguntó la Sra. Leinar.", " ", "Según el núm. 18, la señal p. ej. mide."],
    ["В 1961 г. Миленску проверяет набор с 2011 г. до 1999 г.", " ", "Узкая метка в г. Жувато и т. п. для всех."],
    ["椿霁岚写道：“队列测量了一切。请问屿柯莳！”然后离开了霁穗穗。", "", "“旧的光谱在哪里？”苓椿苓问柯棠澜。", "", "约25.4GB！"],
    ["ルミナは「文書を測った。ナミドに聞いて。」と書いてミカキを去った。", "", "古い測定。"],
    ["डॉ. सुलेरे ने लिखा, “भंडार ठीक है। पूछो।” और वह चला गया है।", " ", "नदी 34.2 kg है।"],
    ["كتب د. باجي «نهر يغير كل شيء. اسألوا.» ثم غادر.", " ", "هل يؤخر جدول كل سجل؟", " ", "مصدر قديم."],
    ["1. ในปี1988สะพานวัดประมาณ4\xa0213แถว", " ", "ตารางเล็กเขียนว่า“สะพาน เปลี่ยน”แล้วกลับบ้าน"],
    ["Κατά τον κ. Γιβατο (βλ. σελ. 14), η πηγή κρατά.", " ", "Ποιος μειώνει;", " ", "«Όλα. Ρωτήστε», έγραψε."],
    ["ዜዶሱና «ገጽ ይለካል» ብሎ ጻፈ።", " ", "ለምን ይቆማል?", " ", "ትልቅ ገጽ።"],
]


@pytest.mark.parametrize("parts", CUT, ids=lambda p: p[0][:12])
def test_sentences(parts):
    text, want, at = "".join(parts), [], 0
    for k, p in enumerate(parts):
        if k % 2 == 0 or p.strip():
            a = at + len(p) - len(p.lstrip())
            want.append((a, at + len(p.rstrip())))
        at += len(p)
    want = [w for w in want if w[0] < w[1]]
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == [text[a:b] for a, b in want]


def test_every_rule_sees_the_whole_unit():
    parts = lambda t: [t[a:b] for a, b in sentences.sentence_spans(t)]
    assert parts("See fig." + " " * 90 + "3 for it. Next.") == ["See fig." + " " * 90 + "3 for it.", "Next."]
    assert parts("1." + "\t" * 40 + "One thing. Two.") == ["1." + "\t" * 40 + "One thing.", "Two."]
    assert parts("ราคา 10 500 บาท ต่อ “คำ คำ” ชิ้น") == ["ราคา", "10 500", "บาท", "ต่อ", "“คำ คำ”", "ชิ้น"]
    assert parts("1. ข้อ แรก\n2) ข้อ") == ["1. ข้อ", "แรก\n2) ข้อ"]


@pytest.mark.parametrize("blanks", [" ", " " * 30, "\n" + " " * 30, " " * 200])
def test_long_blanks_after_an_abbreviation(blanks):
    for text, n in ((f"We met Dr.{blanks}Smith in the town.", 1), (f"It was ok!{blanks}or so they said to the man.", 1), (f"It is the end.{blanks}And the start.", 2)):
        assert len(sentences.sentence_spans(text)) == n


def test_positions_with_invisible_and_decomposed_characters():
    text = "﻿​Café a­b.​ ⁠Next öne​!​\n"
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == ["Café a­b.", "Next öne​!"]


def test_sentence_spans_cover_all_visible_text(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = defaultdict(list)
    for r in sentences.sentences(spark.read.parquet(f"{data}/documents.parquet")).collect():
        got[r.doc_id].append((r.start_pos, r.end_pos))
    for r in rows:
        spans = sorted(got[r.doc_id])
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        covered = {k for a, b in spans for k in range(a, b)}
        assert all(not sentences._visible(c) or k in covered for k, c in enumerate(r.text or ""))


def test_no_sentences(spark):
    for t in (None, "", " \n ​\n\n"):
        assert sentences.sentence_spans(t) == []
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "One. Two.", 1), (None, "x", 1)], "doc_id long, text string, start_pos int")
    assert sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in sentences.sentences(df).collect()) == [(0, 0, 1), (3, 0, 4), (3, 5, 9)]
    assert sentences.sentences(df.limit(0)).count() == 0
    long = "A sentence of words. " * 20000
    assert len(sentences.sentence_spans(long)) == 20000
