"""The ten operators against brute force on small tables, and their edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from segtide.llm import common, edit, embedding_dedup, language_id, line_dedup, mixing, near_dup, outliers, packing, quality_classifier, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that with from house water river mountain people garden window letter".split()
DE = "der die und das nicht mit von haus wasser fluss berg leute garten fenster brief zeit".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOC)


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j] + (x != y), p[j + 1] + 1, c[j] + 1))
        p = c
    return p[-1]


def components_of(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- toxicity


def test_automaton_is_the_edit_distance():
    rng = random.Random(1)
    terms = [toxicity.Term(w, 1.0, e) for w, e in (("idiot", 1), ("scum", 0), ("worthless", 2), ("moron", 1), ("scums", 1))]
    m = toxicity.compile_automaton(terms)
    words = [t.text for t in terms]
    for _ in range(1500):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            k, i = rng.random(), rng.randrange(len(w) + 1)
            if k < 0.4:
                w.insert(i, rng.choice("idotsxz"))
            elif w and k < 0.7:
                w.pop(min(i, len(w) - 1))
            elif w:
                w[min(i, len(w) - 1)] = rng.choice("idotsxz")
        words.append("".join(w))
    words = [w for w in words if w]
    buf, s, e = common.codes(words)
    final = toxicity.match_words(buf, s, e, m)
    for w, state in zip(words, final):
        near = min(((lev(w, t.text), t.text) for t in terms if lev(w, t.text) <= t.max_edits), default=None)
        got = (int(m.edits[state]), m.terms[m.accept[state]].text) if state else None
        assert got == near, w


def test_toxicity_tells_quotation_from_abuse(spark):
    m = toxicity.compile_automaton([toxicity.Term("idiot"), toxicity.Term("stupid")])
    long = "plain " * 60_000
    d = docs(spark, [(1, "you idi0t, what a stupid thing", "en", "s"), (2, 'he said "idiot" is an insulting word', "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (5, long + "you IDIOT", "en", "s"), (6, "clean words", "en", "s"), (1, "you idi0t, what a stupid thing", "en", "s")]).withColumn("score", F.lit("x")).withColumn("t", F.lit(1))
    got = sorted(r["doc_id"] for r in toxicity.score_documents(d, m).collect())
    assert got == [1, 1, 5]
    assert toxicity.score_documents(d.limit(0), m).count() == 0
    assert toxicity.score_documents(d, toxicity.compile_automaton([])).count() == 0


def test_lexicon_is_learnt_from_contexts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(160):
        words = prose(rng, EN, 60).split()
        if i % 4 == 0:
            for k in range(4):
                words.insert(rng.randrange(60), "blorgex")
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    once = "zzcopied " + rows[0][1]
    rows += [(1000 + i, once, "en", "s") for i in range(30)]
    labels += [(1000 + i, 1) for i in range(30)]
    terms = toxicity.learn_lexicon(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [t.text for t in terms] == ["blorgex"]
    assert toxicity.learn_lexicon(docs(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")) == []


# ---------------------------------------------------------------- classifiers


def test_dual_coordinate_descent_minimises():
    rng = np.random.default_rng(0)
    X = rng.standard_normal((40, 4))
    y = np.where(X @ [1, -2, 0.5, 0] + 0.3 > 0, 1.0, -1.0)
    rows, vals = [np.arange(4)] * 40, list(X)
    w, b = quality_classifier.dual_coordinate_descent(rows, vals, y, 4, c=1.0, epochs=500, seed=1, tol=1e-8)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (X @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        step = rng.standard_normal(5) * 0.02
        assert loss(w + step[:4], b + step[4]) >= best - 1e-6


def test_quality_held_out(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, EN, 80) if i % 2 else " ".join(w + "$$$" for w in prose(rng, EN, 80).split()), "en", "s") for i in range(200)]
    d = docs(spark, rows + [(900, None, "en", "s"), (901, "", "en", "s"), (902, " \n ", "en", "s")]).withColumn("y", F.lit(1)).withColumn("kept", F.lit(2))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    out = {r["doc_id"]: (r["score"], r["kept"]) for r in quality_classifier.classify(d, quality_classifier.train(d, labels)).collect()}
    assert len(out) == 203 and [out[i] for i in (900, 901, 902)] == [(None, False)] * 3
    assert np.mean([out[i][1] == bool(i % 2) for i in range(120, 200)]) > 0.95
    blind = quality_classifier.train(d, labels.limit(0))
    assert {r["kept"] for r in quality_classifier.classify(d.where("doc_id < 900"), blind).collect()} == {True}


def test_language_held_out(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, EN if i % 2 else DE, 40), "en" if i % 2 else "de", "s") for i in range(200)]
    model = language_id.train(docs(spark, rows[:150]), buckets=1 << 12)
    d = docs(spark, rows[150:] + [(900, None, "en", "s"), (901, "", None, "s"), (902, "123 !!", "en", "s"), (903, "the house of the river " * 20_000, "en", "s")]).withColumn("language", F.lit(1))
    out = {r["doc_id"]: r for r in language_id.identify(d, model).collect()}
    assert all(out[i]["language"] == ("en" if i % 2 else "de") for i in range(150, 200)) and out[903]["language"] == "en"
    assert all(out[i]["language"] is None and not out[i]["accepted"] for i in (900, 901, 902))
    kept = language_id.keep_identified(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["accepted"]}
    assert language_id.identify(d, language_id.train(d.limit(0))).where("accepted").count() == 0


# ---------------------------------------------------------------- outliers


def test_chi_square():
    assert outliers.chi2_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
    assert outliers.chi2_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-3)


def test_estimate_reaches_the_least_determinant(spark):
    """Against concentration steps from many random subsets, in NumPy."""
    rng = np.random.default_rng(7)
    X = rng.standard_normal((60, outliers.D))
    X[:12] += 8
    h, ridge = 45, 0.01
    best = np.inf
    for _ in range(40):
        pick = rng.choice(60, 12, replace=False)
        for _ in range(30):
            c = np.cov(X[pick].T, bias=True) + ridge * np.eye(outliers.D)
            z = X - X[pick].mean(0)
            pick = np.argsort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))[:h]
        c = np.cov(X[pick].T, bias=True) + ridge * np.eye(outliers.D)
        if np.linalg.slogdet(c)[1] < best:
            best, centre = np.linalg.slogdet(c)[1], X[pick].mean(0)
    df = spark.createDataFrame([("g", *map(float, x)) for x in X], "g string, " + ", ".join(f"x{d} double" for d in range(outliers.D)))
    got = outliers.estimate(df, common.Scratch(spark), support=0.75, ridge=ridge, steps=10, bins=6000, reweight=0.975).first()
    assert np.abs(np.array([got[f"m{d}"] for d in range(outliers.D)]) - centre).max() < 0.4  # reweighting adds rows


def test_outliers_edges(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, EN, rng.randint(30, 200)).capitalize() + ".", "en", None if i % 2 else "s") for i in range(240)]
    rows += [(900, "$$$ %%% !!! " * 50, "en", "s"), (901, None, "en", "s"), (902, "", None, None), (903, "one text", "fr", "t"), (5, rows[5][1], "en", None)]
    d = docs(spark, rows).withColumn("g", F.lit(1)).withColumn("ok", F.lit(False))
    out = outliers.reject(d).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and not by[900]["kept"] and not by[901]["kept"] and by[901]["distance"] is None and not by[902]["kept"]
    assert by[903]["kept"] and by[903]["distance"] < 8  # judged by all rows
    assert sum(by[i]["kept"] for i in range(240)) >= 238
    assert outliers.reject(d.limit(0)).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_variants_meet_one_bit_apart():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 21, 50).astype(np.uint64)
    keys = [set(k.tolist()) for k in near_dup.variants(v, 21)]
    for i in range(50):
        for bit in range(21):
            assert keys[i] & set(near_dup.variants(v[i : i + 1] ^ np.uint64(1 << bit), 21)[0].tolist())
        assert not keys[i] & set(near_dup.variants(v[i : i + 1] ^ np.uint64(0b101), 21)[0].tolist())


def test_run_edges_connect_as_all_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 150):
        base = rng.integers(0, 1 << 63, (4, 2)).astype(np.uint64)
        sig = base[rng.integers(0, 4, n)].copy()
        for _ in range(9):
            sig[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        edges, _ = near_dup.run_edges(np.zeros(n, np.int64), sig, 12)
        true = [(i, j) for i, j in itertools.combinations(range(n), 2) if near_dup.hamming(sig[i], sig[j]) <= 12]
        assert set(map(tuple, np.sort(edges, axis=1).tolist())) <= set(true)
        assert components_of(n, edges.tolist()) == components_of(n, true)
        size = rng.integers(0, 30, n)
        true = [(i, j) for i, j in true if abs(size[i] - size[j]) <= 9]
        for found in (near_dup.ball_edges(sig, 12, size, 9), near_dup.matrix_edges(sig, 12, size, 9).tolist(), near_dup.run_edges(np.zeros(n, np.int64), sig, 12, size=size, reach=9)[0].tolist()):
            assert {tuple(sorted(e)) for e in found} <= set(true) and components_of(n, found) == components_of(n, true)


def test_simhash_groups(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows = [(i, prose(rng, words, 150), "en", "s") for i in range(40)]
    for i in range(10):  # copies with one word changed
        t = rows[i][1].split()
        t[rng.randrange(150)] = "changed"
        rows.append((100 + i, " ".join(t), "en", "s"))
    rows += [(200, rows[0][1], "en", "s"), (300, None, "en", "s"), (301, "", "en", "s"), (302, "", "en", "s"), (303, "!!!", "en", "s"), (7, rows[7][1], "en", "s")]
    d = docs(spark, rows).withColumn("row", F.lit(0)).withColumn("s0", F.lit("x"))
    found = sorted(tuple(r) for r in near_dup.find_duplicates(d).collect())
    sig, n = near_dup.signatures([t or "" for _, t, _, _ in rows])
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if n[i] and n[j] and near_dup.hamming(sig[i], sig[j]) <= 11]
    ids = [r[0] for r in rows]
    root = components_of(len(rows), edges)
    least = {g: min(ids[i] for i in range(len(rows)) if root[i] == g) for g in set(root)}
    assert found == sorted({(ids[i], least[root[i]]) for i in range(len(rows)) if n[i] and ids[i] != least[root[i]]})
    assert {a for a, _ in found} == {*range(100, 110), 200}
    kept = near_dup.drop_duplicates(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in ids if i not in {a for a, _ in found})
    assert near_dup.find_duplicates(d.limit(0)).count() == 0


def test_simhash_groups_hold_every_pair_within_the_distance(spark):
    rng = random.Random(18)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows = []
    for _ in range(120):  # copies of which so much is changed that their signatures are about 17 bits apart
        t = prose(rng, words, 150).split()
        rows.append((len(rows), " ".join(t), "en", "s"))
        for _ in range(3):
            other = list(t)
            for k in rng.sample(range(150), 9):
                other[k] = rng.choice(words)
            rows.append((len(rows), " ".join(other), "en", "s"))
    sig, _ = near_dup.signatures([r[1] for r in rows])
    far = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if far[i, j] <= 17]
    assert sum(14 <= far[i, j] for i, j in edges) > 100
    root = components_of(len(rows), edges)
    assert sorted(tuple(r) for r in near_dup.find_duplicates(docs(spark, rows)).collect()) == [(i, r) for i, r in enumerate(root) if r != i]


def test_few_close_pairs_of_a_long_run_are_all_found():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    sig[2990:] = sig[:10] ^ np.uint64(0b10101)
    edges, dense = near_dup.run_edges(np.zeros(3000, np.int64), sig, 12)
    assert sorted(map(tuple, edges.tolist())) == [(i, 2990 + i) for i in range(10)] and not dense.any()


def test_components(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)]
    root = components_of(260, edges)
    expected = {i: root[i] for e in edges for i in e if any(i in x and x[0] != x[1] for x in edges)}
    table = spark.createDataFrame(edges + [(None, 1), (5, 5)], "a long, b long")
    for few in (common.FEW_EDGES, 0):  # on the driver, and in rounds
        monkeypatch.setattr(common, "FEW_EDGES", few)
        assert {r["node"]: r["root"] for r in common.components(table, common.Scratch(spark)).collect()} == expected
        assert common.components(table.limit(0), common.Scratch(spark)).count() == 0
    monkeypatch.undo()
    names = spark.createDataFrame([("b", "a"), ("d", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in common.components(names, common.Scratch(spark)).collect()} == {("a", "a"), ("b", "a"), ("d", "a"), ("x", "x"), ("y", "x")}


# ---------------------------------------------------------------- lines


def test_edit_distance():
    rng = random.Random(2)
    A, B, M, E = [], [], [], []
    for _ in range(300):
        a = "".join(rng.choice("abcé🦀 ") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 150])))
        b = list(a)
        for _ in range(rng.choice([0, 1, 3, 20])):
            b.insert(rng.randint(0, len(b)), rng.choice("xy")) if rng.random() < 0.5 else b and b.pop(rng.randrange(len(b)))
        d = lev(a, b)
        m = max(0, d + rng.choice([-2, -1, 0, 1]))
        A, B, M, E = A + [a], B + ["".join(b)], M + [m], E + [d <= m]
    assert edit.within(A, B, np.array(M)).tolist() == E
    assert [edit._one(a, b, m) for a, b, m in zip(A, B, M) if a] == [e for a, e in zip(A, E) if a]


def test_a_wide_band_does_not_widen_a_batch(monkeypatch):
    rng = random.Random(6)
    A, B, M = [], [], []
    for n in (300, 700, 1100) * 60:
        a = "".join(rng.choice("abcdefgh") for _ in range(n))
        b = list(a)
        for _ in range(rng.choice([5, 20, n // 9, n // 5])):
            b[rng.randrange(n)] = rng.choice("xyz")
        A, B, M = A + [a], B + ["".join(b)], M + [rng.choice([n // 8, n - 10])]
    batch, bands = edit._batch, []

    def seen(a, b, most):
        words = np.array([-(-len(x) // 64) for x in a])
        bands.append(np.minimum(words, 2 + most // 64))
        return batch(a, b, most)

    monkeypatch.setattr(edit, "_batch", seen)
    assert edit.within(A, B, np.array(M)).tolist() == [edit._one(a, b, m) for a, b, m in zip(A, B, M)]
    assert bands and all(x.max() < 2 * x.min() for x in bands)


def test_fuzzy_lines(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    line = [prose(rng, words, 40) for _ in range(12)]
    near = line[0].replace(line[0].split()[20], "altered")
    rows = [(1, line[0] + "\n" + line[1], "en", "s"), (2, line[0].upper() + "!!\n" + line[2], "en", "s"), (3, line[3] + "\n" + near, "en", "s"), (4, "short line\n" + line[4], "en", "s"), (5, "short line\n" + line[5], "en", "s"),
            (6, None, "en", "s"), (7, "", "en", "s"), (8, line[1], "en", "s"), (9, line[6] + "\n\n" + line[6], "en", "s"), (None, line[4], "en", "s"), (4, "short line\n" + line[4], "en", "s")]
    d = docs(spark, rows).withColumn("lines", F.lit("x")).withColumn("row", F.lit(1))
    out = line_dedup.drop_repeats(d)
    assert out.columns == d.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    expected = [(1, rows[0][1]), (2, line[2]), (3, line[3]), (4, rows[3][1]), (4, rows[3][1]), (5, rows[4][1]), (6, None), (7, ""), (8, ""), (9, line[6] + "\n"), (None, line[4])]
    assert got == sorted(expected, key=str)
    assert {r["doc_id"] for r in line_dedup.drop_repeats(d, drop_emptied=True).collect()} == {1, 2, 3, 4, 5, 6, 7, 9, None}
    assert line_dedup.drop_repeats(d.limit(0)).count() == 0


def test_line_pairs_are_found_at_every_length(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, tries = [], {}
    for low, high in ((5, 9), (10, 19), (20, 39), (40, 120), (150, 400)):
        for _ in range(120):
            line = prose(rng, words, rng.randint(low, high)).split()
            other, n = list(line), len(line)
            for _ in range(max(1, n // 15)):
                at, what = rng.randrange(len(other)), rng.randrange(3)
                other[at : at + (what > 0)] = [rng.choice(words)] * (what < 2)
            x, y = " ".join(line), " ".join(other)
            if x != y and len(other) >= 5 and edit.within([x], [y], np.array([int(0.15 * max(len(x), len(y)) + 1e-9)]))[0]:
                tries.setdefault(low, []).append(len(rows))
                rows += [(len(rows), x, "en", "s"), (len(rows) + 1, y, "en", "s")]
    left = {r["doc_id"] for r in line_dedup.drop_repeats(docs(spark, rows)).collect() if r["text"]}
    for low, firsts in tries.items():
        assert len(firsts) >= 20 and sum(i in left and i + 1 not in left for i in firsts) >= 0.9 * len(firsts), low
    assert all(i in left for firsts in tries.values() for i in firsts)


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "see also\nOne", "en", "s"), (2, "See  also!\nsee alsO too\none", "en", "s"), (3, "see also\n\n--", "en", "s")]
    out = line_dedup.drop_repeats(docs(spark, rows), short_exact=True, drop_emptied=True)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "see also\nOne"), (2, "see alsO too"), (3, "\n--")]


# ---------------------------------------------------------------- embeddings


def linked_by_all_pairs(X, threshold=0.9):
    """(class, copies, links) of each row, by brute force."""
    U = (X / np.linalg.norm(X, axis=1, keepdims=True)).astype(np.float32)
    S = U @ U.T >= threshold
    np.fill_diagonal(S, False)
    equal = (U[:, None, :] == U[None, :, :]).all(axis=2)
    root = components_of(len(X), [(int(i), int(j)) for i, j in zip(*np.nonzero(S)) if i < j])
    return [(root[i], int(equal[i].sum()), int(S[i].sum())) for i in range(len(X))]


def embedding_table(spark, X, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)] + list(extra), "vec_id long, embedding array<double>").withColumn("w", F.lit(1)).withColumn("n", F.lit("x"))


def found_links(out):
    rows = sorted(tuple(r) for r in out.collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [r[1:] for r in rows]


def test_nn_descent_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    X = rng.standard_normal((400, 16))
    X[:60] = X[0] + 0.05 * rng.standard_normal((60, 16))  # a group larger than a list
    X[100:140] = X[140:180] + 0.05 * rng.standard_normal((40, 16))
    X[200:230] = X[200]
    t = embedding_table(spark, X, [(900, None), (901, [0.0] * 16), (902, [1.0, 2.0]), (903, [float("nan")] * 16), (None, [1.0] * 16), (5, [float(v) for v in X[5]])])
    assert found_links(embedding_dedup.near_duplicates(t)) == linked_by_all_pairs(X)
    assert embedding_dedup.near_duplicates(t.limit(0)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(t.where("vec_id = 7")).collect()] == [(7, 7, 1, 0)]


def test_equal_vectors_hubs_and_the_exact_pass(spark, monkeypatch):
    rng = np.random.default_rng(8)
    X = rng.standard_normal((900, 8))
    X[100:800] = X[100]  # more than a list and a block hold
    X[800] = X[100] + 0.01
    X[:90] = X[0] + 0.3 * rng.standard_normal((90, 8))
    t = embedding_table(spark, X)
    true = linked_by_all_pairs(X)
    monkeypatch.setattr(embedding_dedup, "HUB", 4)  # every node is one
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    assert found_links(embedding_dedup.near_duplicates(t)) == true
    monkeypatch.setattr(embedding_dedup, "_audit", lambda *a: 0.0)  # whatever the lists hold
    assert found_links(embedding_dedup.near_duplicates(t, k=1, rounds=0, enlargements=0)) == true


def test_audit_counts_nodes_with_a_neighbour(spark):
    X = np.eye(64, dtype=np.float32)[np.concatenate((np.zeros(30, int), np.arange(1, 31).repeat(2)))]  # a group and 30 pairs
    v = spark.createDataFrame([(i, 1, x.tobytes()) for i, x in enumerate(X)], "id long, n long, v binary")
    group = spark.createDataFrame([(i, 29) for i in range(30)], "id long, links long")
    audit = lambda links, table: embedding_dedup._audit(links, table, 64, "bigint", 0.9, 8, table.count())
    assert abs(audit(group, v) - 1 / 3) < 1e-6  # most links are there, of most nodes none
    assert audit(group.limit(0), v.where("id = 0 OR id >= 30 AND id % 2 = 0")) == 1.0
    assert embedding_dedup._audit(group, v.limit(0), 64, "bigint", 0.9, 1 << 15, 1 << 20) is None


# ---------------------------------------------------------------- mixing, packing, URLs


def test_alpha():
    tokens = [900, 50, 50]
    a = mixing.find_alpha(tokens, 1000, min_entropy=0.9)
    h = lambda a: -sum(w * np.log(w) for w in mixing.weights(tokens, a)) / np.log(3)
    assert h(a) >= 0.9 - 1e-12 and h(a + 1e-6) < 0.9
    b = mixing.find_alpha(tokens, 1000, min_entropy=0.9, max_repeats=2.0)
    rep = lambda a: max(w * 1000 / t for w, t in zip(mixing.weights(tokens, a), tokens))
    assert rep(b) <= 2.0 + 1e-9 and rep(b - 1e-6) > 2.0
    assert mixing.find_alpha([], 0) == mixing.find_alpha([5], 5) == 1.0


def test_mixing_edges(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, EN, rng.randint(1, 30)), "en", "a" if i < 90 else "b" if i < 98 else None) for i in range(100)] + [(500, None, "en", "a"), (501, " ", "en", "b"), (3, "same row", "en", "a"), (3, "same row", "en", "a")]
    d = docs(spark, rows).withColumn("epoch", F.lit(1)).withColumn("size", F.lit("x"))
    plan = mixing.plan(d).collect()
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    count = lambda xs: sorted(((x, xs.count(x)) for x in set(xs)), key=str)
    assert count([(r["doc_id"], r["source"]) for r in plan]) == count([(r["doc_id"], r["source"]) for r in mixed.collect()])
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert abs(sum(r["tokens"] for r in plan) - total) <= 3 * 60
    per = {}
    for r in plan:
        per.setdefault(r["source"], []).append(r["block"])
    assert set(per) == {"a", "b", None} and all(0 <= b < 64 for v in per.values() for b in v)
    assert mixing.plan(d.limit(0)).count() == 0 == mixing.mix(d.limit(0)).count() == mixing.plan(d, budget_share=0.0).count()


def test_bin_completion_is_optimal_on_small_cases():
    def fewest(sizes, cap):
        best = [len(sizes)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= cap:
                    bins[k] += sizes[i]
                    go(i + 1, bins)
                    bins[k] -= sizes[i]
            go(i + 1, [*bins, sizes[i]])
        go(0, [])
        return best[0]
    rng = random.Random(3)
    for _ in range(150):
        cap = rng.choice([20, 50])
        sizes = sorted((rng.randint(cap // 5, cap // 2) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = packing.complete(sizes, cap, 5000)
        assert sorted(sum(bins, [])) == sorted(sizes) and all(sum(b) <= cap for b in bins)
        assert packing.lower_bound(sizes, cap) <= fewest(sizes, cap) == len(bins)


def test_packing_round_trip(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, EN, rng.choice([1, 5, 60, 64, 200, 700])), "en", "s") for i in range(80)] + [(500, None, "en", "s"), (501, "", "en", "s"), (3, "one two", "en", "s"), (3, "one two", "en", "s")]
    d = docs(spark, rows).withColumn("bin", F.lit(1)).withColumn("n", F.lit("x"))
    out = packing.pack(d, capacity=64, group_size=50).collect()
    total, bins = {}, {}
    for r in out:
        total.setdefault((r["doc_id"], r["copy"]), []).append((r["start"], r["length"]))
        bins.setdefault(r["bin"], []).append((r["place"], r["length"]))
    assert sorted(sum(n for _, n in v) for v in total.values()) == sorted(len(t.split()) for _, t, _, _ in rows if t)
    for v in total.values():
        at = 0
        for s, n in sorted(v):
            assert s == at
            at += n
    for v in bins.values():
        at = 0
        for p, n in sorted(v):
            assert p == at
            at += n
        assert at <= 64
    assert packing.pack(d.limit(0)).count() == 0


def test_url_trie_and_join_agree(spark):
    entries = [("example.com", "block"), ("a.example.com", "allow"), ("a.example.com/x", "block"), ("a.example.com/x/y", "allow"), ("example.com/x", "allow"), ("1.2.3.4", "block"), ("both.org", "allow"), ("both.org", "block"), ("org", "allow")]
    urls = ["http://example.com/", "https://b.example.com/x/1", "http://a.example.com/x", "HTTP://u:p@A.Example.com:80//x//y/z?q#f", "http://notexample.com", "http://1.2.3.4/x", "http://c.both.org", "http://x.org", None, "", "///", "http://a.example.com./%78", "http://h/" + "s/" * 5000]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("verdict", F.lit(1)).withColumn("u", F.lit(1))
    out = url_filter.filter_urls(d, entries).collect()
    verdicts = {r["page_id"]: (r["verdict"], r["entry"]) for r in out}
    assert len(out) == len(urls) + 1
    assert [verdicts[i] for i in range(13)] == [("block", "example.com"), ("allow", "example.com/x"), ("block", "a.example.com/x"), ("allow", "a.example.com/x/y"), ("allow", None), ("block", "1.2.3.4"), ("block", "both.org"), ("allow", "org"), ("invalid", None), ("invalid", None), ("invalid", None), ("block", "a.example.com/x"), ("allow", None)]
    table = spark.createDataFrame(entries, "entry string, verdict string")
    joined = url_filter.filter_urls(d.where("page_id < 12"), table, max_broadcast_entries=2).collect()
    assert sorted(map(str, joined)) == sorted(str(r) for r in out if r["page_id"] < 12)
    assert url_filter.filter_urls(d.limit(0), entries).count() == 0


def test_queries_and_pipeline(spark):
    """The stages follow each other as run one by one, on a small directory of documents."""
    import tempfile

    import corpus_pipeline
    from segtide.llm.queries import ORACLES, QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    rng = random.Random(11)
    words = {"en": EN, "de": DE}
    vocab = {k: v + [a + b for a in v for b in v] for k, v in words.items()}
    rows = [(i, "\n".join(prose(rng, vocab[lang], 40) for _ in range(3)), lang, f"s{i % 3}") for i in range(60) for lang in [("en", "de")[i % 2]]]
    rows += [(100, rows[0][1], "en", "s0"), (101, None, "en", "s1"), (102, "", "de", "s1")]
    here = tempfile.mkdtemp()
    docs(spark, rows).withColumn("extra", F.lit(1)).write.parquet(f"{here}/documents.parquet")
    now = spark.read.parquet(f"{here}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, now, here)
        if n < 4:
            assert now.columns == before.columns
            now.write.parquet(f"{here}/{n}")
            now = spark.read.parquet(f"{here}/{n}")
        if n == 1:
            ids = {r["doc_id"] for r in now.select("doc_id").collect()}
            assert ids == set(range(60))
    a = sorted(map(str, now.collect()))
    assert a == sorted(map(str, corpus_pipeline.run(spark, here).collect())) and len(a) >= 55
