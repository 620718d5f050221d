"""The operators as wholes against brute force, at their queries' own parameters where it matters, and what is left of their edge cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from segtide.llm import common, edit, language_id, line_dedup, near_dup, outliers, packing, quality_classifier, toxicity, url_filter

from test_operators import DE, EN, components_of, docs, lev, prose

# ---------------------------------------------------------------- samples


def test_samples_do_not_vanish():
    for most, count in ((400, 10**10), (3_000, 10**12), (5_000, 7)):
        share = common.sample_bound(most, count) / (1 << 62)
        assert share == pytest.approx(min(1.0, most / count), rel=1e-6) and common.sample_bound(most, count) > 0


def test_sample_of_null_and_repeated_identifiers(spark):
    rng = random.Random(1)
    rows = [(None, prose(rng, EN, 30), "en", "s") for _ in range(300)] + [(7, "the same row", "en", "s")] * 300 + [(i, prose(rng, DE, 30), "de", "s") for i in range(300)]
    model = language_id.train(docs(spark, rows), buckets=1 << 12, max_per_language=60)
    out = language_id.identify(docs(spark, rows), model).groupBy("language", "accepted").count().collect()
    assert sum(r["count"] for r in out) == 900 and sum(r["count"] for r in out if r["language"] == "de") >= 295
    same = {tuple(r) for r in language_id.identify(docs(spark, rows).where("doc_id = 7 AND lang = 'en'"), model).collect()}
    assert len(same) == 1


# ---------------------------------------------------------------- toxicity


def brute_score(text, terms, window=80, per_edit=0.6):
    """(score, hits, quoted, terms) by trying every term on every word."""
    inner = re.escape(toxicity.JOINERS)
    words = [(m.start(), m.end()) for m in re.finditer(rf"[^\W_]+(?:[{inner}][^\W_]+)*", text)]
    hits = []
    for s, e in words:
        near = min(((lev(text[s:e].lower(), t.text), t.text, t) for t in terms if lev(text[s:e].lower(), t.text) <= t.max_edits), key=lambda x: x[:2], default=None)
        if near:
            hits.append((s, e, near[0], near[2]))
    score, quoted = 0.0, 0
    for s, e, edits, term in hits:
        around = sum(abs(s - o) <= window for o, *_ in hits) - 1
        factor, q = toxicity.context_factor(text, s, e, around, window)
        score, quoted = score + term.weight * per_edit**edits * factor, quoted + q
    return score, len(hits), quoted, sorted({t.text for *_, t in hits})


def test_toxicity_scores_are_those_of_brute_force(spark):
    rng = random.Random(5)
    terms = [toxicity.Term("idiot", 1.0, 1), toxicity.Term("moron", 0.7, 1), toxicity.Term("scum", 1.5, 0), toxicity.Term("worthless", 1.0, 2)]
    pool = EN + ["idiot", "idi0t", "IDIOT", "morons", "scum", "scums", "worthles", "wrthles", "you", "said", '"', '"idiot"', "\n", "st*pid", "word"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(120)] + ["idiot " * 400, "filler " * 40_000 + "you idiot scum"]
    found = {i: r for i, *r in toxicity.score_texts(texts, toxicity.compile_automaton(terms))}
    for i, t in enumerate(texts[:-1]):
        score, hits, quoted, names = brute_score(t, terms)
        assert (i in found) == (hits > 0)
        if hits:
            assert found[i][0] == pytest.approx(score) and found[i][1:] == [hits, quoted, names], t
    assert found[len(texts) - 1][1] == 2
    d = docs(spark, [(None, texts[0], "en", "s"), (None, "you idiot scum", "en", "s"), (1, "you idiot scum", "en", "s"), (1, "you idiot scum", "en", "s")])
    assert sorted(map(str, (r["doc_id"] for r in toxicity.score_documents(d, toxicity.compile_automaton(terms)).where("hits = 2").collect()))) >= ["1", "1", "None"]


def test_lexicon_is_that_of_brute_force(spark):
    rng = random.Random(6)
    bad = ["blorgex", "zzork", "quimple"]
    rows, labels = [], []
    for i in range(240):
        words = prose(rng, EN, 40).split()
        if i % 3 == 0:
            for _ in range(4):
                words.insert(rng.randrange(40), rng.choice(bad))
        if i % 3 == 1 and i % 2:
            words.insert(3, "blorgey")  # near a term, in clean contexts
        rows.append((i, " ".join(words), "en", "s"))
        labels += [(i, int(i % 3 == 0))] * (1 + i % 2)
    rows += [(None, "blorgex " * 50, "en", "s"), (999, None, "en", "s")]
    labels += [(999, 1), (5000, 1), (None, 1), (4, None)]
    contexts = {}
    for i, t, _, _ in rows[:240]:
        w = re.findall(r"[^\W_]+", t.lower())
        for k, x in enumerate(w):
            contexts.setdefault(x, set()).add((int(i % 3 == 0), w[k - 1] if k else None, w[k + 1] if k + 1 < len(w) else None))
    n = {x: (sum(c[0] for c in s), sum(1 - c[0] for c in s)) for x, s in contexts.items() if 2 <= len(x) <= 40}
    a_all, b_all = sum(a for a, _ in n.values()), sum(b for _, b in n.values())
    p0 = a_all / (a_all + b_all)
    expected = {}
    for x, (a, b) in n.items():
        s = a / (a + b)
        kl = s * math.log(s / p0) + ((1 - s) * math.log((1 - s) / (1 - p0)) if s < 1 else 0) if a else 0
        if a and s >= 0.8 and s > p0 and (a + b) * kl >= math.log(len(n) / 0.05):
            near = [n[y] for y in n if y != x and lev(x, y) <= 1]
            expected[x] = int(len(x) >= 5 and not sum(b for _, b in near) > 0.02 * sum(a for a, _ in near))
    got = toxicity.learn_lexicon(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {t.text: t.max_edits for t in got} == expected and {"blorgex", "zzork", "quimple"} <= set(expected) and expected["blorgex"] == 0


# ---------------------------------------------------------------- classifiers


def brute_features(text):
    tokens = re.findall(r"[^\W_]+|(?:(?![^\W_])\S)+", text)
    return {("u", t) for t in tokens} | {("b", a, b) if a != b else ("b",) for a, b in zip(tokens, tokens[1:])}


def test_quality_model_is_that_of_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(EN if i % 2 else [w + "$$" for w in EN[:8]] + EN) for _ in range(rng.randint(3, 40))) + ("." if i % 3 else "!! x x") for i in range(120)]
    y = np.array([i % 2 for i in range(120)])
    rows = [quality_classifier.indicators([t], 1 << 22)[1] for t in texts]
    named = [brute_features(t) for t in texts]
    assert [len(r) for r in rows] == [len(f) for f in named]
    model = quality_classifier.fit(rows, y, buckets=1 << 22)
    held = np.arange(120) % 5 == 0
    vocabulary = sorted({f for i in np.flatnonzero(~held) for f in named[i]})
    count = {g: {f: 1.0 + sum(f in named[i] for i in np.flatnonzero(~held) if y[i] == g) for f in vocabulary} for g in (0, 1)}
    rest = (1 << 22) - len(vocabulary)
    ratio = {f: math.log(count[1][f] / (sum(count[1].values()) + rest)) - math.log(count[0][f] / (sum(count[0].values()) + rest)) for f in vocabulary}
    for i in range(120):
        assert model.norms[rows[i]].sum() == pytest.approx(sum(ratio.get(f, 0.0) ** 2 for f in named[i]), rel=1e-4)
    # the same objective, over the brute-force features: no step away from the model's weights is better
    at = {f: k for k, f in enumerate(vocabulary)}
    X = np.zeros((120, len(vocabulary)))
    for i in range(120):
        v = {f: ratio[f] for f in named[i] if f in at}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        for f, x in v.items():
            X[i, at[f]] = x / norm
    sign = np.where(y == 1, 1.0, -1.0)
    got, _ = quality_classifier.score(texts, model)
    w = np.linalg.lstsq(np.column_stack([X[~held], np.ones((~held).sum())]), got[~held], rcond=None)[0]

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - sign[~held] * (X[~held] @ w[:-1] + w[-1])).sum()

    base = loss(w)
    step = np.random.default_rng(0)
    assert all(loss(w + step.standard_normal(len(w)) * 0.02) >= base - 0.05 for _ in range(200))
    # what is held out doesn't move the weights
    other = quality_classifier.fit([r if not h else rows[0] for r, h in zip(rows, held)], y, buckets=1 << 22)
    assert np.array_equal(other.weights, model.weights)


def test_quality_edges(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, EN, 50) if i % 2 else " ".join(w + "$$$" for w in prose(rng, EN, 50).split()), "en", "s") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality_classifier.train(docs(spark, rows), labels)
    more = docs(spark, [(None, rows[1][1], "en", "s"), (5, rows[1][1], "en", "s"), (5, rows[1][1], "en", "s"), (6, (rows[3][1] + " ") * 3_000, "en", "s")]).withColumn("score", F.lit("x"))
    out = quality_classifier.classify(more, model).collect()
    assert len(out) == 4 and len({r["score"] for r in out[:3]}) == 1 and all(r["kept"] for r in out)
    at = quality_classifier.QualityModel(model.weights, model.norms, model.bias, out[0]["score"])
    assert quality_classifier.classify(more, at).where("doc_id IS NULL").first()["kept"]
    assert quality_classifier.classify(more.limit(0), model).count() == 0


def test_language_judgement_is_that_of_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, EN if i % 2 else DE, 30), "en" if i % 2 else "de", "s") for i in range(120)]
    model = language_id.train(docs(spark, rows), buckets=1 << 12)

    def brute(text):
        mask = (1 << 64) - 1

        def mix(h):
            h = (h + 0x9E3779B97F4A7C15) & mask
            h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
            return h ^ (h >> 31)
        c = [" "] + [x.lower() if x.isalpha() else " " for x in text] + [" "] * 3
        ids = []
        for size in (3, 4):
            for i in range(len(c) - size + 1):
                gram = c[i : i + size]
                if all(x != " " for x in gram[1 : size - 1]):
                    h = 0
                    for x in gram[:3]:
                        h = (h * 1099511628211 + ord(x)) & mask
                    for x in gram[3:]:
                        h = (h * 1099511628211 + ord(x)) & mask
                    ids.append(mix(h) % (1 << 12))
        if not ids:
            return None, 0.0
        z = (model.logits[ids].astype(float).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return model.languages[int(p.argmax())], float(p.max())

    texts = [t for _, t, _, _ in rows[:20]] + ["a", "ab", "The RIVER, die Zeit! 12", "", "123", "x y", "der\nthe"]
    best, sure = language_id.judge(texts, model)
    for t, b, s in zip(texts, best, sure):
        name, p = brute(t)
        assert (model.languages[b] if b >= 0 else None) == name and s == pytest.approx(p, abs=1e-5), t
    tie = language_id.LanguageModel(("a", "b"), np.zeros((16, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.5)
    assert [x.tolist() for x in language_id.judge(["same", "12"], tie)] == [[0, -1], [0.5, 0.0]]
    out = language_id.identify(docs(spark, [(None, "same", "en", "s"), (1, "same", "en", "s"), (1, "same", "en", "s")]), tie).collect()
    assert [(r["language"], r["accepted"]) for r in out] == [("a", True)] * 3


# ---------------------------------------------------------------- outliers


def test_outlier_distances_are_those_of_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, ". ".join(prose(rng, EN, rng.randint(4, 12)).capitalize() for _ in range(rng.randint(2, 25))), "en", "s") for i in range(160)] + [(500 + i, "$%& !! " * (20 + i), "en", "s") for i in range(8)]
    rows += [(900, "word " * 150_000, "en", "s")]
    x, ok = outliers.statistics([t for _, t, _, _ in rows])
    n, d = len(x), outliers.D
    h = math.ceil(0.75 * n)
    ridge = 0.01 * np.eye(d)
    best = None
    pick_rng = np.random.default_rng(0)
    for _ in range(60):
        pick = pick_rng.choice(n, 20, replace=False)
        for _ in range(40):
            c = np.cov(x[pick].T, bias=True) + ridge
            z = x - x[pick].mean(0)
            pick = np.argsort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))[:h]
        c = np.cov(x[pick].T, bias=True) + ridge
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], x[pick].mean(0), c
    _, m, c = best
    q = outliers.chi2_quantile
    scale = 0.75 / outliers.chi2_cdf(q(0.75, d), d + 2)
    z = x - m
    inner = np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) <= q(0.975, d) * scale
    m = x[inner].mean(0)
    c = np.cov(x[inner].T, bias=True) * (0.975 / outliers.chi2_cdf(q(0.975, d), d + 2)) + ridge
    z = x - m
    far = np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    got = {r["doc_id"]: r for r in outliers.reject(docs(spark, rows)).collect()}
    for (i, *_), f in zip(rows, far):
        assert got[i]["distance"] == pytest.approx(f, rel=0.08, abs=0.15), i
        assert got[i]["kept"] == (f * f <= q(1 - 1e-12, d)) or abs(f * f / q(1 - 1e-12, d) - 1) < 0.1
    assert not any(got[500 + i]["kept"] for i in range(8)) and sum(got[i]["kept"] for i in range(160)) == 160


def test_rare_groups_are_judged_by_all_rows(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, EN, rng.randint(30, 200)).capitalize() + ".", "en", "s") for i in range(200)]
    rows += [(900, "$$$ %%% !!! " * 50, "fr", "t"), (901, prose(rng, EN, 90).capitalize() + ".", "fr", "t"), (902, None, "fr", "t")]
    got = {r["doc_id"]: r for r in outliers.reject(docs(spark, rows)).collect()}
    assert not got[900]["kept"] and got[900]["distance"] > 10 and got[901]["kept"] and got[901]["distance"] is not None and not got[902]["kept"]
    few = {r["doc_id"]: r for r in outliers.reject(docs(spark, rows[-3:])).collect()}
    assert few[900]["kept"] and few[900]["distance"] is None


# ---------------------------------------------------------------- duplicates


def test_simhash_long_runs_texts_and_null_identifiers(spark):
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = prose(rng, words, 300).split()
    rows = []
    for i in range(150):  # one long run: a word changed each
        t = list(base)
        t[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(t), "en", "s"))
    rows += [(None, rows[0][1], "en", "s"), (500, "long " + prose(rng, words, 60_000), "en", "s"), (501, rows[0][1], "en", "s")]
    sig, _ = near_dup.signatures([r[1] for r in rows])
    real = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and near_dup.hamming(sig[i], sig[j]) <= 11]
    root = components_of(len(rows), real)
    found = {r["doc_id"]: r["kept_id"] for r in near_dup.find_duplicates(docs(spark, rows)).collect()}
    assert {i for i, r in enumerate(root) if r != i} <= {next(k for k, x in enumerate(rows) if x[0] == d) for d in found}
    assert None not in found and 500 not in found and set(found.values()) == {0}
    assert near_dup.drop_duplicates(docs(spark, rows)).where("doc_id IS NULL").count() == 1


def test_line_groups_of_dense_runs_are_those_of_all_pairs(spark, monkeypatch):
    """Whether lines are similar is drawn by lot, so that in dense runs some pairs fail; groups have to be those of all pairs that meet."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows = []
    for _ in range(10):
        base = prose(rng, words, 60).split()
        for _ in range(14):
            t = list(base)
            for _ in range(rng.choice([1, 2, 6, 10])):
                t[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), " ".join(t), "en", "s"))
    tables = {}
    write = common.Scratch.write

    def kept(self, df, name, small=False):
        tables[name] = write(self, df, name, small)
        return tables[name]

    monkeypatch.setattr(common.Scratch, "write", kept)
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *names: None)
    for seed in range(3):
        monkeypatch.setattr(line_dedup, "_similar", lambda pairs, texts, similarity: pairs.withColumn("ok", F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(5)) < 1))
        tables.clear()
        out = line_dedup.drop_repeats(docs(spark, rows), drop_emptied=True)
        left = {r["doc_id"] for r in out.collect()}
        nodes = tables["sketched"].collect()
        runs = {}
        for k, n in enumerate(nodes):
            for s0, s1, *keys in line_dedup.SETS:
                if n[s0] is not None:
                    for w, c in enumerate(keys):
                        for half in (0, 1):
                            runs.setdefault((w, half, (n[c] >> (0 if half else 32)) & 0xFFFFFFFF), []).append((k, n[s0], n[s1]))
        meet = set()
        for members in runs.values():
            for i in range(len(members)):
                for j in range(i):
                    (x, a0, a1), (y, b0, b1) = members[i], members[j]
                    if bin((a0 ^ b0) & (1 << 64) - 1).count("1") + bin((a1 ^ b1) & (1 << 64) - 1).count("1") <= 46 and min(nodes[x]["size"], nodes[y]["size"]) >= 0.85 * max(nodes[x]["size"], nodes[y]["size"]):
                        meet.add((min(x, y), max(x, y)))
        pairs = [(min(nodes[x]["node"], nodes[y]["node"]), max(nodes[x]["node"], nodes[y]["node"]), x, y) for x, y in meet]
        ok = {(r["a"], r["b"]) for r in spark.createDataFrame([p[:2] for p in pairs], "a long, b long").where(F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(5)) < 1).collect()}
        root = components_of(len(nodes), [(x, y) for a, b, x, y in pairs if (a, b) in ok])
        first = {}
        for k, n in enumerate(nodes):
            first[root[k]] = min(first.get(root[k], 10**9), n["first"]["id"])
        assert len(pairs) > 500 and left == set(first.values())


def test_very_long_lines(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = prose(rng, words, 20_000)
    near = long.split()
    for _ in range(300):
        near[rng.randrange(20_000)] = "altered"
    rows = [(1, "a short one of five words\n" + long, "en", "s"), (2, " ".join(near), "en", "s"), (3, prose(rng, words, 20_000), "en", "s"), (4, "\n".join(prose(rng, words, 12) for _ in range(3_000)), "en", "s")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeats(docs(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "", 3: rows[2][1], 4: rows[3][1]}


def test_the_language_sample_is_in_the_drivers_memory_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda ids, cnt, *rest, **options: seen.extend([*ids, *cnt]))
    language_id.train(docs(spark, [(i, f"some words of row {i}", "en", "s") for i in range(40)]))
    assert len(seen) > 40 and not any(x.flags.owndata for x in seen)


def test_the_pipeline_keeps_one_document_of_each_pair_within_the_distance(spark):
    import corpus_pipeline

    rng = random.Random(19)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows = []
    for _ in range(150):
        t = prose(rng, words, 150).split()
        other = list(t)
        for k in rng.sample(range(150), 9):
            other[k] = rng.choice(words)
        rows += [(len(rows), " ".join(t), "en", "s"), (len(rows) + 1, " ".join(other), "en", "s")]
    sig, _ = near_dup.signatures([r[1] for r in rows])
    far = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
    close = [(i, j) for i in range(len(rows)) for j in range(i) if far[i, j] <= 17]
    assert sum(far[i, j] >= 14 for i, j in close) > 20
    root = components_of(len(rows), close)
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs(spark, rows), "").collect()) == sorted(set(root))


def test_rows_that_repeat_an_identifier_link_what_is_near_to_any_of_them(spark):
    import corpus_pipeline

    rng = random.Random(20)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    x, y, z, other = (prose(rng, words, 60) for _ in range(4))
    d = docs(spark, [(1, x, "en", "s"), (5, x, "en", "s"), (5, y, "en", "s"), (7, y, "en", "s"), (7, z, "en", "s"), (3, z, "en", "s"), (8, other, "en", "s"), (8, other, "en", "s"), (9, None, "en", "s")])
    assert sorted(tuple(r) for r in near_dup.find_duplicates(d).collect()) == [(3, 1), (5, 1), (7, 1)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, d, "").collect()) == [1, 8, 8, 9]


def test_pairs_in_which_few_words_differ_need_no_matrix(monkeypatch):
    rng = random.Random(21)
    for _ in range(2000):
        a = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 9))]
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice(["", "a", "bb", "aba"]))
        x, y = " ".join(a), " ".join(b)
        d = lev(x, y)
        assert not edit._few_words_differ(x, y, d - 1)
        assert edit.within([x], [y], np.array([d])).all()
    monkeypatch.setattr(edit, "_batch", None)
    monkeypatch.setattr(edit, "_one", None)
    words = [f"word{i:04}" for i in range(400)]
    other = ["another" if i % 40 == 7 else w for i, w in enumerate(words) if i % 90 != 3]
    assert edit.within([" ".join(words)], [" ".join(other)], np.array([200])).all()


def test_a_long_text_leaves_the_others_of_its_batch_together(monkeypatch):
    rng = random.Random(22)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    a, b = ([prose(rng, words, n) for n in [270] * 60 + [330]] for _ in range(2))
    alone, one = [], edit._one
    monkeypatch.setattr(edit, "_one", lambda x, y, most: alone.append(len(x)) or one(x, y, most))
    most = np.array([int(0.15 * max(len(x), len(y))) for x, y in zip(a, b)])
    assert edit.within(a, b, most).tolist() == [one(x, y, k) for x, y, k in zip(a, b, most.tolist())]
    assert len(a[0]) < 2048 < len(a[-1]) and len(alone) <= 1


def test_equal_lines_have_one_sketch_and_their_first_occurrence(spark):
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    lines = [prose(rng, words, 12) for _ in range(5)]
    texts = {i: "\n".join([lines[i % 5], "see also", lines[i * 3 % 5].upper()]) for i in range(40)}
    d = docs(spark, [(i, t, "en", "s") for i, t in texts.items()] + [(3, texts[3], "en", "s")])
    nodes = line_dedup._nodes(line_dedup._lines(d, "doc_id", "text", 5, True))
    assert "Aggregate" not in nodes._jdf.queryExecution().executedPlan().toString()
    got = nodes.collect()
    first = {}
    for i, t in sorted(texts.items(), reverse=True):
        for n, line in reversed(list(enumerate(t.lower().split("\n")))):
            first[line] = (i, n)
    assert len(got) == 41 * 3 and {r["node"]: tuple(r["first"]) for r in got} == {r["node"]: first[texts[r["id"]].lower().split("\n")[r["line"]]] for r in got}
    leads = [r for r in got if r["lead"]]
    assert sorted(tuple(r["first"]) for r in leads) == sorted(first.values()) and len({r["node"] for r in got}) == len(leads)
    assert all((r["xs0"] is not None) == (r["lead"] and r["first"][1] != 1) for r in got)


# ---------------------------------------------------------------- packing, URLs, the pipeline


def test_completion_beats_best_fit_with_the_query_s_parameters():
    import inspect

    p = {k: v.default for k, v in inspect.signature(packing.pack).parameters.items()}
    sizes = np.random.default_rng(1).integers(400, 900, 1000).tolist()
    greedy = packing.best_fit(sizes, p["capacity"])
    bins = packing.complete(sizes, p["capacity"], p["max_nodes"])
    assert sorted(sum(bins, [])) == sorted(sizes) and all(sum(b) <= p["capacity"] for b in bins)
    assert packing.lower_bound(sizes, p["capacity"]) <= len(bins) < len(greedy)


def test_packing_null_identifiers(spark):
    d = docs(spark, [(None, "a b c", "en", "s"), (None, "a b c", "en", "s"), (None, "d", "en", "s")])
    out = packing.pack(d).collect()
    assert sorted((r["doc_id"], r["copy"], r["length"]) for r in out) == [(None, 0, 1), (None, 1, 3), (None, 2, 3)]


def test_url_ways_agree_on_every_edge(spark):
    rng = random.Random(17)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "d.com", "1.2.3.4", "[::1]"]
    paths = ["", "/x", "/x/y", "/x/y/z", "/%78/y", "/a%2Fb", "/a/b"]
    entries = [(rng.choice(hosts) + rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    urls = [rng.choice(["http://", "HTTPS://u@", "//", ""]) + rng.choice(hosts + ["q.com"]) + rng.choice([":80", ""]) + rng.choice(paths) + rng.choice(["", "?q", "#f"]) for _ in range(150)]
    rows = [(str(i) if i % 7 else None, u) for i, u in enumerate(urls)] + [(None, "x"), ("x", None), (None, None), ("x", None), ("1", "http://a.org/" + "s/" * 400)]
    d = spark.createDataFrame(rows, "page_id string, url string")
    table = spark.createDataFrame(entries, "entry string, verdict string")
    ways = [sorted(map(str, url_filter.filter_urls(d, table, max_broadcast_entries=n).collect())) for n in (1_000_000, 3)]
    assert ways[0] == ways[1] and len(ways[0]) == len(rows)
    for wrong in ([("http:///x", "block")], [("a.org", "maybe")], [(None, "block")]):
        for n in (10, 0):
            with pytest.raises(ValueError, match="host|verdict"):
                url_filter.filter_urls(d, spark.createDataFrame(wrong, "entry string, verdict string"), max_broadcast_entries=n)


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(18)
    rows = [(i if i % 9 else None, "\n".join(prose(rng, [a + b for a in w for b in w], 40) for _ in range(2)), lang, f"s{i % 2}") for i in range(40) for lang, w in [(("en", EN), ("de", DE))[i % 2]]]
    d = docs(spark, rows).drop("n_chars").withColumns({"lines": F.lit("x"), "row": F.lit(1), "epoch": F.lit(2), "bin": F.lit("b"), "gone": F.lit(3), "t": F.lit(4)})
    d.write.parquet(f"{tmp_path}/some/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
    docs(spark, rows).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
