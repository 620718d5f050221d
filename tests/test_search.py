"""The engine against brute force and known results."""

import random
from collections import Counter

import numpy as np
import pytest

from segtide import errors
from segtide.functions.costs import CosineCosts, EmbeddingStore, FunctionCosts, RuleCosts, UnitCosts, cost, unit_vector
from segtide.operators import kernels
from segtide.operators.index import SegmentIndex
from segtide.plans.planner import Neighbourhood, SearchParams, make_plan, select_positions, strict_bound


def brute(seqs, q, c, tau):
    """{(row, start, end): distance} by a full matrix for every segment."""
    out = {}
    ix, ir = c.insertions()
    for r, s in enumerate(seqs):
        for i in range(len(s)):
            d = [np.float32(0)]
            for t in q:
                d.append(d[-1] + c.deletion(t))
            for j in range(i, len(s)):
                with np.errstate(over="ignore"):
                    n = [d[0] + ix.get(s[j], ir)]
                    for k, t in enumerate(q):
                        row, rest = c.row(t)
                        n.append(min(d[k] + row.get(s[j], rest), d[k + 1] + ix.get(s[j], ir), n[k] + c.deletion(t)))
                d = n
                if d[-1] <= np.float32(tau):
                    out[r, i, j + 1] = float(d[-1])
    return out


def planned(seqs, q, c, tau, anchored=True, limit=None):
    f = Counter(t for s in seqs for t in s)
    return make_plan(q, c, SearchParams(tau, limit), lambda ts: {t: f[t] for t in ts if t in f}, sum(f.values()), len(f), lambda: sorted(f), anchored)


def run(seqs, plan, exhaustive=False):
    flat = np.array([plan.numbers.get(t, len(plan.numbers)) for s in seqs for t in s], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in seqs]))).astype(np.int64)
    found = (kernels.exhaustive if exhaustive else kernels.anchored)(flat, offsets, plan)
    return {(int(a), int(b), int(e)): float(d) for a, b, e, d in zip(*found)}


SHAPES = [("a", ["a"]), ("ab", ["xaby"]), ("aa", ["aaaa"]), ("abc", ["abcabc"]), ("bc", ["abc", "cba", "b", "cbcb"]), ("ab", ["", "ab", ""]), ("abcd", ["ab", "cd"]), ("ab", ["cd"]), ("ab", ["ba"])]
ABC = "abcdxy"
POLICIES = {
    "unit": UnitCosts(),
    "asymmetric": RuleCosts(1.25, 0.5, 1.5),
    "by symbol": RuleCosts(1, 1, 1, {(a, b): 0.25 * ABC.index(a) + 0.5 * ABC.index(b) + 0.25 for a in ABC for b in ABC if a != b}, {s: 0.25 * (ABC.index(s) + 1) for s in ABC}, {s: 0.5 * (ABC.index(s) + 1) for s in ABC}),
    "uninsertable": RuleCosts(1, 1, 1, {}, {}, {"c": float(np.finfo(np.float32).max)}),
}


@pytest.mark.parametrize("shape", range(len(SHAPES)))
@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("tau", [0, 0.5, 1, 2, 3.5])
def test_kernels_agree_with_brute_force(shape, policy, tau):
    q, seqs = SHAPES[shape]
    c = POLICIES[policy]
    expected = brute(seqs, q, c, tau)
    assert run(seqs, planned(seqs, q, c, tau, anchored=False), exhaustive=True) == expected
    try:
        plan = planned(seqs, q, c, tau)
    except errors.ThresholdUnavailable:
        return
    assert run(seqs, plan) == expected


def test_random_policies():
    rng = random.Random(5)
    accepted = 0
    for _ in range(300):
        seqs = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(3)]
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
        v = lambda: rng.choice([0, 0.25, 0.5, 1, 1.5])
        c = RuleCosts(v(), v(), v(), {(a, b): v() for a in "abcd" for b in "abc" if a != b and rng.random() < 0.4}, {a: v() for a in "abcd" if rng.random() < 0.4}, {a: v() for a in "abc" if rng.random() < 0.4})
        tau = rng.choice([0, 0.25, 0.5, 1])
        try:
            plan = planned(seqs, q, c, tau)
        except errors.ThresholdUnavailable:
            continue
        accepted += 1
        assert run(seqs, plan) == brute(seqs, q, c, tau)
    assert accepted > 100


def test_radius_is_widened():
    plan = planned(["ab"], "ab", RuleCosts(0.6, 2, 1, {}, {"a": 0.05}), 1.0)
    assert plan.metrics.adjusted_eta == pytest.approx(0.6) and plan.metrics.selected_query_positions == 1
    found = run(["ab"], plan)
    assert found == {(0, 0, 1): float(np.float32(0.65000004)), (0, 0, 2): 0.0, (0, 1, 2): float(np.float32(0.05))}


def test_contributions_are_added_in_query_order():
    tiny = 2.0**-24
    plan = planned(["abc"], "abc", RuleCosts(5, 1, 1, {}, {"a": tiny, "b": tiny, "c": 1.0}), 1.0)
    assert len(plan.selected) == 3


@pytest.mark.parametrize("tau,error", [(float("nan"), errors.InvalidCost), (-1, errors.InvalidCost), (float(np.finfo(np.float32).max), errors.InvalidThreshold)])
def test_thresholds(tau, error):
    with pytest.raises(error):
        strict_bound(tau)


def test_declined():
    for seqs, q, tau in ((["a", ""], "a", 1.0), (["a"], "", 0.0)):
        with pytest.raises(errors.ThresholdUnavailable):
            planned(seqs, q, UnitCosts(), tau)
    with pytest.raises(errors.ThresholdUnavailable):
        planned(["xbz"], "a", RuleCosts(1, 0.1, 0.1), 0.5)
    eight = ["aaaaaaaa"] * 128
    plan = planned(eight, "aa", UnitCosts(), 1.0, limit=2048)
    assert (plan.metrics.selected_query_positions, plan.metrics.generated_candidates) == (2, 2048)
    with pytest.raises(errors.SearchTooExpensive) as e:
        planned(eight, "aa", UnitCosts(), 1.0, limit=2047)
    assert (e.value.candidates, e.value.limit) == (2048, 2047)


def test_costs_and_vectors():
    assert cost(-0.0) == 0 and not np.signbit(cost(-0.0))
    with pytest.raises(errors.InvalidCost):
        cost(float("inf"))
    with pytest.raises(errors.ZeroNormEmbedding):
        unit_vector([0, 0])
    with pytest.raises(errors.InvalidEmbeddingValue):
        unit_vector([1, float("nan")])
    store = EmbeddingStore({"a": [3, 4]})
    with pytest.raises(errors.InvalidEmbeddingDimension):
        store.insert("b", [1])
    assert store.insert("a", [1, 0]).tolist() == pytest.approx([0.6, 0.8]) and len(store) == 1
    store.verify()
    assert RuleCosts(1, 1, 1, {("a", "a"): 5.0}).row("a")[0]["a"] == 0


def rows(df):
    return [tuple(r) for r in df.collect()]


def index_of(spark, seqs, kind="string"):
    return SegmentIndex.build(spark.createDataFrame([(i, list(s)) for i, s in enumerate(seqs)], f"seq_id long, tokens array<{kind}>"))


def test_search_through_spark(spark, tmp_path):
    seqs = ["x東京y", "東京", "東亰", "東京東京", "京都", ""]
    costs = RuleCosts(1, 1, 1, {("京", "亰"): 0.25})
    index = index_of(spark, seqs)
    expected = [(0, 1, 3, 0.0), (1, 0, 2, 0.0), (2, 0, 2, 0.25), (3, 0, 2, 0.0), (3, 2, 4, 0.0)]
    for access in ("scan", "postings", "auto"):
        assert rows(index.searcher(costs).search("東京", SearchParams(0.25), access)) == expected
    saved = index.save(str(tmp_path / "index"))
    saved.verify()
    assert rows(saved.searcher(costs).search("東京", SearchParams(0.25))) == expected
    broken = SegmentIndex(spark, saved.corpus, saved.vocabulary, saved.postings.where("pos > 0"), saved.token_type)
    with pytest.raises(errors.CorruptIndex):
        broken.verify()
    with pytest.raises(errors.InvalidFile):
        SegmentIndex.open(spark, str(tmp_path / "nothing"))


def test_other_tokens_and_batches(spark):
    index = index_of(spark, [[10, 20, 30, 40], [20, 30]], "int")
    s = index.searcher(UnitCosts())
    assert rows(s.search([20, 30], SearchParams(0))) == [(0, 1, 3, 0.0), (1, 0, 2, 0.0)]
    many = s.search_many([[20, 30], [40, 50]], SearchParams(1)).orderBy("query_id", "seq_id", "start", "end")
    one = [(q, *r) for q, query in enumerate(([20, 30], [40, 50])) for r in rows(s.search(query, SearchParams(1)))]
    assert rows(many) == one
    f = FunctionCosts(lambda a, b: 0.5 if abs(a - b) <= 10 else 1.0, lambda a: 1.0, lambda b: 1.0)
    assert (0, 0, 2, 1.0) in rows(index.searcher(f).search([20, 30], SearchParams(1)))
    assert rows(index_of(spark, []).searcher(UnitCosts()).search("a", SearchParams(0))) == []


def test_cosine_meets_words_outside_the_vocabulary(spark):
    store = EmbeddingStore({"literature": [1, 0], "books": [0.8, 0.6]})
    index = index_of(spark, ["Visitors enjoy books and curry in Jinbocho".split()])
    found = rows(index.searcher(CosineCosts(store)).search("literature and curry".split(), SearchParams(0.2001)))
    assert [r[:3] for r in found] == [(0, 2, 5)] and found[0][3] == pytest.approx(0.2, abs=1e-6)


def test_candidates_are_as_many_as_planned(spark):
    index = index_of(spark, ["abcab", "cab"])
    s = index.searcher(UnitCosts())
    got = rows(s.candidates("abc", SearchParams(1)))
    assert len(got) == len(set(got)) == s.plan("abc", SearchParams(1)).generated_candidates


def test_stream_equals_batch(spark, tmp_path):
    from segtide.streaming.search import search_stream

    index_of(spark, ["abcab", "cab", ""]).corpus.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, tokens array<string>").parquet(str(tmp_path / "in"))
    q = search_stream(stream, "ab", UnitCosts(), SearchParams(1)).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    expected = rows(index_of(spark, ["abcab", "cab", ""]).searcher(UnitCosts()).search("ab", SearchParams(1)))
    assert sorted(rows(spark.table("found"))) == expected


def test_selection_prefers_the_rare():
    hood = Neighbourhood(np.array([[0, 1], [1, 0]], np.float32), np.ones(2, np.float32), np.array([100, 2]), np.array([True, True]))
    assert [i for i, _ in select_positions(hood, np.float32(0.6), np.float32(0.5))] == [1]
