"""Searching an index: plans on the driver, one pass of Arrow batches over the sequences that can match.

Two ways to the sequences, with the same result: ``scan`` reads the corpus and
skips, inside the JVM, sequences without an anchor token; ``postings`` finds the
sequences by the sorted postings first and joins the corpus to them. The
candidates are known exactly beforehand, so ``auto`` takes the postings where
they are few and saved. All matches of a sequence come from its row, so nothing is
shuffled to make them unique.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide import errors
from segtide.functions.costs import CostPolicy
from segtide.functions.tokens import byte_range
from segtide.operators import kernels
from segtide.operators.index import SegmentIndex
from segtide.plans.planner import SearchMetrics, SearchParams, SearchPlan, make_plan

MATCH = "seq_id long, start int, end int, distance float"
#: Above this many tokens an anchor list is joined, not written into the plan.
LISTED = 1000
#: Share of the corpus's tokens above which a pass over it is cheaper than postings.
FEW = 0.02
#: Queries of a table that are planned together and searched in one pass.
BLOCK = 512
#: Functions over the whole vocabulary are refused beyond this many tokens.
VOCABULARY_LIMIT = 1_000_000


def _numbered(tokens: pa.Array, numbers: dict) -> np.ndarray:
    """Token numbers of a flat array; what has none, nulls too, is the last number."""
    coded = tokens.dictionary_encode()
    known = np.array([numbers.get(t, len(numbers)) for t in coded.dictionary.to_pylist()] + [len(numbers)], dtype=np.int64)
    return known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]


class _Batched:
    """Plans over one numbering of all their tokens; a plan sees only the sequences that have one of its anchors."""

    def __init__(self, plans: Sequence[SearchPlan], exhaustive: bool):
        self.plans, self.kernel = plans, kernels.exhaustive if exhaustive else kernels.anchored
        self.numbers = {t: n for n, t in enumerate(dict.fromkeys(t for p in plans for t in p.numbers))}
        size = len(self.numbers)
        self.own = [np.array([self.numbers[t] for t in p.numbers], dtype=np.int64) for p in plans]
        self.everywhere = [exhaustive or p.anchor_tokens is None for p in plans]
        pairs = [(self.numbers[t], q) for q, p in enumerate(plans) if not self.everywhere[q] for t in p.anchor_tokens]
        pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.anchor_plan = pairs[:, 1]
        self.anchor_at = np.searchsorted(pairs[:, 0], np.arange(size + 2))

    def __call__(self, tokens: pa.Array, offsets: np.ndarray) -> Iterator[tuple]:
        """(query, row, start, end, distance) of each query that matches."""
        flat = _numbered(tokens, self.numbers)
        count = self.anchor_at[flat + 1] - self.anchor_at[flat]
        hits = np.flatnonzero(count)
        count = count[hits]
        plan = self.anchor_plan[np.repeat(self.anchor_at[flat[hits]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        row = np.repeat(np.searchsorted(offsets, hits, side="right") - 1, count)
        order = np.lexsort((row, plan))
        plan, row = plan[order], row[order]
        table = np.empty(len(self.numbers) + 1, np.int64)
        for q, p in enumerate(self.plans):
            if self.everywhere[q]:
                rows = np.arange(len(offsets) - 1)
            else:
                rows = np.unique(row[np.searchsorted(plan, q) : np.searchsorted(plan, q, side="right")])
            if not len(rows):
                continue
            size = offsets[rows + 1] - offsets[rows]
            to = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(offsets[rows] - to[:-1], size) + np.arange(to[-1])
            table.fill(len(p.numbers))
            table[self.own[q]] = np.arange(len(self.own[q]))
            found = self.kernel(table[flat[at]], to, p)
            if len(found[0]):
                yield q, rows[found[0]], *found[1:]


def match_rows(rows: DataFrame, plans: Sequence[SearchPlan], exhaustive: bool = False, first: int = 0) -> DataFrame:
    """(query_id, seq_id, start, end, distance) for rows (seq_id, tokens); one pass for all plans, numbered from ``first``."""
    shared = rows.sparkSession.sparkContext.broadcast(list(plans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Batched(shared.value, exhaustive)
        for batch in batches:
            tokens = batch.column("tokens")
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for q, row, start, end, distance in matcher(tokens.flatten(), np.concatenate(([0], np.cumsum(lengths)))):
                yield pa.record_batch(
                    [pa.array(np.full(len(row), first + q, np.int64)), batch.column("seq_id").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(distance.astype(np.float32))],
                    names=["query_id", "seq_id", "start", "end", "distance"],
                )

    return rows.select("seq_id", "tokens").mapInArrow(run, f"query_id long, {MATCH}")


class Searcher:
    """An index with a policy; any number of queries, from any threads."""

    def __init__(self, index: SegmentIndex, costs: CostPolicy):
        self.index, self.costs = index, costs

    def plan(self, query: Sequence, params: SearchParams, anchored: bool = True) -> SearchPlan:
        total, size = self.index.count() if anchored else (0, 0)
        return make_plan(query, self.costs, params, self.index.frequencies, total, size, self._vocabulary, anchored)

    def _vocabulary(self) -> list:
        if self.index.count()[1] > VOCABULARY_LIMIT:
            raise ValueError(f"costs given as functions need the whole vocabulary, at most {VOCABULARY_LIMIT} tokens")
        return [r["token"] for r in self.index.vocabulary.select("token").collect()]

    def _sequences(self, plans: Sequence[SearchPlan], access: str) -> DataFrame:
        corpus = self.index.corpus
        anchors = [p.anchor_tokens for p in plans]
        if any(a is None for a in anchors):
            return corpus
        tokens = list(dict.fromkeys(t for a in anchors for t in a))
        if not tokens:
            return corpus.limit(0)
        if access == "auto":
            access = "postings" if self.index.inverted and sum(p.generated_candidates for p in plans) <= FEW * self.index.count()[0] else "scan"
        kind = self.index.token_type
        if access == "postings":
            if len(tokens) <= LISTED:
                hits = self.index.postings.where(F.col("token").isin(tokens))
            else:
                hits = self.index.postings.join(self.index.spark.createDataFrame([(t,) for t in tokens], f"token {kind}"), "token", "left_semi")
            return corpus.join(hits.select("seq_id").distinct(), "seq_id", "left_semi")
        if access != "scan":
            raise ValueError(f"unknown access {access!r}")
        return corpus.where(F.arrays_overlap("tokens", F.array(*[F.lit(t).cast(kind) for t in tokens]))) if len(tokens) <= LISTED else corpus

    def search(self, query: Sequence, params: SearchParams, access: str = "auto", ordered: bool = True) -> DataFrame:
        """(seq_id, start, end, distance) of every matching segment, in this order; declined searches raise here."""
        return self.search_with_metrics(query, params, access, ordered)[0]

    def search_with_metrics(self, query: Sequence, params: SearchParams, access: str = "auto", ordered: bool = True) -> tuple[DataFrame, SearchMetrics]:
        plan = self.plan(query, params)
        found = match_rows(self._sequences([plan], access), [plan]).drop("query_id")
        return (found.orderBy("seq_id", "start", "end") if ordered else found), plan.metrics

    def plan_many(self, queries: Sequence[Sequence], params: SearchParams) -> list[SearchPlan]:
        """The plans of all queries, with one job for all their tokens' frequencies."""
        total, size = self.index.count()
        words = self._vocabulary() if self.costs.needs_vocabulary else None
        inserted = list(self.costs.insertions(words)[0])
        rows = {q: list(self.costs.row(q, words)[0]) for query in queries for q in query}
        known = self.index.frequencies(list(dict.fromkeys([t for r in rows.values() for t in r] + inserted)))
        return [make_plan(q, self.costs, params, lambda tokens: {t: known[t] for t in tokens if t in known}, total, size, lambda: words) for q in queries]

    def search_many(self, queries: Sequence[Sequence], params: SearchParams, access: str = "auto", first: int = 0) -> DataFrame:
        """(query_id, seq_id, start, end, distance) of all queries in one pass; ``query_id`` is the place in ``queries``, from ``first`` on."""
        plans = self.plan_many(queries, params)
        return match_rows(self._sequences(plans, access), plans, first=first)

    def search_table(self, queries: DataFrame, params: SearchParams, access: str = "auto", id_col: str = "query_id", tokens_col: str = "tokens", block: int = BLOCK) -> DataFrame:
        """The same for a table of queries, each row one with its own identifier; planned and searched ``block`` by ``block``.

        Null and empty queries have no match, nor has one that a threshold of its whole deletion would decline; a repeated row is
        a query of its own and gives its matches again.
        """
        kind = queries.schema[id_col].dataType.simpleString()
        rows = queries.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("t")).where("size(t) > 0").toLocalIterator()
        out = None
        while part := list(itertools.islice(rows, block)):
            ids, plans = [], []
            for r, p in zip(part, self._plans_or_none([r["t"] for r in part], params)):
                if p is not None:
                    ids.append(r["id"])
                    plans.append(p)
            if not plans:
                continue
            named = self.index.spark.createDataFrame(list(enumerate(ids)), f"query_id long, id {kind}")  # a block's, so of bounded size
            found = match_rows(self._sequences(plans, access), plans).join(F.broadcast(named), "query_id").select(F.col("id").alias(id_col), "seq_id", "start", "end", "distance")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.index.spark.createDataFrame([], f"`{id_col}` {kind}, {MATCH}")

    def _plans_or_none(self, queries: Sequence[Sequence], params: SearchParams) -> list[SearchPlan | None]:
        try:
            return self.plan_many(queries, params)
        except errors.ThresholdUnavailable:
            if len(queries) == 1:
                return [None]
            half = len(queries) // 2
            return self._plans_or_none(queries[:half], params) + self._plans_or_none(queries[half:], params)

    def search_exhaustive(self, query: Sequence, params: SearchParams) -> DataFrame:
        """The same by trying every start; declines nothing but bad thresholds."""
        plan = self.plan(query, params, anchored=False)
        return match_rows(self.index.corpus, [plan], exhaustive=True).drop("query_id").orderBy("seq_id", "start", "end")

    def candidates(self, query: Sequence, params: SearchParams) -> DataFrame:
        """(query_pos, token, seq_id, pos): every anchor that a search verifies."""
        plan = self.plan(query, params)
        kind = self.index.token_type
        names = {k: t for t, k in plan.numbers.items()}
        listed = [(i, names[k]) for i, near in zip(plan.selected, plan.neighbours) for k in np.flatnonzero(near[:-1]).tolist()]
        out = self.index.postings.join(self.index.spark.createDataFrame(listed, f"query_pos int, token {kind}"), "token").select("query_pos", "token", "seq_id", "pos")
        rest = [i for i, near in zip(plan.selected, plan.neighbours) if near[-1]]
        if rest:
            known = self.index.spark.createDataFrame([(t,) for t in plan.numbers], f"token {kind}")
            others = self.index.postings.join(known, "token", "left_anti").withColumn("query_pos", F.explode(F.array(*[F.lit(i) for i in rest])))
            out = out.unionByName(others.select("query_pos", "token", "seq_id", "pos"))
        return out


def locate(matches: DataFrame, sources: DataFrame, tokenizer: str) -> DataFrame:
    """(seq_id, distance, byte_start, byte_end, matched_text) of matches in ``sources`` (seq_id, text)."""
    hit = matches.join(sources.select("seq_id", "text"), "seq_id")
    first, last = byte_range(F.col("text"), tokenizer, F.col("start"), F.col("end"))
    hit = hit.select("seq_id", "distance", first.alias("byte_start"), last.alias("byte_end"), "text")
    return hit.withColumn("matched_text", F.expr("decode(substring(encode(text, 'utf-8'), byte_start + 1, byte_end - byte_start), 'utf-8')")).drop("text")
