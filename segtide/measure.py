"""Timings of one corpus and query: load, build, save, open, a cold and some warm searches, and a search with counted costs."""

from __future__ import annotations

import shutil
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from segtide.functions.costs import CosineCosts, CountingCosts, UnitCosts
from segtide.functions.tokens import TOKENIZERS
from segtide.operators.index import SegmentIndex
from segtide.plans.planner import SearchParams
from segtide.sources import synthetic
from segtide.sources.config import tokens_of
from segtide.sources.text import read_lines


def measure(spark: SparkSession, corpus: str, query: str | None = None, threshold: float = 0.0, warm_runs: int = 5, policy: str = "levenshtein") -> dict:
    """Milliseconds of each phase, the plan's figures and the number of matches, which all runs have to agree on."""
    if warm_runs < 1:
        raise ValueError("at least one warm run is needed")
    out: dict = {}

    def timed(name: str, f):
        t = time.perf_counter()
        value = f()
        out[f"{name}_ms"] = round((time.perf_counter() - t) * 1000, 3)
        return value

    tokens = tokens_of(query or synthetic.QUERY, "whitespace")
    folder = tempfile.mkdtemp(prefix="segtide-measure-", dir=Path(corpus).resolve().parent)
    try:
        lines = read_lines(spark, corpus)
        out["sequences"] = timed("corpus_load", lines.count)
        built = timed("build", lambda: SegmentIndex.build(lines.select("seq_id", TOKENIZERS["whitespace"](F.col("text")).alias("tokens")), tokenizer="whitespace"))
        timed("save", lambda: built.save(f"{folder}/index"))
        index = timed("open", lambda: SegmentIndex.open(spark, f"{folder}/index"))
        costs = UnitCosts()
        if policy == "cosine":
            words = [r["token"] for r in index.vocabulary.select("token").collect()]
            costs = CosineCosts(timed("embedding", lambda: synthetic.embeddings(words)))

        def run(costs) -> int:
            return index.searcher(costs).search(tokens, SearchParams(threshold)).count()

        counts = {timed("cold_search", lambda: run(costs))}
        warm = []
        for _ in range(warm_runs):
            t = time.perf_counter()
            counts.add(run(costs))
            warm.append((time.perf_counter() - t) * 1000)
        out |= {"warm_mean_ms": round(statistics.fmean(warm), 3), "warm_median_ms": round(statistics.median(warm), 3), "warm_min_ms": round(min(warm), 3)}
        counted = CountingCosts(costs)
        counts.add(run(counted))
        if len(counts) > 1:
            raise ValueError(f"the runs disagree on the number of matches: {sorted(counts)}")
        metrics = index.searcher(costs).search_with_metrics(tokens, SearchParams(threshold))[1]
        return out | {
            "matches": counts.pop(), "eta_was_adjusted": metrics.adjusted_eta is not None, "selected_query_positions": metrics.selected_query_positions,
            "generated_candidates": metrics.generated_candidates, "substitutions_asked": counted.substitutions_asked, "tokens": index.total_tokens, "vocabulary": index.vocabulary_size,
        }
    finally:
        shutil.rmtree(folder, ignore_errors=True)
