"""One query over a stream of sequences: every sequence is judged by itself, so the search is a stateless map.

There are no frequencies to plan by in a stream, so it tries every start; the
policy must describe its costs without a vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.functions.costs import CostPolicy
from segtide.operators.search import match_rows
from segtide.plans.planner import SearchParams, make_plan


def search_stream(sequences: DataFrame, query: Sequence, costs: CostPolicy, params: SearchParams, *, id_col: str = "seq_id", tokens_col: str = "tokens") -> DataFrame:
    """(seq_id, start, end, distance), batch or streaming, in no order."""
    if costs.needs_vocabulary:
        raise ValueError("costs given as functions need a vocabulary, which a stream does not have")
    plan = make_plan(query, costs, params, lambda _: {}, 0, 0, anchored=False)
    rows = sequences.select(F.col(id_col).cast("long").alias("seq_id"), F.col(tokens_col).alias("tokens"))
    return match_rows(rows, [plan], exhaustive=True).drop("query_id")
