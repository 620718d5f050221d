"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's weight is its share of all tokens to the power ``alpha``,
normalised. ``alpha`` in [0, 1] is found by bisection: the largest that gives
weights of at least ``min_entropy`` (of the greatest possible, log of the
number of sources) or the smallest at which no source is repeated more than
``max_repeats`` times; where both are set the repetition limit has the last
word. If even ``alpha`` = 1 repeats a source more often, the budget asks for it
and the weights are the shares.

Each source gets ``round(weight * budget)`` tokens: its documents are permuted
in each epoch by ``md5(seed:epoch:id)`` and taken while the tokens taken before
are fewer than the source's. Taken documents are cut into ``blocks`` by the
part of the source's tokens that lies before them, so that every block holds
the sources by weight, and permuted within the block by ``md5(seed:block:epoch:id)``.

Order within a source is a prefix sum over hash buckets: sums per bucket first,
then rows within a bucket, so that no task sorts a whole source however hot.

Defined results: a document without tokens, or with a null text, takes no part;
a null source is a source of its own (SQL groups nulls together). Repeated rows
are documents of their own and are repeated in the mixture; rows of one
identifier keep their order by token count. With no tokens at all or a budget
of 0 the mixture is empty. Other columns are kept where rows are returned and
may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segtide.llm.common import Scratch

STEPS = 60
#: Tables of one row a source are broadcast up to this many rows, and joined by shuffles beyond.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """Tokens between blanks, tabs and line ends."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long")


def weights(tokens: Sequence[int], alpha: float) -> list[float]:
    total = sum(tokens)
    powers = [math.pow(t / total, alpha) for t in tokens]
    scale = math.fsum(powers)
    return [p / scale for p in powers]


def find_alpha(tokens: Sequence[int], budget: float, min_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent by bisection; ``tokens`` are the positive token counts of the sources."""
    if len(tokens) < 2 or sum(tokens) <= 0:
        return 1.0

    def bisect(good_at_0: bool, good) -> float:
        """The border of ``good``, approached from its good side."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            if good(mid) == good_at_0:
                low = mid
            else:
                high = mid
        return low if good_at_0 else high

    alpha = 1.0
    if min_entropy is not None:
        def even(a: float) -> bool:
            return -math.fsum(w * math.log(w) for w in weights(tokens, a) if w > 0) >= min_entropy * math.log(len(tokens))
        alpha = 1.0 if even(1.0) else bisect(True, even)
    if max_repeats is not None:
        def rare(a: float) -> bool:
            return max(w * budget / t for w, t in zip(weights(tokens, a), tokens)) <= max_repeats
        if not rare(alpha):
            alpha = 1.0 if not rare(1.0) else bisect(False, rare)
    return alpha


def _order(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _count(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str) -> DataFrame:
    counted = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("s"), words(F.col(text_col)).alias("n")).where("n > 0")
    return scratch.write(counted, "counted")  # texts are read once


def _goals(counted: DataFrame, budget_share: float, min_entropy: float | None, max_repeats: float | None) -> DataFrame:
    """(s2, size, goal): tokens of each source that has any, and those it is to get."""
    sizes = counted.groupBy("s").agg(F.sum("n").alias("n")).collect()  # one row a source
    sizes.sort(key=lambda r: (r["n"], r["s"] is not None, r["s"]))
    budget = budget_share * sum(r["n"] for r in sizes)
    tokens = [r["n"] for r in sizes]
    shares = weights(tokens, find_alpha(tokens, budget, min_entropy, max_repeats)) if sizes else []
    goals = [(r["s"], r["n"], int(math.floor(w * budget + 0.5))) for r, w in zip(sizes, shares)]
    return _by_source(counted.sparkSession, goals, f"s2 {counted.schema['s'].dataType.simpleString()}, size long, goal long").where("goal > 0")


def _by_source(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table


def _placed(taken: DataFrame, seed: int) -> DataFrame:
    """Adds ``o``, the place in the epoch's permutation, and ``at``, the source's tokens before it; rows alike share a place."""
    taken = taken.withColumn("o", _order(seed, F.col("epoch"), F.col("id"))).withColumn("bucket", F.substring("o", 1, 3))
    sums = taken.groupBy("s", "epoch", "bucket").agg(F.sum("n").alias("b"))
    ahead = F.sum("b").over(Window.partitionBy("s", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(F.col("s").alias("s3"), F.col("epoch").alias("e3"), F.col("bucket").alias("b3"), F.coalesce(ahead, F.lit(0)).alias("before"))
    here = Window.partitionBy("s", "epoch", "bucket").orderBy("o", "id", "n")
    inside = F.sum("n").over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n").over(Window.partitionBy("s", "epoch", "bucket", "o", "id", "n"))
    rows = taken.withColumn("inside", inside).join(before, F.col("s").eqNullSafe(F.col("s3")) & (F.col("epoch") == F.col("e3")) & (F.col("bucket") == F.col("b3")))
    return rows.withColumn("at", F.col("epoch") * F.col("size") + F.col("before") + F.col("inside")).where("at < goal")


def plan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.0,
    min_entropy: float | None = 0.98, max_repeats: float | None = 4.0, blocks: int = 64, seed: int = 17,
) -> DataFrame:
    """(id, source, epoch, block, key, tokens): a row each time that a document is taken; ordered by (block, key) it is the mixture.

    ``budget_share`` is the budget as a share of all tokens.
    """
    counted = _count(docs, Scratch(docs.sparkSession), id_col, text_col, source_col)
    taken = counted.join(_goals(counted, budget_share, min_entropy, max_repeats), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    rows = _placed(taken.withColumn("epoch", F.explode(F.expr("sequence(0, cast((goal - 1) div size as int))"))), seed)
    rows = rows.withColumn("block", F.expr(f"cast(at * {int(blocks)} div goal as int)"))
    return rows.select(F.col("id").alias(id_col), F.col("s").alias(source_col), "epoch", "block", _order(seed, F.col("block"), F.col("epoch"), F.col("id")).alias("key"), F.col("n").alias("tokens"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.0,
    min_entropy: float | None = 0.98, max_repeats: float | None = 4.0, seed: int = 17,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan`` takes it.

    Up to ``BROADCAST_SOURCES`` sources, texts are not shuffled: a source's whole epochs take every row, and of its
    last epoch's permutation the rows up to one place, which is found first.
    """
    counted = _count(docs, Scratch(docs.sparkSession), id_col, text_col, source_col)
    goals = _goals(counted, budget_share, min_entropy, max_repeats).withColumn("epoch", F.expr("goal div size"))
    last = _placed(counted.join(goals, F.col("s").eqNullSafe(F.col("s2"))).where("goal % size > 0"), seed)
    last = last.groupBy(F.col("s").alias("s4")).agg(F.max(F.struct("o", F.col("id").alias("i"), F.col("n").alias("k"))).alias("border"))
    limits = goals.join(last, F.col("s2").eqNullSafe(F.col("s4")), "left").select("s2", "epoch", "border").collect()  # one row a source
    border = _by_source(docs.sparkSession, limits, f"s2 {docs.schema[source_col].dataType.simpleString()}, epoch long, border struct<o string, i {docs.schema[id_col].dataType.simpleString()}, k long>")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("s"), words(F.col(text_col)).alias("n"))
    own = F.struct(_order(seed, F.col("epoch"), F.col("id")).alias("o"), F.col("id").alias("i"), F.col("n").alias("k"))
    times = F.col("epoch") + F.when(own <= F.col("border"), 1).otherwise(0)
    rows = whole.where("n > 0").join(border, F.col("s").eqNullSafe(F.col("s2"))).withColumn("times", times.cast("int")).where("times > 0")
    return rows.select("row", F.explode(F.expr("sequence(1, times)")).alias("again")).select("row.*")
