"""What must not grow faster than the input."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from segtide.functions.costs import UnitCosts, cosine_rows, unit_vector
from segtide.functions.tokens import characters, flatten, whitespace
from segtide.operators.index import SegmentIndex
from segtide.plans.planner import SearchParams
from segtide.queries import QUERIES
from segtide.sources.shared import shared_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_that_tokenise_side_by_side_do_not_hinder_each_other(spark):
    rows = spark.range(4000, numPartitions=8).select(F.concat_ws(" \t", *[F.concat(F.lit("word"), F.col("id") % k) for k in range(2, 302)]).alias("t")).localCheckpoint()
    space = r"[^\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    extracted = F.regexp_extract_all(F.col("t"), F.lit(space), 0)

    def seconds(column):
        t = time.perf_counter()
        rows.select(column).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    assert rows.where(~whitespace(F.col("t")).eqNullSafe(extracted)).count() == 0
    for column in (whitespace(F.col("t")), flatten(F.col("t"))):
        seconds(column), seconds(extracted)
        assert min(seconds(column) for _ in range(3)) < 0.6 * min(seconds(extracted) for _ in range(3))


def test_tokens_where_texts_begin_and_end(spark):
    odd = ["", " ", "a", " a ", "\u3000x y\x85", "a\x1cb", "\x1c", "é🎉 z\n\n", None, "\na"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    got = rows.select(whitespace(F.col("t")), characters(F.col("t")), flatten(F.col("t"))).collect()
    assert [r[0] for r in got] == [[], [], ["a"], ["a"], ["x", "y"], ["a\x1cb"], ["\x1c"], ["é🎉", "z"], None, ["a"]]
    assert [r[1] for r in got] == [None if t is None else list(t) for t in odd]
    assert [r[2] for r in got] == [None if t is None else " ".join(t.split()) for t in odd]


def test_searches_of_a_table_move_nothing_of_its_size(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 50}" for k in range(40)) + " the with of and x") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(16, "w0 w1 w2 w3 w4 w5"), (17, "the with of and x")]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = shared_dir(spark).removeprefix("file:").replace("//", "/")
    tables = lambda: {d for d, _, _ in os.walk(folder) if d.rsplit("/", 1)[-1] in ("corpus", "postings")}
    before = tables()
    assert {r["reason"]: r["candidates"] for r in QUERIES["declined_searches"](spark, str(tmp_path)).collect()} == {"SearchTooExpensive": 200, "ThresholdUnavailable": None}
    for name in ("widened_search", "asymmetric_indel_search", "batch_search", "exact_segment_search"):
        found = QUERIES[name](spark, str(tmp_path))
        assert "rangepartitioning" not in plan_of(found) and plan_of(found).count("split(text") == 1, name
        assert found.count() or name in ("asymmetric_indel_search", "exact_segment_search")
    assert tables() == before


def test_postings_of_a_frequent_token_are_many_tasks(spark, tmp_path):
    index = SegmentIndex.build(spark.range(4000).select(F.col("id").alias("seq_id"), F.array_repeat(F.lit("the"), 20).alias("tokens")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        saved = index.save(str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [r["count"] for r in saved.postings.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 80_000 and max(sizes) < 40_000
    assert saved.inverted and saved.searcher(UnitCosts()).search(["the", "the"], SearchParams(0.0), access="postings").count() == 4000 * 19


def test_cosine_costs_read_the_vectors_once_for_thousands_of_queries(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1300, 4)).astype(np.float32)
    x[7] = x[3]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "token long, embedding array<float>")
    costs = cosine_rows(table.where("token < 1100"), table)
    assert plan_of(costs).count("MapInArrow") == 1
    rows = costs.toPandas()
    got = np.full((1100, 1300), np.nan, np.float32)
    got[rows.query_token, rows.token] = rows.cost
    u = np.stack([unit_vector(v) for v in x])
    want = np.clip(1 - u[:1100] @ u.T, 0, 1)
    np.fill_diagonal(want, 0)
    assert len(rows) == 1100 * 1300 and np.abs(got - want).max() < 1e-6 and (np.diag(got) == 0).all()


def test_cosine_costs_are_rounded_as_sql_rounds(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)] if i % 3 else [1.0, float(i % 2), 0.0, 0.0]) for i in range(120)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    all_of = spark.createDataFrame(rows, "token long, embedding array<float>")
    want = cosine_rows(all_of.where("token % 20 = 0"), all_of).withColumn("cost", F.round(F.col("cost").cast("double"), 3))
    got = QUERIES["cosine_costs"](spark, str(tmp_path))
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 720
    # ties: single floats that are sixteenths
    ties = spark.createDataFrame([(k / 16,) for k in range(17)], "c float").select(F.round(F.col("c").cast("double"), 3).alias("a"), (F.floor(F.col("c").cast("double") * 1000 + 0.5) / F.lit(1000.0)).alias("b"))
    assert ties.where("a <> b").count() == 0
