"""Quality rules: robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. Per group, the minimum
covariance determinant estimate of centre and scatter is found by concentration
steps over all of the group's rows, from several deterministic starts; the start
that ends with the least determinant wins, its scatter is made consistent for
the normal distribution and reweighted once. Rows whose squared Mahalanobis
distance is above the chi-square quantile ``1 - tail`` are rejected.

A concentration step is two aggregations over the table of vectors: counts of
distances in ``bins`` give the distance below which ``support`` of the rows
lie, and sums over those rows give the next centre and scatter. Rows are never
gathered by group, so a hot source is no hot task, and everything that is
iterated is a table of one row per group and start.

Rows of a (language, source) with fewer than ``min_rows`` rows form one group a
language; where that is too small too, they form one group of all languages;
if that is too small too, its rows are judged by the estimate of all valid rows of the table. Only a
table of fewer than ``min_rows`` valid rows gives none (null distance, kept). A scatter gets
``ridge`` on its diagonal, so that groups of equal rows have a distance too.

Defined results: a null or empty text, or one without a letter, digit or mark,
is rejected with a null distance. A null language or source is a value of its
own. A distance at the limit is kept. Whole texts are read; every row gives a
row, repeated rows the same; an empty table gives no rows; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import Scratch, char_tables, chunks, codes, map_batches, owners, span_hashes, texts_of

STATISTICS = ("length", "word_length", "marks", "capitals", "repetition", "line_length")
D = len(STATISTICS)
PRIOR = 30.0
#: The group of all valid rows.
ALL = "*"
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def chi2_cdf(x: float, k: float) -> float:
    """Regularised lower incomplete gamma function of (k / 2, x / 2)."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 10.0 * k + 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors (n, D), valid): a text with neither letters, digits nor marks is not valid.

    log length in words; log letters and digits a word; log odds of marks, of
    capitals among letters and of words said before in the text (against its
    length, as longer texts repeat more); log words a line. All as if ``PRIOR``
    words of ordinary prose came first, as short texts vary more by chance.
    """
    x, ok = np.zeros((len(texts), D)), np.zeros(len(texts), bool)
    _, kind = char_tables()
    for i, j in chunks(texts):
        buf, begin, end = codes(texts[i:j])
        k = kind[buf]
        base = k & 3

        def per_text(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return (total[end] - total[begin]).astype(np.float64)

        solid = base != 3
        starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
        ends = np.flatnonzero(solid & np.concatenate((~solid[1:], [True]))) + 1
        who = owners(starts, begin)
        n = j - i
        words = np.bincount(who, minlength=n).astype(np.float64)
        key = np.sort(span_hashes(buf, starts, ends) >> np.uint64(24) | (who.astype(np.uint64) << np.uint64(40))) if len(starts) else np.zeros(0, np.uint64)
        fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n).astype(np.float64)
        letters, alnum = per_text(base == 1), per_text((base == 1) | (base == 2))
        marks, capitals = per_text(base == 0), per_text((k & 4) > 0)
        lines = per_text(buf == 10) + 1
        w = np.maximum(words, 1)
        x[i:j, 0] = np.log(w + PRIOR)
        x[i:j, 1] = np.log((alnum + 5 * PRIOR) / (w + PRIOR))
        x[i:j, 2] = np.log((marks + 0.2 * PRIOR) / (alnum + 5 * PRIOR))
        x[i:j, 3] = np.log((capitals + 0.2 * PRIOR) / (letters - capitals + 5 * PRIOR))
        x[i:j, 4] = np.log((words - distinct + 0.3 * PRIOR) / (distinct + PRIOR)) - 0.25 * np.log(w + PRIOR)
        x[i:j, 5] = np.log((w + PRIOR) / (lines + 0.03 * PRIOR))
        ok[i:j] = words > 0
    return x, ok


def _vectors(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, ok = statistics(texts_of(batch, "t"))
            return pa.record_batch([batch.column("id"), batch.column("lang"), batch.column("source"), pa.array(ok), *[pa.array(x[:, d]) for d in range(D)]], names=["id", "lang", "source", "ok", *[f"x{d}" for d in range(D)]])
        return step

    kinds = {n: docs.schema[c].dataType.simpleString() for n, c in (("id", id_col), ("lang", lang_col), ("source", source_col))}
    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("t"))
    return map_batches(picked, make, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", ok boolean, " + ", ".join(f"x{d} double" for d in range(D)))


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``g``: the key of the group whose estimate judges a row, ``ALL`` for all rows'; null where the table is too small."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    sizes = rows.where("ok").groupBy(part("lang").alias("gl"), part("source").alias("gs")).agg(F.count("*").alias("n"))
    small = sizes.where(f"n < {min_rows}").groupBy("gl").agg(F.sum("n").alias("nl"))
    rest = small.where(f"nl < {min_rows}").agg(F.coalesce(F.sum("nl"), F.lit(0)).alias("na"))
    rest = rest.join(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nt")))  # one row
    choice = sizes.join(small, "gl", "left").crossJoin(rest).select(
        "gl", "gs",
        F.when(F.col("n") >= min_rows, F.concat_ws("\x1f", "gl", "gs")).when(F.col("nl") >= min_rows, F.col("gl")).when(F.col("na") >= min_rows, F.lit("")).when(F.col("nt") >= min_rows, F.lit(ALL)).alias("g"),
    )
    return rows.withColumns({"gl": part("lang"), "gs": part("source")}).join(choice, ["gl", "gs"], "left").drop("gl", "gs")


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the joined m0.. by the joined precision p{i}_{j}."""
    e = F.lit(0.0)
    for i, j in PAIRS:
        e = e + (1.0 if i == j else 2.0) * F.col(f"p{i}_{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return e


_STATE = ["g string", "start int", "logdet double"] + [f"m{d} double" for d in range(D)] + [f"p{i}_{j} double" for i, j in PAIRS]


def _state(frame: pd.DataFrame, scale: float, ridge: np.ndarray) -> pd.DataFrame:
    """Centre, precision and log determinant from counts and sums s{i}, q{i}_{j} taken about c{i}; ``scale`` multiplies the scatter."""
    out = []
    for r in frame.to_dict("records"):
        n = r["n"]
        m = np.array([r[f"s{d}"] for d in range(D)]) / n
        c = np.zeros((D, D))
        for i, j in PAIRS:
            c[i, j] = c[j, i] = r[f"q{i}_{j}"] / n - m[i] * m[j]
        c = c * scale + np.diag(ridge)
        p = np.linalg.inv(c)
        out.append({"g": r["g"], "start": r["start"], "logdet": float(np.linalg.slogdet(c)[1])} | {f"m{d}": float(r[f"c{d}"] + m[d]) for d in range(D)} | {f"p{i}_{j}": float(p[i, j]) for i, j in PAIRS})
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STATE])


def _sums() -> list:
    """Count and sums about the group's reference point c0.., which keeps them well conditioned."""
    x = [F.col(f"x{d}") - F.col(f"c{d}") for d in range(D)]
    return [F.count("*").alias("n")] + [F.first(f"c{d}").alias(f"c{d}") for d in range(D)] + [F.sum(x[d]).alias(f"s{d}") for d in range(D)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in PAIRS]


def estimate(rows: DataFrame, scratch: Scratch, *, support: float, ridge: float, steps: int, bins: int, reweight: float) -> DataFrame:
    """(g, m0.., p0_0..): the estimate of each group of ``rows`` (g, x0..)."""
    diag = np.full(D, ridge)

    def states(sums: DataFrame, scale: float, name: str) -> DataFrame:
        def run(frames):
            for f in frames:
                if len(f):
                    yield _state(f, scale, diag)
        return scratch.write(sums.coalesce(1).mapInPandas(run, ", ".join(_STATE)), name, small=True)

    # starts: all rows; rows about the median in units of the quartile range, by greatest and by summed deviation
    level = [F.percentile_approx(f"x{d}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"v{d}") for d in range(D)]
    centres = scratch.write(rows.groupBy("g").agg(*level).select("g", *[F.col(f"v{d}")[1].alias(f"c{d}") for d in range(D)], *[F.greatest(F.col(f"v{d}")[2] - F.col(f"v{d}")[0], F.lit(math.sqrt(ridge))).alias(f"w{d}") for d in range(D)]), "centres", small=True)
    base = rows.join(centres, "g")
    z = [F.abs((F.col(f"x{d}") - F.col(f"c{d}")) / F.col(f"w{d}")) for d in range(D)]
    total = z[0]
    for y in z[1:]:
        total = total + y
    first = base.withColumn("dev", F.array(F.lit(0.0), F.greatest(*z), total)).select("*", F.posexplode("dev").alias("start", "v"))
    edge = first.groupBy("g", "start").agg(F.percentile_approx("v", 0.5, 1000).alias("t"))
    now = states(first.join(scratch.write(edge, "edge0", small=True), ["g", "start"]).where("v <= t").groupBy("g", "start").agg(*_sums()), 1.0, "state")
    log_width = 60.0 / bins  # bins of the logarithm of the distance, from exp(-30) to exp(30)
    sizes = scratch.write(rows.groupBy("g").agg(F.count("*").alias("rows")), "sizes", small=True)
    for step in range(steps):
        far = base.join(now.select("g", "start", *[F.col(c.split()[0]) for c in _STATE[3:]]), "g").withColumn("d2", _distance())
        far = far.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.log(F.greatest("d2", F.lit(1e-13))) + 30.0) / log_width))).cast("int"))
        counts = far.groupBy("g", "start", "bin").agg(F.count("*").alias("k")).groupBy("g", "start").agg(F.array_sort(F.collect_list(F.struct("bin", "k"))).alias("h")).join(sizes, "g")
        upto = F.expr(f"aggregate(h, named_struct('n', 0L, 'b', -1), (a, e) -> if(a.n >= ceil({support} * rows), a, named_struct('n', a.n + e.k, 'b', e.bin))).b")
        limit = scratch.write(counts.select("g", "start", upto.alias("upto")), f"limit{step}", small=True)
        new = states(far.join(limit, ["g", "start"]).where("bin <= upto").groupBy("g", "start").agg(*_sums()), 1.0, f"state{step}")
        old, now = now, new
        if step >= 3:
            moved = old.select("g", "start", F.col("logdet").alias("old")).join(now, ["g", "start"]).agg(F.max(F.abs(F.col("old") - F.col("logdet")))).first()[0]
            if moved is None or moved < 1e-2:
                break
    best = now.groupBy("g").agg(F.min_by(F.struct(*[c.split()[0] for c in _STATE]), F.struct("logdet", "start")).alias("b")).select("b.*")
    best = scratch.write(best, "best", small=True)
    cut = chi2_quantile(support, D)
    scale = support / chi2_cdf(cut, D + 2)
    limit = chi2_quantile(reweight, D) * scale
    inner = base.join(best.drop("logdet"), "g").where(_distance() <= limit).groupBy("g", "start").agg(*_sums())
    final = states(inner, reweight / chi2_cdf(chi2_quantile(reweight, D), D + 2), "final")
    return final.drop("start", "logdet")


def reject(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    support: float = 0.75, tail: float = 1e-12, min_rows: int = 100, ridge: float = 0.01, steps: int = 10, bins: int = 6000, reweight: float = 0.975,
) -> DataFrame:
    """(id, lang, source, distance, kept) for every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(_vectors(docs, id_col, text_col, lang_col, source_col), "vectors")
    rows = scratch.write(_grouped(rows, min_rows), "grouped")
    sample = rows.where("ok AND g IS NOT NULL")
    if not sample.where(F.col("g") == ALL).isEmpty():  # all rows count for that group, and for their own
        every = rows.where("ok")
        sample = sample.where(F.col("g") != ALL).unionByName(every.withColumn("g", F.lit(ALL)))
    found = estimate(sample, scratch, support=support, ridge=ridge, steps=steps, bins=bins, reweight=reweight)
    judged = rows.join(found, "g", "left").withColumn("d2", F.when(F.col("ok"), _distance()))
    limit = chi2_quantile(1 - tail, D)
    return judged.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("source").alias(source_col), F.sqrt(F.when(F.col("d2").isNotNull(), F.greatest("d2", F.lit(0.0)))).alias("distance"), (F.col("ok") & (F.col("d2").isNull() | (F.col("d2") <= limit))).alias("kept"))
