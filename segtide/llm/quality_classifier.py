"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Tokens are runs of letters and digits (as written, as case tells junk from
prose) and runs of other marks. A bigram of twice the same token is one feature,
whatever the token. The features of a text are the indicators of
its hashed token unigrams and bigrams, scaled by the classes' log-count ratios
and by the text's norm. A linear hinge-loss model is fitted to them by dual
coordinate descent and folded with the ratios into one weight per bucket, which
is all that executors get (``buckets`` floats, whatever the corpus holds).

The model is fitted on a bounded sample of labelled rows, ``max_per_class`` of
each class, chosen by hash of identifier, each text once. A fifth is held out of ratios and fit; the threshold is
the greatest that keeps ``keep`` of the held-out good texts, at most 0.

Defined results: a null, empty or blank text has no feature and is not kept,
with a null score. Whole texts are read. Every row gives a row, repeated rows
the same; a score at the threshold is kept; an empty table gives no rows;
without labels of both classes every text with a token is kept with score 0.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import char_tables, chunks, codes, map_batches, mix64, owners, span_hashes, texts_of
from segtide.llm.toxicity import labelled_sample


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  #: float32 by bucket
    norms: np.ndarray  #: squared ratios, float32 by bucket
    bias: float
    threshold: float


def indicators(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, bucket) of every distinct feature, sorted."""
    _, kind = char_tables()
    buf, begin, _ = codes(texts)
    k = (kind[buf] & 3).astype(np.int8)
    group = np.where((k == 1) | (k == 2), 1, np.where(k == 3, 0, 2)).astype(np.int8)
    edge = np.flatnonzero(np.diff(group, prepend=np.int8(0)))
    ends = np.append(edge[1:], len(buf))
    words = group[edge] > 0
    starts, ends = edge[words], ends[words]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, who = span_hashes(buf, starts, ends), owners(starts, begin)
    pair = mix64(np.where(h[:-1] == h[1:], np.uint64(0), h[:-1] * np.uint64(3) + h[1:]))[who[:-1] == who[1:]]
    both = np.concatenate(((h % np.uint64(buckets)).astype(np.int64), (pair % np.uint64(buckets)).astype(np.int64)))
    of = np.concatenate((who, who[:-1][who[:-1] == who[1:]]))
    key = np.sort(of * buckets + both)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key // buckets, key % buckets


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, *, c: float, epochs: int, seed: int, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of min ½|w|² + c Σ max(0, 1 - y w·x), the bias as the weight of a constant feature."""
    rng = np.random.default_rng(seed)
    w, b, a = np.zeros(dim), 0.0, np.zeros(len(rows))
    q = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1.0
            pg = min(g, 0.0) if a[i] == 0 else max(g, 0.0) if a[i] == c else g
            if pg:
                worst = max(worst, abs(pg))
                new = min(max(a[i] - g / q[i], 0.0), c)
                d = (new - a[i]) * y[i]
                a[i] = new
                w[rows[i]] += d * values[i]
                b += d
        if worst < tol:
            break
    return w, b


def fit(rows: list[np.ndarray], y: np.ndarray, *, buckets: int, c: float = 1.0, epochs: int = 30, smooth: float = 1.0, keep: float = 0.995, seed: int = 5) -> QualityModel:
    """``rows``: each text's distinct buckets; ``y``: 1 good, 0 bad."""
    held = np.arange(len(rows)) % 5 == 0
    if not (y[~held] == 1).any() or not (y[~held] == 0).any():
        return QualityModel(np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), 0.0, 0.0)
    p, q = np.full(buckets, smooth), np.full(buckets, smooth)
    for i in np.flatnonzero(~held):  # the threshold is fitted on rows that the ratios haven't seen
        (p if y[i] else q)[rows[i]] += 1.0
    seen = p + q > 2 * smooth
    ratio = np.where(seen, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)

    def scaled(r):
        v = ratio[r]
        return v / max(float(np.sqrt(v @ v)), 1e-9)

    on = np.flatnonzero(~held)
    w, b = dual_coordinate_descent([rows[i] for i in on], [scaled(rows[i]) for i in on], np.where(y[on] == 1, 1.0, -1.0), buckets, c=c, epochs=epochs, seed=seed)
    model = QualityModel((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(b), 0.0)
    good = np.array([w[rows[i]] @ scaled(rows[i]) + b for i in np.flatnonzero(held & (y == 1))])
    limit = float(min(0.0, np.quantile(good, 1 - keep))) if len(good) else 0.0
    return QualityModel(model.weights, model.norms, model.bias, limit)


def score(texts: list[str], model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of features) of each text."""
    out, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, j in chunks(texts):
        who, b = indicators(texts[i:j], len(model.weights))
        n = j - i
        norm = np.sqrt(np.bincount(who, model.norms[b], minlength=n))
        out[i:j] = np.bincount(who, model.weights[b], minlength=n) / np.maximum(norm, 1e-9) + model.bias
        count[i:j] = np.bincount(who, minlength=n)
    return out, count


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_per_class: int = 3_000, buckets: int = 1 << 20, c: float = 1.0, epochs: int = 30, keep: float = 0.995, seed: int = 5,
) -> QualityModel:
    """Fits the model on about ``max_per_class`` labelled rows of each class at most."""
    sample = labelled_sample(docs, labels, label_col, {1: max_per_class, 0: max_per_class}, id_col=id_col, text_col=text_col, seed=seed)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "t")
            rows = [indicators([t], buckets)[1].astype(np.int32) for t in texts]
            return pa.record_batch([batch.column("y"), batch.column("h"), pa.array(rows, pa.list_(pa.int32()))], names=["y", "h", "rows"])
        return step

    got = map_batches(sample.select("y", F.xxhash64("t", F.lit(seed)).alias("h"), "t"), make, "y int, h long, rows array<int>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy()
    rows = [np.asarray(r.values) for r in got.column("rows")]
    use = [i for i in range(len(rows)) if len(rows[i])]
    return fit([rows[i] for i in use], y[use].astype(np.int64), buckets=buckets, c=c, epochs=epochs, keep=keep, seed=seed)


def classify(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, kept) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s, n = score(texts_of(batch, "t"), m)
            return pa.record_batch([batch.column(0), pa.array(s, mask=n == 0), pa.array((n > 0) & (s >= m.threshold))], names=[id_col, "score", "kept"])
        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col).alias("t")), make, f"`{id_col}` {kind}, score double, kept boolean")
