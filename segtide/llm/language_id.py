"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD, with calibrated rejection.

Subwords are the 3- and 4-grams of the lower-cased text in which every
non-letter is a blank, kept where the inner characters are letters, and hashed
into ``buckets``. A text's vector is the mean of its subwords' embeddings. As
the layer above is linear, the trained embeddings and weights are folded into
one table of per-subword logits, which is all that executors get
(``buckets`` x languages floats, whatever the corpus holds).

Defined results: a null, empty or letterless text has language null,
confidence 0 and is rejected. Ties go to the language that sorts first. Every
input row gives one output row, repeated rows too; an empty table gives none.
Whole texts are read. Columns other than the identifier, text and (in
training) language are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import char_tables, chunks, codes, map_batches, mix64, sample_bound, sample_rank, texts_of


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  #: float32 (buckets, languages), embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float  #: a calibrated confidence below this is a rejection


def subword_ids(buf: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of every subword of an array of code points, by position within each length."""
    lower, kind = char_tables()
    letter = (kind[buf] & 3) == 1
    c = np.where(letter, lower[buf], np.uint32(32)).astype(np.uint64)
    if len(c) < 4:
        c = np.concatenate((c, np.full(4 - len(c), 32, np.uint64)))
        letter = np.concatenate((letter, np.zeros(4 - len(letter), bool)))
    at, ids = [], []
    k = np.uint64(1099511628211)
    three = (c[:-2] * k + c[1:-1]) * k + c[2:]
    p = np.flatnonzero(letter[1:-1])
    at.append(p + 1)
    ids.append(mix64(three[p]) % np.uint64(buckets))
    p = np.flatnonzero(letter[1:-2] & letter[2:-1])
    at.append(p + 1)
    ids.append(mix64(three[p] * k + c[p + 3]) % np.uint64(buckets))
    return np.concatenate(at), np.concatenate(ids).astype(np.int64)


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a blank before the first text, and the starts of the texts in it."""
    buf, starts, _ = codes(texts)
    return np.concatenate((np.array([32], np.uint32), buf)), starts + 1


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_per_language: int = 400, held_per_language: int = 1_200, buckets: int = 1 << 16, dim: int = 16, epochs: int = 6,
    rate: float = 0.5, keep: float = 0.999, max_threshold: float = 0.5, seed: int = 7,
) -> LanguageModel:
    """Fits the model on a bounded sample of labelled rows: about ``max_per_language`` of each language, at most four fifths of its rows.

    The sample is by hash of identifier and text, so it is the same at every run, and
    repeated rows count once; about ``held_per_language`` more rows are held out to fit the softmax temperature and the rejection
    threshold: the ``1 - keep`` quantile of the confidence of rightly judged
    held-out texts, at most ``max_threshold``.
    """
    counts = {r[0]: r[1] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col)).count().collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    row = [F.col(id_col), F.col(text_col)]  # identifiers may be null or repeated
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(sample_bound(max_per_language + held_per_language, counts[k])).cast("long"))])
    sample = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(sample_rank(*row, seed=seed) < share[F.col(lang_col)])
    sample = sample.select(F.col(lang_col).alias("l"), F.xxhash64(*row, F.lit(seed + 1)).alias("r"), F.col(text_col).alias("t")).dropDuplicates(["l", "r"])

    small, signed = (np.uint16, np.int16) if buckets <= 1 << 16 else (np.uint32, np.int32)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, n = [], []
            for t in texts_of(batch, "t"):
                buf, _ = _padded([t])
                u, c = np.unique(subword_ids(buf, buckets)[1], return_counts=True)
                ids.append(u.astype(small))
                n.append(c.astype(np.int32))
            return pa.record_batch([batch.column("l"), batch.column("r"), pa.array([i.view(signed) for i in ids], pa.list_(pa.from_numpy_dtype(signed))), pa.array(n, pa.list_(pa.int32()))], names=["l", "r", "ids", "n"])
        return step

    rows = map_batches(
        sample, make, f"l string, r long, ids array<{'short' if buckets <= 1 << 16 else 'int'}>, n array<int>",
    ).toArrow().sort_by([("r", "ascending"), ("l", "ascending")])
    label = np.array([languages.index(x) for x in rows.column("l").to_pylist()], dtype=np.int64)
    # views of the table's buffers: numbers are widened row by row, so the sample is in memory once
    ids = [np.asarray(x.values).view(small) for x in rows.column("ids")]
    cnt = [np.asarray(x.values) for x in rows.column("n")]
    return fit(ids, cnt, label, languages, most=max_per_language, buckets=buckets, dim=dim, epochs=epochs, rate=rate, keep=keep, max_threshold=max_threshold, seed=seed)


def fit(ids, cnt, label, languages, *, most, buckets, dim, epochs, rate, keep, max_threshold, seed) -> LanguageModel:
    """SGD over (subword ids, counts) rows in NumPy; also learns from thinned rows, as short texts look."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    E = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    Wt, b = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    usable = [i for i in range(len(ids)) if len(ids[i])]
    train_rows, held = [], []
    for language in range(k):  # spread evenly over the rows of each
        mine = [i for i in usable if label[i] == language]
        t = min(most, -(-4 * len(mine) // 5))
        for n, i in enumerate(mine):
            (train_rows if (n + 1) * t // len(mine) > n * t // len(mine) else held).append(i)

    def soft(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    steps, done = max(1, 2 * epochs * len(train_rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(train_rows):
            for thin in (False, True):
                u, c = ids[i], cnt[i].astype(np.float32)
                if thin and len(u) > 24:
                    pick = rng.choice(len(u), 24, replace=False)
                    u, c = u[pick], np.ones(24, np.float32)
                x = (c / c.sum()).astype(np.float32)
                v = x @ E[u]
                g = soft(v @ Wt + b)
                g[label[i]] -= 1
                lr = np.float32(rate * (1 - done / steps))
                back = Wt @ g
                Wt -= lr * np.outer(v, g)
                b -= lr * np.float32(0.1) * g
                E[u] -= lr * np.float32(min(len(u), 64)) * np.outer(x, back)
                done += 1
    table = E @ Wt
    held_counts = (cnt[i].astype(np.float32) for i in held)
    z = np.array([(c / c.sum()) @ table[ids[i]] + b for i, c in zip(held, held_counts)], dtype=np.float64).reshape(-1, k)
    y = label[held]
    temperature, threshold = 1.0, max_threshold
    if len(held):
        def nll(t):
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        temperature = float(grid[np.argmin([nll(t) for t in grid])])
        s = z / temperature
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        right = p.max(1)[p.argmax(1) == y]
        if len(right):
            threshold = float(min(max_threshold, np.quantile(right, 1 - keep)))
    return LanguageModel(tuple(languages), table.astype(np.float32), b, temperature, threshold)


def judge(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, calibrated confidence) of each text."""
    best, sure = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
    if not model.languages:
        return best, sure
    for i, j in chunks(texts):
        buf, starts = _padded(texts[i:j])
        at, ids = subword_ids(buf, len(model.logits))
        who = owners_of(at, starts)
        n = np.bincount(who, minlength=j - i).astype(np.float64)
        z = np.stack([np.bincount(who, model.logits[ids, k], minlength=j - i) for k in range(len(model.languages))], axis=1)
        z = (z / np.maximum(n, 1)[:, None] + model.bias) / model.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best[i:j] = np.where(n > 0, p.argmax(1), -1)
        sure[i:j] = np.where(n > 0, p.max(1), 0.0)
    return best, sure


def owners_of(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text of each subword by the position of its second character, which is a letter inside the text."""
    marks = np.zeros(max(int(at.max(initial=0)), int(starts.max(initial=0))) + 2, np.int32)
    np.add.at(marks, starts, 1)
    return np.cumsum(marks, dtype=np.int32)[at] - 1


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, confidence, accepted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, sure = judge(texts_of(batch, "t"), m)
            names = [m.languages[b] if b >= 0 else None for b in best]
            ok = (best >= 0) & (sure >= m.threshold)
            return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(sure), pa.array(ok)], names=[id_col, "language", "confidence", "accepted"])
        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col).alias("t")), make, f"`{id_col}` {kind}, language string, confidence double, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified with enough confidence, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, sure = judge([t or "" for t in batch.column(place).to_pylist()], shared.value)
            return batch.filter(pa.array((best >= 0) & (sure >= shared.value.threshold)))
        return step

    return map_batches(docs, make, docs.schema)
