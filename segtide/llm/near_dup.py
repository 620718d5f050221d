"""SimHash near-duplicates by deletion-variant signatures.

A document's signature has ``BITS`` bits over its distinct lower-cased words. It is
cut into segments; two signatures that differ in at most ``2 * segments - 1``
bits have a segment that differs in at most one. Every segment is indexed with
each of its bits in turn left out (a wildcard), so that segments one bit apart
share a key: pairs are found by equality of keys, one segment after another,
and verified by the distance of the whole signatures, up to ``distance``. There
are as many segments as ``distance`` needs, so no pair within it is missed.

Documents of equal signature are one node, so a thousand exact copies are one
row of the index. Within a key's run, nodes are compared with the run's leaders;
members of one leader's ball need no comparison with each other and balls
farther apart than the triangle inequality allows none either: what is dropped
is only edges between nodes that are connected anyway.

Defined results: null and empty texts, and texts without a word, are no
duplicates of anything; a null identifier takes no part. Of each connected group
the least identifier stays. Rows that repeat an identifier are one document: they link
what is near to any of them, and stay or go together. Whole texts are read; an empty table gives no rows; other columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import Scratch, char_tables, chunks, codes, components, keyed_runs, map_batches, owners, runs, simhash, span_hashes, texts_of

BITS = 128


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures (n, 2) of uint64, number of distinct words) of each text."""
    sig, count = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), np.int64)
    lower, kind = char_tables()
    for i, j in chunks(texts):
        buf, begin, _ = codes(texts[i:j])
        k = kind[buf] & 3
        starts, ends = runs((k == 1) | (k == 2))
        if not len(starts):
            continue
        h, who = span_hashes(lower[buf], starts, ends), owners(starts, begin)
        order = np.lexsort((h, who)) if j - i > 1 else np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])))
        h, who = h[new], who[new]
        sig[i:j] = simhash(h, np.searchsorted(who, np.arange(j - i)), BITS)
        count[i:j] = np.bincount(who, minlength=j - i)
    return sig, count


def widths(segments: int) -> list[tuple[int, int]]:
    """(first bit, last bit + 1) of each segment."""
    cuts = [BITS * s // segments for s in range(segments + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def segment_values(sig: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo..hi of each signature, of which the first 64 are word 0."""
    n = hi - lo
    mask = np.uint64((1 << n) - 1)
    if hi <= 64:
        return (sig[:, 0] >> np.uint64(lo)) & mask
    if lo >= 64:
        return (sig[:, 1] >> np.uint64(lo - 64)) & mask
    return ((sig[:, 0] >> np.uint64(lo)) | (sig[:, 1] << np.uint64(64 - lo))) & mask


def variants(values: np.ndarray, width: int) -> np.ndarray:
    """(n, width) keys: the value without each of its bits, and which bit that is."""
    bits = np.arange(width, dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = values[:, None]
    rest = (v & low) | ((v >> np.uint64(1)) & ~low)
    return (rest * np.uint64(width) + bits).astype(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def ball_edges(sig: np.ndarray, distance: int, size: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Edges within ``distance`` and ``reach`` that connect what all such edges connect, of the signatures of one run."""
    edges = []
    leaders: list[int] = []
    balls: list[list[int]] = []
    for i in range(len(sig)):
        if not leaders:
            leaders.append(i)
            balls.append([i])
            continue
        d = hamming(sig[leaders], sig[i])
        is_near = (d <= distance) & (np.abs(size[leaders] - size[i]) <= reach)
        near = np.flatnonzero(is_near)
        for k in near:
            edges.append((leaders[k], i))
        for k in np.flatnonzero(~is_near & (d <= 2 * distance)):
            ball = balls[k]
            if len(ball) > 1:
                close = np.flatnonzero((hamming(sig[ball], sig[i]) <= distance) & (np.abs(size[ball] - size[i]) <= reach))
                if len(close):
                    edges.append((ball[close[0]], i))
        if len(near):
            balls[near[0]].append(i)
        else:
            leaders.append(i)
            balls.append([i])
    return edges


def matrix_edges(sig: np.ndarray, distance: int, size: np.ndarray, reach: float) -> np.ndarray:
    """The same of a run whose pairs fit into a matrix: each leader with its ball, and each row of a later ball with one close member of an earlier."""
    close = (np.bitwise_count(sig[:, None, 0] ^ sig[None, :, 0]) + np.bitwise_count(sig[:, None, 1] ^ sig[None, :, 1])) <= distance
    close &= np.abs(size[:, None] - size[None, :]) <= reach
    left, edges = np.ones(len(sig), bool), []
    while left.any():
        leader = int(left.argmax())
        ball = np.flatnonzero(close[leader] & left)
        left[ball] = False
        edges.append(np.stack([np.full(len(ball) - 1, leader), ball[ball != leader]], axis=1))
        part = close[np.ix_(left, ball)]  # rows of later balls
        hung = part.any(axis=1)
        edges.append(np.stack([ball[part[hung].argmax(axis=1)], np.flatnonzero(left)[hung]], axis=1))
    return np.concatenate(edges)


def few_edges(sig: np.ndarray, distance: int, size: np.ndarray, reach: float) -> np.ndarray | None:
    """All close pairs of a long run, compared in blocks; None as soon as there are more of them than rows."""
    n, left = len(sig), np.ascontiguousarray(sig[:, 0])
    step, out, got = max(1, (1 << 17) // n), [], 0
    for at in range(0, n - 1, step):
        a, b = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ left[None, at + 1 :]) <= distance)
        a, b = a + at, b + at + 1
        a, b = a[a < b], b[a < b]
        ok = (hamming(sig[a], sig[b]) <= distance) & (np.abs(size[a] - size[b]) <= reach)
        out.append(np.stack([a[ok], b[ok]], axis=1))
        got += len(out[-1])
        if got >= n:
            return None
    return np.concatenate(out)


#: Rows of a run whose pairs are compared in one matrix.
MATRIX = 2048


def run_edges(key: np.ndarray, sig: np.ndarray, distance: int, small: int = 64, size: np.ndarray | None = None, reach: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row pairs (n, 2), dense): pairs that connect each run of equal keys as all its pairs within ``distance`` do.

    With ``size``, a pair's sizes may also differ by at most ``reach``. Runs of up to ``small`` rows are compared in one pass, longer ones by
    ``few_edges``; those with more close pairs than a tree needs go through ``ball_edges`` and are dense.
    """
    size = np.zeros(len(key), np.int8) if size is None else size
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    last = np.repeat(first + count - 1, np.where(count <= small, count, 0))
    rows = np.flatnonzero(np.repeat(count <= small, count))
    later, a, b, ahead = last - rows, [], [], 0
    while len(rows):  # each row with the next one of its run, then with the one after it
        ahead += 1
        rows, later = rows[later >= ahead], later[later >= ahead]
        other = rows + ahead
        ok = np.bitwise_count(sig[rows, 0] ^ sig[other, 0]) <= distance
        x, y = rows[ok], other[ok]
        ok = (hamming(sig[x], sig[y]) <= distance) & (np.abs(size[x] - size[y]) <= reach)
        a.append(x[ok])
        b.append(y[ok])
    a, b = np.concatenate([*a, rows]), np.concatenate([*b, rows])
    of = np.searchsorted(first, a, side="right") - 1
    dense = (np.bincount(of, minlength=len(first)) >= np.maximum(count, 4)) | (count > small)
    sparse = ~dense[of]
    out, large = [np.stack([a[sparse], b[sparse]], axis=1)], [np.zeros(int(sparse.sum()), bool)]
    for r in np.flatnonzero(dense).tolist():
        part = slice(first[r], first[r] + count[r])
        found = few_edges(sig[part], distance, size[part], reach) if count[r] > small else None
        if found is not None:
            out.append(found + first[r])
            large.append(np.zeros(len(found), bool))
            continue
        found = matrix_edges(sig[part], distance, size[part], reach) if count[r] <= MATRIX else np.array(ball_edges(sig[part], distance, size[part], reach), dtype=np.int64).reshape(-1, 2)
        out.append(found + first[r])
        large.append(np.ones(len(out[-1]), bool))
    return np.concatenate(out), np.concatenate(large)


def signature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s0, s1) of the documents that have a word."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sig, n = signatures(texts_of(batch, "t"))
            s = sig.view(np.int64)
            return pa.record_batch([batch.column(0), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["id", "s0", "s1"]).filter(pa.array(n > 0))
        return step

    return map_batches(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), make, f"id {kind}, s0 long, s1 long")


def segment_edges(nodes: DataFrame, lo: int, hi: int, distance: int) -> DataFrame:
    """(a, b): edges of nodes (node, s0, s1) that share a variant of the segment of bits lo..hi."""

    def index(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        rows = np.stack([batch.column(c).to_numpy() for c in ("node", "s0", "s1")], axis=1)
        for at in range(0, len(rows), 1 << 13):
            part = rows[at : at + (1 << 13)]
            keys = variants(segment_values(part[:, 1:].view(np.uint64), lo, hi), hi - lo)
            yield np.concatenate((keys.reshape(-1, 1), np.repeat(part, hi - lo, axis=0)), axis=1)

    def match(rows: np.ndarray) -> pa.RecordBatch | None:
        pairs, _ = run_edges(rows[:, 0], rows[:, 2:].view(np.uint64), distance)
        return pa.record_batch([pa.array(rows[pairs[:, 0], 1]), pa.array(rows[pairs[:, 1], 1])], names=["a", "b"]) if len(pairs) else None

    return keyed_runs(nodes.select("node", "s0", "s1"), index, match, 4, "a long, b long").distinct()


def find_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segments: int = 6, distance: int = 17) -> DataFrame:
    """(id, kept_id) of every document that is in a group of more than one and does not stay; ``kept_id`` stays.

    Signatures are cut into at least ``segments``, and into as many as pairs of ``distance`` bits need.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    segments = max(segments, distance // 2 + 1)
    table = scratch.write(signature_table(docs, id_col, text_col), "signatures")
    nodes = scratch.write(table.groupBy("s0", "s1").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = None
    for lo, hi in widths(segments):
        found = scratch.write(segment_edges(nodes, lo, hi, distance), f"edges{lo}")
        edges = found if edges is None else edges.unionByName(found)
    # rows of one identifier are one document, so their signatures are linked
    unlike = table.groupBy("id").agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("s0", "s1") for f in (F.min, F.max)]).where("mins0 <> maxs0 OR mins1 <> maxs1")
    own = scratch.write(table.join(unlike.select("id"), "id").join(nodes, ["s0", "s1"]).select("id", "node"), "own", small=True)
    first = own.groupBy("id").agg(F.min("node").alias("a"))
    edges = edges.unionByName(own.join(first, "id").select("a", F.col("node").alias("b")))
    linked = scratch.write(components(edges, scratch), "linked")
    group = nodes.join(linked, "node", "left").withColumn("g", F.coalesce("root", "node"))
    least = group.groupBy("g").agg(F.min("least").alias("kept_id"), F.count("*").alias("size"))
    place = group.select("s0", "s1", "g").join(least, "g").select("s0", "s1", "kept_id")
    return table.join(place, ["s0", "s1"]).where("id <> kept_id").select(F.col("id").alias(id_col), "kept_id").distinct()


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group, and what is no duplicate.

    Rows that repeat an identifier stay or go together.
    """
    gone = find_duplicates(docs, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(gone.hint("shuffle_hash"), F.col(f"row.`{id_col}`") == F.col("gone"), "left_anti").select("row.*")
