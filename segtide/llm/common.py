"""Shared pieces: vectorised text handling, tables in the shared folder, runs of equal keys, components.

Text is handled as arrays of code points: a batch's texts are joined, decoded
once into ``uint32`` and every step (classes, words, hashes) is a NumPy pass.
Chunks are bounded by characters, so a batch of very long texts needs no more
memory than a batch of short ones, and no text is ever cut.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.sources.shared import shared_dir

#: Characters that one NumPy pass works on; a longer text is a pass of its own.
CHUNK_CHARS = 1 << 17
#: Rows that ``keyed_runs`` packs at once, and bins of keys to a partition.
FLUSH_ROWS, BINS = 1 << 18, 8
_BASE = 0x9E3779B97F4A7C15 | 1
_NL = 10


# ---------------------------------------------------------------- text as arrays


@lru_cache(maxsize=1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower, kind) by code point; kind: 0 other, 1 letter, 2 digit, 3 white space; bit 4 upper case."""
    n = 0x110000
    lower = np.arange(n, dtype=np.uint32)
    kind = np.zeros(n, dtype=np.uint8)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            kind[i] = 1
            low = c.lower()
            if low != c:
                kind[i] = 5
                if len(low) == 1:
                    lower[i] = ord(low)
        elif c.isdigit() or c.isnumeric():
            kind[i] = 2
        elif c.isspace():
            kind[i] = 3
    return lower, kind


def chunks(texts: list[str], max_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``max_chars`` characters together; every text is in exactly one."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > max_chars:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed; and each text's start and end."""
    buf = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lens + 1) - 1
    return buf, ends - lens, ends


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(mask) + 2, bool)
    padded[1:-1] = mask
    d = np.flatnonzero(padded[1:] != padded[:-1])
    return d[::2], d[1::2]


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_CHARS + CHUNK_CHARS // 4)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64))))
            for b in (np.uint64(_BASE), np.uint64(inverse))
        ]
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every output bit depends on every input bit."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, the same wherever the span stands."""
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.add(buf, np.uint64(1), out=total[1:])
    total[1:] *= power[: len(buf)]
    np.cumsum(total[1:], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


def owners(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the spans beginning at ``starts`` (ascending) holds each position."""
    return np.searchsorted(starts, positions, side="right") - 1


def simhash(hashes: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """SimHash rows (n, bits / 64) of groups of feature hashes that begin at ``starts``; an empty group gives 0.

    A feature's bits are unpacked to bytes and added eight lanes at a time; a
    group of over 255 features is added in pieces, so no lane overflows. A bit
    is set where more than half of the features have it.
    """
    n, words = len(starts), bits // 64
    out = np.zeros((n, words), dtype=np.uint64)
    bounds = np.append(starts, len(hashes))
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    pieces = (sizes[full] + 254) // 255
    first = np.cumsum(pieces) - pieces
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(bounds[full], pieces) + inner * 255
    for w in range(words):
        h = mix64(hashes + np.uint64((w * 0xD1B54A32D192ED03) & (2**64 - 1)))
        lanes = np.unpackbits(h.view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
        total = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        out[full, w] = np.packbits(2 * total > sizes[full, None], axis=1).view(np.uint64)[:, 0]
    return out


def popcount(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).astype(np.int64)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with nulls as empty strings."""
    return [t or "" for t in batch.column(name).to_pylist()]


# ---------------------------------------------------------------- samples

_RANKS = 1 << 62


def sample_rank(*columns: Column, seed: int) -> Column:
    """A hash of the columns in 0..2^62, to be compared with ``sample_bound``."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(_RANKS))


def sample_bound(most: int, count: int) -> int:
    """Ranks below it are the share of ``count`` rows of which there are ``most``; at 2^62 it doesn't vanish at any count."""
    return _RANKS if count <= most else _RANKS * most // count


# ---------------------------------------------------------------- shared tables


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


class Scratch:
    """Tables of one operator's run, written as Parquet in the shared folder.

    A written table cuts the lineage and survives the loss of executors. It is
    removed by ``drop`` or at the end of the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.root = f"{shared_dir(spark)}/segtide-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """Writes and reads back a table; after a ``small`` one there is nothing worth freeing."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths[name] = path
        if not small:
            self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                _remove(self.spark, path)

    def release(self) -> None:
        """Shuffle files of finished steps go once their plans are collected as garbage, on both sides; freed memory goes back to the system."""
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(_libc(), "malloc_trim"):
            _libc().malloc_trim(0)
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the session may be gone already
            pass


# ---------------------------------------------------------------- runs of equal keys


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroups sorted batches so that all rows of one key are in one table; empty input gives nothing."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(column, column[-1], side="left"))
        if last == 0:
            if held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        head = batch.slice(0, last)
        yield pa.Table.from_batches([*held, head])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def keyed_runs(
    df: DataFrame, index: Callable[[pa.RecordBatch], Iterator[np.ndarray]], match: Callable[[np.ndarray], pa.RecordBatch | None], width: int, schema: str,
    beside: int = 0,
) -> DataFrame:
    """Regroups rows by key: ``index`` makes arrays (n, ``width``) of int64 of a batch, the first column a key; ``match``
    gets all rows of some keys, sorted by the first two columns, and returns rows of ``schema``. The key's last
    ``beside`` bits tell rows of one key apart and only sort them.

    Rows travel as bytes, one value for a bin of keys: the JVM moves and sorts few
    large values, and the rows of a bin are sorted in NumPy. A bin is a small part of
    a partition; only a key of many rows makes it larger.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = np.uint64(parts * BINS)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        to = (mix64(rows[:, 0].view(np.uint64) >> np.uint64(beside)) % bins).astype(np.int32)
        order = np.argsort(to, kind="stable")
        rows, to = rows[order], to[order]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        offsets = (np.append(first, len(rows)) * (8 * width)).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
        return pa.record_batch([pa.array(to[first]), data], names=["bin", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows in index(batch):
                held.append(rows)
                n += len(rows)
                if n >= FLUSH_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows = np.frombuffer(b"".join(held), np.int64).reshape(-1, width)
            out = match(rows[np.lexsort((rows[:, 1], rows[:, 0]))])
            if out is not None and out.num_rows:
                yield out

        now, held = None, []
        for batch in batches:
            for b, data in zip(batch.column("bin").to_pylist(), batch.column("data")):
                if b != now and held:
                    yield from done(held)
                    held = []
                now = b
                held.append(data.as_py())
        if held:
            yield from done(held)

    return df.mapInArrow(send, "bin int, data binary").repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(receive, schema)


#: Edges up to which components are found on the driver; beyond, in rounds of shuffles, with the same result.
FEW_EDGES = 1 << 20


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of the nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _few_components(edges: DataFrame) -> DataFrame:
    got = edges.select("a", "b").toArrow()
    both = pa.chunked_array([*got.column("a").chunks, *got.column("b").chunks], type=got.schema.field("a").type).combine_chunks()
    coded = both.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[coded.indices.to_numpy()]
    n = len(got)
    root = least_linked(len(order), ends[:n], ends[n:])
    nodes = coded.dictionary.take(pa.array(order))
    kind = edges.schema["a"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes.take(pa.array(root))}), f"node {kind}, root {kind}")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each connected component of (a, b) edges, for nodes that have an edge.

    Alternating large-star and small-star rounds; each is one shuffle on the
    node and its result is a written table, so an executor's loss repeats one
    round at most. Self edges and nulls are dropped, repeated edges merged. Up to ``FEW_EDGES``
    edges, counted first, are linked on the driver.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now = scratch.write(now, "edges0")
    if now.count() <= FEW_EDGES:
        found = scratch.write(_few_components(now), "components", small=True)
        scratch.drop("edges0")
        return found
    name, before = "edges0", None
    for i in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # least neighbours by aggregation and join, as a window would hold a hub's neighbours in one task
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: every neighbour that is not above a, and a itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        after_name = f"edges{i}"
        after = scratch.write(small, after_name)
        scratch.drop(name)
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, name = after, after_name
        if tuple(sign) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = tuple(sign)
    raise RuntimeError("components did not settle")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
