"""Embedding near-duplicates by NN-descent: the class and the number of links of every vector.

Equal vectors are one node that counts as often as it occurs. Every node keeps a list
of its ``k`` nearest by cosine. Lists start from a few random hyperplane codes: rows sorted by
code are compared with the rows next to them, so that a crowd of like codes is spread
over many small blocks. Then each round compares, at every
node, its neighbours and reverse neighbours with each other, where at least
one is new, until hardly any list changes; a hub's reverse neighbours are dealt
anew into parts of ``HUB`` in every round. A node whose list is full of
neighbours within the threshold is saturated: its list is enlarged to hold all
of its connected group in the threshold graph, compared block by block, of which only
each node's number of links and edges enough to connect the group are kept. The
recall is audited against brute force, as the mean over nodes that have a true
neighbour, of ``audit`` nodes chosen by hash or more until ``AUDITED`` have one; where none of
``MOST_AUDITED`` has, nothing is known of the recall. Then, and below
``target``, the lists are doubled and refined again, and after the last time all pairs are compared block by block.
Links have exactly recomputed similarities of at least ``threshold``; a class is a
connected component of links, named by its least identifier.

Shuffled vectors have half precision; the sizes of what is broadcast (the
hyperplanes, the audited nodes) are bounded by parameters.

Defined results: null vectors, null identifiers, vectors of zero, of values not
finite, or of another length than most, take no part and have no row. Rows that repeat an
identifier are one vector, the least of them. Equal vectors are linked, whatever rounding says; ties in
lists are broken by identifier. A vector without a link is a class of its own. An empty table
gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segtide.llm.common import Scratch, components, key_runs

#: Rows of a group's block, expected; reverse neighbours compared at once; bits of a hyperplane code; rows compared in code order.
BLOCK, HUB, BITS, NEXT = 1024, 256, 40, 128
AUDITED, MOST_AUDITED = 64, 1 << 15
#: What half precision may take from a similarity.
HALF = 0.005


def _matrix(column, dim: int, half: bool) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=np.float16 if half else np.float32).reshape(-1, dim).astype(np.float32)


def _vectors(table: DataFrame, id_col: str, vector_col: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, v): unit vectors as bytes of single precision; and their length."""
    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("e")).where("id IS NOT NULL AND e IS NOT NULL AND size(e) > 0")
    dim = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dim:
        return rows.limit(0).select("id", F.lit(b"").alias("v")), 0
    dim = dim[0]["d"]

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.array([np.nan if y is None else y for y in r], np.float64) for r in batch.column("e").to_pylist()]).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            x = (x[ok] / norm[ok, None]).astype(np.float32) + np.float32(0)  # one zero
            yield pa.record_batch([batch.column("id").filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    return scratch.write(rows.where(F.size("e") == dim).groupBy("id").agg(F.min("e").alias("e")).mapInArrow(unit, f"id {kind}, v binary"), "vectors"), dim


def _nodes(every: DataFrame, dim: int, kind: str) -> DataFrame:
    """(id, n, v, w): the least identifier and the number of equal vectors; ``w`` has half precision."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = _matrix(batch.column("v"), dim, False).astype(np.float16)
            yield pa.record_batch([batch.column("id"), batch.column("n"), batch.column("v"), pa.array([r.tobytes() for r in half], pa.binary())], names=["id", "n", "v", "w"])

    return every.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v").mapInArrow(halve, f"id {kind}, n long, v binary, w binary")


def _sorted_runs(df: DataFrame, key: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key)


def _pieces(t: pa.Table, key: str):
    k = t.column(key).to_numpy()
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return zip(first.tolist(), np.append(first[1:], len(k)).tolist())


def _first_lists(nodes: DataFrame, dim: int, kind: str, trees: int, k: int, seed: int) -> DataFrame:
    """(a, b, s): the best of the rows next to each in the order of each code."""
    planes = np.random.default_rng(seed).standard_normal((trees * BITS, dim)).astype(np.float32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = (_matrix(batch.column("w"), dim, True) @ planes.T > 0).reshape(batch.num_rows, trees, BITS)
            codes = (side * (1 << np.arange(BITS, dtype=np.int64))).sum(axis=2)
            for t in range(trees):
                yield pa.record_batch([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(codes[:, t]), batch.column("id"), batch.column("w")], names=["tree", "code", "id", "w"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            x = _matrix(batch.column("w"), dim, True)
            for begin, end in _pieces(batch, "tree"):
                for lo in range(begin, end, NEXT):
                    hi = min(lo + NEXT, end)
                    lo = max(begin, hi - NEXT)  # a short last block takes rows of the one before
                    if hi - lo < 2:
                        continue
                    most, n = min(k, hi - lo - 1), hi - lo
                    sim = x[lo:hi] @ x[lo:hi].T
                    np.fill_diagonal(sim, -2)
                    top = np.argpartition(-sim, most - 1, axis=1)[:, :most]
                    a.append(np.repeat(np.arange(lo, hi), most))
                    b.append(top.ravel() + lo)
                    s.append(np.take_along_axis(sim, top, axis=1).reshape(n * most))
            if a:
                ids = batch.column("id")
                yield pa.record_batch([ids.take(pa.array(np.concatenate(a))), ids.take(pa.array(np.concatenate(b))), pa.array(np.concatenate(s))], names=["a", "b", "s"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "code", F.xxhash64("id", "tree")]
    coded = nodes.select("id", "w").mapInArrow(code, f"tree int, code long, id {kind}, w binary")
    return coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, f"a {kind}, b {kind}, s float")


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each list; ``fresh`` stays where every row of an edge has it."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= k)


def _round(graph: DataFrame, nodes: DataFrame, dim: int, kind: str, k: int, salt: int) -> DataFrame:
    """New candidate edges: pairs of neighbours, of which one is new, that are better than a list's last."""
    last = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("m")).select(F.col("a").alias("u"), F.when(F.col("n") >= k, F.col("m")).otherwise(F.lit(-2.0)).cast("float").alias("last"))
    own = graph.select(F.col("a").alias("c"), F.col("b").alias("u"), "fresh", F.lit(1).alias("own"))
    back = graph.select(F.col("b").alias("c"), F.col("a").alias("u"), "fresh", F.lit(0).alias("own"))
    pairs = own.unionByName(back).groupBy("c", "u").agg(F.max("fresh").alias("fresh"), F.max("own").alias("own"))
    hubs = graph.groupBy(F.col("b").alias("c")).count().where(F.col("count") > HUB).select("c", F.ceil(F.col("count") / HUB).cast("int").alias("parts"))
    pairs = pairs.join(hubs, "c", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = F.when(F.col("own") == 1, F.expr("sequence(0, parts - 1)")).otherwise(F.array(F.expr(f"cast(pmod(xxhash64(u, {salt}), parts) as int)")))
    pairs = pairs.withColumn("part", F.explode(dealt)).select(F.xxhash64("c", "part").alias("h"), "u", "fresh")
    known = nodes.select(F.col("id").alias("u"), "w").join(last, "u", "left").na.fill(-2.0, ["last"])
    rows = pairs.join(known, "u")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "h"):
            x = _matrix(t.column("w"), dim, True)
            fresh, least = t.column("fresh").to_numpy() > 0, t.column("last").to_numpy()
            a, b, s = [], [], []
            for lo, hi in _pieces(t, "h"):
                new = np.flatnonzero(fresh[lo:hi])
                if hi - lo < 2 or not len(new):
                    continue
                sim = x[lo:hi][new] @ x[lo:hi].T
                sim[np.arange(len(new)), new] = -3
                i, j = np.nonzero(sim > least[lo:hi][new][:, None])
                a.append(new[i] + lo)
                b.append(j + lo)
                s.append(sim[i, j])
                i, j = np.nonzero(sim > least[lo:hi][None, :])
                a.append(j + lo)
                b.append(new[i] + lo)
                s.append(sim[i, j])
            if a and sum(map(len, a)):
                ids = t.column("u").combine_chunks()
                yield pa.record_batch([ids.take(pa.array(np.concatenate(a))), ids.take(pa.array(np.concatenate(b))), pa.array(np.concatenate(s))], names=["a", "b", "s"])

    found = _sorted_runs(rows.select("h", "u", "w", "last", "fresh"), "h").mapInArrow(compare, f"a {kind}, b {kind}, s float")
    return found.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("fresh", F.lit(1))


def _block_links(members: DataFrame, dim: int, kind: str, threshold: float) -> DataFrame:
    """(a, b, n) of rows (g, id, n, v), all pairs of equal g, block by block: with null ``b`` a share of a's links, else an edge.

    The edges of a pair of blocks are a star about the least row of each of its components.
    """
    sizes = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "g").withColumn("block", F.expr("cast(pmod(xxhash64(id, 5), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select(F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "block", "id", "n", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "key"):
            x, block, n = _matrix(t.column("v"), dim, False), t.column("block").to_numpy(), t.column("n").to_numpy()
            ids = t.column("id").combine_chunks()
            for lo, hi in _pieces(t, "key"):
                one = np.flatnonzero(block[lo:hi] == block[lo:hi].min()) + lo
                two = np.flatnonzero(block[lo:hi] == block[lo:hi].max()) + lo
                same = block[one[0]] == block[two[0]]
                near = x[one] @ x[two].T >= threshold
                if same:
                    np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                links = np.bincount(one[i] - lo, n[two[j]], minlength=hi - lo)
                if not same:
                    links += np.bincount(two[j] - lo, n[one[i]], minlength=hi - lo)
                label, before = np.arange(hi - lo), None
                while before is None or (label != before).any():
                    before = label.copy()
                    np.minimum.at(label, one[i] - lo, label[two[j] - lo])
                    np.minimum.at(label, two[j] - lo, label[one[i] - lo])
                    label = label[label]
                some, star = np.flatnonzero(links), np.flatnonzero(label != np.arange(hi - lo))
                a = ids.take(pa.array(np.concatenate((some, star)) + lo))
                b = ids.take(pa.array(np.concatenate((np.zeros(len(some), np.int64), label[star])) + lo, mask=np.arange(len(a)) < len(some)))
                yield pa.record_batch([a, b, pa.array(np.concatenate((links[some], np.zeros(len(star)))).astype(np.int64))], names=["a", "b", "n"])

    return _sorted_runs(rows, "key").mapInArrow(compare, f"a {kind}, b {kind}, n long")


def _exact(near: DataFrame, nodes: DataFrame, dim: int, kind: str, threshold: float) -> DataFrame:
    """(a, b, na, nb): the edges, each once, whose similarity is enough in single precision."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.einsum("ij,ij->i", _matrix(batch.column("va"), dim, False), _matrix(batch.column("vb"), dim, False))
            yield pa.record_batch([batch.column(c) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"]).filter(pa.array(s >= threshold))

    once = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), F.col("n").alias(f"n{c}"))
    return once.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(compute, f"a {kind}, b {kind}, na long, nb long")


def _listed(graph: DataFrame, nodes: DataFrame, dim: int, kind: str, threshold: float, k: int, scratch: Scratch) -> DataFrame:
    """(a, b, n) as of ``_block_links``: what the lists give, and of groups with a saturated list all."""
    near = graph.where(F.col("s") >= threshold - HALF).select("a", "b")
    full = near.groupBy("a").count().where(F.col("count") >= k).select(F.col("a").alias("node"))

    def shares(e: DataFrame) -> DataFrame:
        none = F.lit(None).cast(kind).alias("b")
        return e.select("a", none, F.col("nb").alias("n")).unionByName(e.select(F.col("b").alias("a"), none, F.col("na").alias("n"))).unionByName(e.select("a", "b", F.lit(0).cast("long").alias("n")))

    if full.isEmpty():
        return shares(scratch.write(_exact(near, nodes, dim, kind, threshold), "plain"))
    linked = components(near, scratch)
    wide = scratch.write(linked.join(linked.join(full, "node").select("root").distinct(), "root").select("node", F.col("root").alias("g")), "wide")
    plain = scratch.write(_exact(near.join(wide.select(F.col("node").alias("a")), "a", "left_anti"), nodes, dim, kind, threshold), "plain")
    members = nodes.join(wide, F.col("id") == F.col("node")).select("g", "id", "n", "v")
    return shares(plain).unionByName(_block_links(members, dim, kind, threshold))


def _audit(links: DataFrame, nodes: DataFrame, dim: int, kind: str, threshold: float, audit: int, size: int) -> float | None:
    """The mean share of their true links that ``links`` (id, links) has of nodes that have any, of ``audit`` or more; None where too few were looked at to see any."""
    while True:
        share = min(1.0, audit / max(size, 1))
        chosen = nodes.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 62)) < int(math.ceil((1 << 62) * share))).select("id", "v").toArrow()
        seen, recall = _node_recall(links, nodes, chosen, dim, kind, threshold) if chosen.num_rows else (0, None)
        if seen >= AUDITED or share == 1.0 or audit >= MOST_AUDITED:
            return 1.0 if share == 1.0 and not seen else recall
        audit = min(audit * 8, MOST_AUDITED)


def _node_recall(links: DataFrame, nodes: DataFrame, chosen: pa.Table, dim: int, kind: str, threshold: float) -> tuple[int, float | None]:
    """(nodes of ``chosen`` that have a true link, the mean of their recall)."""
    ids, x = chosen.column("id").combine_chunks(), _matrix(chosen.column("v"), dim, False)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, n = _matrix(batch.column("v"), dim, False), batch.column("n").to_numpy()
            true = np.concatenate([(x[at : at + BLOCK] @ y.T >= threshold) @ n for at in range(0, len(x), BLOCK)])
            some = np.flatnonzero(true)
            yield pa.record_batch([ids.take(pa.array(some)), pa.array(true[some].astype(np.int64))], names=["id", "real"])

    # a node's own copies are no link here, as they can't be missed
    true = nodes.select("v", "n").mapInArrow(scan, f"id {kind}, real long").groupBy("id").agg(F.sum("real").alias("real"))
    true = true.join(nodes.select("id", "n"), "id").select("id", (F.col("real") - F.col("n")).alias("real")).where("real > 0")
    hits = true.join(links, "id", "left").select(F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("real")).alias("r"))
    return tuple(hits.agg(F.count("*"), F.avg("r")).first())


def near_duplicates(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int = 12, trees: int = 4,
    rounds: int = 8, settled: float = 0.01, audit: int = 256, target: float = 0.97, enlargements: int = 3, seed: int = 13,
) -> DataFrame:
    """(id, class_id, copies, links) of every vector: its class, how many vectors equal it (itself too), and
    with how many others its cosine similarity is at least ``threshold``."""
    scratch = Scratch(table.sparkSession)
    kind = table.schema[id_col].dataType.simpleString()
    every, dim = _vectors(table, id_col, vector_col, scratch)
    if not dim:
        return every.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    nodes = scratch.write(_nodes(every, dim, kind), "nodes")
    size = nodes.count()
    graph = None
    for enlarged in range(enlargements + 1):
        first = _first_lists(nodes, dim, kind, trees, k, seed + enlarged).withColumn("fresh", F.lit(1))
        graph = scratch.write(_nearest(first if graph is None else first.unionByName(graph.select("a", "b", "s", "fresh")), k).drop("r"), "graph")
        for n in range(rounds):
            cand = _round(graph, nodes, dim, kind, k, seed + n)
            old = graph.select("a", "b", "s").withColumn("fresh", F.lit(0))
            graph = scratch.write(_nearest(old.unionByName(cand), k).drop("r"), "graph")
            if (graph.agg(F.sum("fresh")).first()[0] or 0) <= settled * size * k:
                break
        found = scratch.write(_listed(graph, nodes, dim, kind, threshold, k, scratch), "found")
        links = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
        recall = _audit(links, nodes, dim, kind, threshold, audit, size)
        if recall is not None and recall >= target:
            break
        k *= 2
    else:
        found = scratch.write(_block_links(nodes.select(F.lit(0).alias("g"), "id", "n", "v"), dim, kind, threshold), "found")
        links = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    place = nodes.join(linked, F.col("id") == F.col("node"), "left").select("id", "n", "v", F.coalesce("root", "id").alias("class_id")).join(links, "id", "left")
    place = scratch.write(place.select("v", "class_id", F.col("n").alias("copies"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "place")
    return every.join(place, "v").select(F.col("id").alias(id_col), "class_id", "copies", "links")
