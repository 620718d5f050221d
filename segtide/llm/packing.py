"""Best-fit packing: documents into rows of a fixed length by bin completion.

A document of more than ``capacity`` tokens is cut into full pieces and a rest;
a shorter one is one piece. Pieces are dealt by hash into groups of about
``group_size``, and each group is packed on its own: best-fit decreasing gives
an incumbent; while it uses more bins than the lower bound, depth-first branch and
bound packs its most wasteful bins anew, into one fewer. At a node the largest piece left opens a bin, whose
undominated fillings are enumerated, fullest first; a branch is cut when
the waste so far or the bound of what is left cannot beat the incumbent. A
search visits at most ``max_nodes`` nodes and as many steps of a node's
enumeration; the incumbent
stands where several find nothing better, so every piece is placed in any case.

Defined results: a document without tokens or with a null text has no piece.
Repeated rows are documents of their own, told apart by ``copy`` (in order of length). Pieces of
equal length are interchangeable and placed in order of (identifier, copy,
piece). An empty table gives no rows; other columns are not looked at,
whatever their names. Very long texts are packed whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segtide.llm.common import Scratch
from segtide.llm.mixing import words


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of sizes; each goes where the least room is left over."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for s in sorted(sizes, reverse=True):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([s])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            r, b = room.pop(at)
            bins[b].append(s)
            insort(room, (r - s, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The greatest of Martello and Toth's L2 bounds, so at least the rounded sum."""
    if not sizes:
        return 0
    a = np.sort(np.asarray(sizes, dtype=np.int64))
    total = np.concatenate(([0], np.cumsum(a)))
    best = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(a, capacity // 2, side="right"))
    for k in np.unique(a[: int(np.searchsorted(a, capacity / 2, side="right"))]).tolist():
        big = int(np.searchsorted(a, capacity - k, side="right"))
        low = int(np.searchsorted(a, k, side="left"))
        n1, n2 = len(a) - big, max(0, big - half)
        free = n2 * capacity - int(total[big] - total[min(half, big)])
        rest = int(total[min(half, big)] - total[min(low, half, big)])
        best = max(best, n1 + n2 + max(0, -(-(rest - free) // capacity)))
    return best


def fillings(counts: Counter, room: int, steps: int):
    """The undominated multisets of sizes that fit ``room``: to none can a left size be added, nor one of its sizes be
    replaced by a larger left one. Larger sizes first; at most ``steps`` partial fillings are looked at."""
    sizes = sorted((s for s, n in counts.items() if n > 0 and s <= room), reverse=True)
    falling = [-s for s in sizes]
    stack = [[0, room, (), False]]
    while stack and steps > 0:
        steps -= 1
        node = stack[-1]
        j, left, taken, _ = node
        j = max(j, bisect_left(falling, -left))
        if j < len(sizes) and taken.count(sizes[j]) >= counts[sizes[j]]:
            j += 1
        if j < len(sizes):
            node[0], node[3] = j + 1, True
            stack.append([j, left - sizes[j], (*taken, sizes[j]), False])
            continue
        stack.pop()
        if node[3]:
            continue
        spare = [s for s in sizes if counts[s] > taken.count(s)]
        if not any(s <= left or any(t < s <= t + left for t in taken) for s in spare):
            yield taken


def branch_and_bound(sizes: list[int], capacity: int, fewer: int, max_nodes: int) -> tuple[list[list[int]] | None, bool]:
    """(bins, at most ``fewer`` of them, or None where there are none or none was found; whether the search ended by itself).

    Depth first: the largest size left opens a bin, its fillings are tried by falling sum.
    """
    nodes, found, whole = 0, None, True
    room = fewer * capacity - sum(sizes)  # the waste that is left to spend

    def search(counts: Counter, room: int, bins: list[list[int]]) -> None:
        nonlocal nodes, found, whole
        left = sorted(counts.elements())
        if len(bins) + lower_bound(left, capacity) > fewer:
            return
        greedy = best_fit(left, capacity)
        if len(bins) + len(greedy) <= fewer:
            found = [list(b) for b in bins] + greedy
            return
        top = left[-1]
        rest = counts.copy()
        rest[top] -= 1
        rest += Counter()
        for f in sorted(fillings(rest, capacity - top, max_nodes), key=sum, reverse=True):
            lost = capacity - top - sum(f)
            if lost > room:
                return
            nodes += 1
            if nodes > max_nodes:
                whole = False
                return
            search(rest - Counter(f), room - lost, [*bins, [top, *f]])
            if found is not None or not whole:
                return

    if room >= 0:
        search(Counter(sizes), room, [])
    return found, whole


def complete(sizes: list[int], capacity: int, max_nodes: int, window: int = 10, tries: int = 8) -> list[list[int]]:
    """Bin completion; the best-fit result where nothing better is found.

    A search over hundreds of bins never gets to a leaf, so it is made over a
    few: the most wasteful ones, as many as waste a bin together and at least ``window``,
    are to be packed into one fewer. Where that succeeds, the result is the next incumbent; where it
    fails ``tries`` times in a row, each time with other bins of average waste besides, the incumbent stands.
    """
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    failed = 0
    rng = np.random.default_rng(len(sizes))
    while len(best) > bound and failed < tries:
        best.sort(key=lambda b: (sum(b), b))
        waste = np.cumsum([capacity - sum(b) for b in best])
        n = max(min(window, len(best)), int(np.searchsorted(waste, capacity)) + 1)
        if n > len(best):
            break
        chosen = set(range(n))
        if failed:
            chosen |= set(rng.choice(len(best), min(len(best), window // 2 * failed), replace=False).tolist())
        part = [s for k in chosen for s in best[k]]
        better, whole = branch_and_bound(part, capacity, len(chosen) - 1, max_nodes)
        if better is not None:
            best = [b for k, b in enumerate(best) if k not in chosen] + better
            failed = 0
        elif len(chosen) == len(best) and whole:
            break  # all pieces were searched to the end
        else:
            failed += 1
    return best


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, group_size: int = 4096, max_nodes: int = 400,
) -> DataFrame:
    """(bin, id, copy, piece, start, length, place): tokens start..start+length of a document stand at ``place`` in the bin."""
    kind = docs.schema[id_col].dataType.simpleString()
    counted = Scratch(docs.sparkSession).write(docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("n")).where("n > 0"), "lengths")
    alike = counted.groupBy("id", "n").agg(F.count("*").alias("c"))  # repeated rows are numbered without sorting a table
    total = counted.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    groups = max(1, -(-int(total) // group_size))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = alike.withColumn("before", before).select("id", "n", F.explode(F.expr("sequence(cast(before as int), cast(before + c - 1 as int))")).alias("copy"))
    rows = rows.select("id", "copy", "n", F.explode(F.expr(f"sequence(0, cast((n - 1) div {capacity} as int))")).alias("piece"))
    pieces = rows.select("id", "copy", "piece", F.expr(f"piece * {capacity}L").alias("start"), F.least(F.lit(capacity).cast("long"), F.expr(f"n - piece * {capacity}L")).alias("length"))
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("id", "copy", "piece"), F.lit(groups)).cast("long"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "id", "copy", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy()
        queue: dict[int, list[int]] = {}
        for row in range(len(frame) - 1, -1, -1):
            queue.setdefault(int(lengths[row]), []).append(row)
        bin_of, place = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for b, sizes in enumerate(complete(lengths.tolist(), capacity, max_nodes)):
            at = 0
            for s in sorted(sizes, reverse=True):
                row = queue[s].pop()
                bin_of[row], place[row] = b, at
                at += s
        return frame.assign(bin=[f"{g}-{b}" for g, b in zip(frame["g"], bin_of)], place=place)[["bin", "id", "copy", "piece", "start", "length", "place"]]

    out = pieces.groupBy("g").applyInPandas(solve, f"bin string, id {kind}, copy int, piece int, start long, length long, place long")
    return out.withColumnRenamed("id", id_col)
