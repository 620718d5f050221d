"""Dynamic programming over batches of sequences in NumPy: all anchors, or all starts, step together."""

from __future__ import annotations

import numpy as np

from segtide.plans.planner import SearchPlan

#: Anchors stepped together; more are stepped in parts, so that memory is bounded.
PART = 1 << 16


def _extend(flat: np.ndarray, at: np.ndarray, limit: np.ndarray, step: int, budget: np.ndarray, sub: np.ndarray, deletion: np.ndarray, insertion: np.ndarray):
    """(anchor, extent, distance) of every extension of each anchor in one direction.

    Rows of ``sub`` and ``deletion`` are in the direction of travel. An
    extension ends where no entry of its column is within the budget.
    """
    n, h = len(at), len(deletion)
    root = np.concatenate(([np.float32(0)], np.cumsum(deletion, dtype=np.float32)))
    who, extents, distances = [np.arange(n)], [np.zeros(n, np.int64)], [np.full(n, root[h], np.float32)]
    column, active, extent = np.broadcast_to(root, (n, h + 1)), np.arange(n), 0
    pos = at + step
    while len(active):
        inside = pos != limit[active]
        active, column, pos = active[inside], column[inside], pos[inside]
        if not len(active):
            break
        token = flat[pos]
        ins = insertion[token]
        new = np.empty((len(active), h + 1), np.float32)
        new[:, 0] = column[:, 0] + ins
        for i in range(h):
            new[:, i + 1] = np.minimum(np.minimum(column[:, i] + sub[i, token], column[:, i + 1] + ins), new[:, i] + deletion[i])
        extent += 1
        go = new.min(axis=1) < budget[active]
        active, column, pos = active[go], new[go], pos[go] + step
        who.append(active)
        extents.append(np.full(len(active), extent, np.int64))
        distances.append(column[:, h])
    return np.concatenate(who), np.concatenate(extents), np.concatenate(distances)


def _least(row: np.ndarray, start: np.ndarray, end: np.ndarray, distance: np.ndarray):
    """One row a segment, with its least distance, in order."""
    order = np.lexsort((distance, end, start, row))
    row, start, end, distance = row[order], start[order], end[order], distance[order]
    first = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(row) else np.zeros(0, bool)
    return row[first], start[first], end[first], distance[first]


def anchored(flat: np.ndarray, offsets: np.ndarray, plan: SearchPlan):
    """(row, start, end, distance) of the matches in sequences flat[offsets[r]:offsets[r + 1]] of token numbers."""
    out = []
    m = len(plan.query)
    with np.errstate(over="ignore", invalid="ignore"):
        for q, near in zip(plan.selected, plan.neighbours):
            everywhere = np.flatnonzero(near[flat])
            for lo in range(0, len(everywhere), PART):
                at = everywhere[lo : lo + PART]
                a = plan.substitution[q, flat[at]]
                at, a = at[a < plan.bound], a[a < plan.bound]
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, side="right") - 1
                budget = plan.bound - a
                back = _extend(flat, at, offsets[row] - 1, -1, budget, plan.substitution[:q][::-1], plan.deletion[:q][::-1], plan.insertion)
                fore = _extend(flat, at, offsets[row + 1], 1, budget, plan.substitution[q + 1 : m], plan.deletion[q + 1 : m], plan.insertion)
                left = a[back[0]] + back[2]
                keep = left < plan.bound
                who, ext, left = back[0][keep], back[1][keep], left[keep]
                order = np.argsort(fore[0], kind="stable")
                fwho, fext, fdist = fore[0][order], fore[1][order], fore[2][order]
                begin = np.searchsorted(fwho, who, side="left")
                size = np.searchsorted(fwho, who, side="right") - begin
                pick = np.repeat(np.arange(len(who)), size)
                other = np.repeat(begin, size) + np.arange(len(pick)) - np.repeat(np.cumsum(size) - size, size)
                total = left[pick] + fdist[other]
                ok = total < plan.bound
                pick, other, total = pick[ok], other[ok], total[ok]
                anchor = who[pick]
                base = offsets[row[anchor]]
                out.append(_least(row[anchor], at[anchor] - ext[pick] - base, at[anchor] + fext[other] + 1 - base, total))
    return _least(*[np.concatenate(x) for x in zip(*out)]) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def exhaustive(flat: np.ndarray, offsets: np.ndarray, plan: SearchPlan):
    """The same by trying every start, without anchors."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for lo in range(0, len(flat), PART):
            at = np.arange(lo, min(lo + PART, len(flat)))
            row = np.searchsorted(offsets, at, side="right") - 1
            who, ext, dist = _extend(flat, at - 1, offsets[row + 1], 1, np.full(len(at), plan.bound), plan.substitution, plan.deletion, plan.insertion)
            ok = (ext > 0) & (dist < plan.bound)
            who, ext, dist = who[ok], ext[ok], dist[ok]
            base = offsets[row[who]]
            out.append(_least(row[who], at[who] - base, at[who] + ext - base, dist))
    return _least(*[np.concatenate(x) for x in zip(*out)]) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
