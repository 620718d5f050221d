"""From a query, a policy and the index's frequencies to a plan: which query positions anchor the search, and by which tokens.

All arithmetic is in single floats and in query order. A match within the threshold pairs
some selected position with one of its neighbours, so anchoring there finds all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from segtide import errors
from segtide.functions.costs import MAX, CostPolicy, F32, Token, cost


@dataclass(frozen=True)
class SearchParams:
    """An inclusive threshold, and optionally the most candidates to verify."""

    threshold: float
    max_candidates: int | None = None


@dataclass(frozen=True)
class SearchMetrics:
    adjusted_eta: float | None
    selected_query_positions: int
    generated_candidates: int


@dataclass(frozen=True)
class SearchPlan:
    """Costs by token number; the last number stands for every token without an exception."""

    query: tuple[Token, ...]
    bound: np.float32
    numbers: dict[Token, int]
    substitution: np.ndarray  #: (len(query), tokens + 1)
    deletion: np.ndarray
    insertion: np.ndarray
    selected: tuple[int, ...]
    neighbours: np.ndarray  #: bool (len(selected), tokens + 1)
    adjusted_eta: float | None
    generated_candidates: int

    @property
    def anchor_tokens(self) -> list[Token] | None:
        """Tokens that can anchor a match, or None if every token can."""
        any_of = self.neighbours.any(axis=0) if len(self.selected) else np.zeros(len(self.insertion), bool)
        return None if any_of[-1] else [t for t, k in self.numbers.items() if any_of[k]]

    @property
    def metrics(self) -> SearchMetrics:
        return SearchMetrics(self.adjusted_eta, len(self.selected), self.generated_candidates)


def strict_bound(threshold: float) -> np.float32:
    """The float after an inclusive threshold, below which distances are admitted."""
    t = cost(threshold)
    if t == MAX:
        raise errors.InvalidThreshold("the threshold leaves no room for a strict bound")
    return np.nextafter(t, F32(np.inf))


def f32_sum(values: Sequence[np.float32]) -> np.float32:
    total = F32(0)
    with np.errstate(over="ignore"):
        for v in values:
            total = F32(total + v)
    return total


class Neighbourhood:
    """Each position's substitution costs over the alphabet, with frequencies."""

    def __init__(self, substitution: np.ndarray, deletion: np.ndarray, frequency: np.ndarray, present: np.ndarray):
        self.s, self.d, self.frequency, self.present = substitution, deletion, frequency, present

    def scan(self, i: int, eta: np.float32) -> tuple[np.ndarray, np.float32]:
        """(neighbours within the radius, the cheapest cost of avoiding them)."""
        inside = self.present & (self.s[i] <= eta)
        outside = self.s[i][self.present & ~inside]
        return inside, min(self.d[i], outside.min()) if len(outside) else self.d[i]

    def radii(self, eta: np.float32) -> np.ndarray:
        """The distinct costs above the radius, ascending."""
        inside = self.s[:, self.present]
        return np.unique(inside[inside > eta])


def select_positions(hood: Neighbourhood, bound: np.float32, eta: np.float32) -> list[tuple[int, np.ndarray]] | None:
    """Positions chosen by price paid, two-approximate in candidates; None if they cannot reach the bound."""
    m = len(hood.d)
    scans = [hood.scan(i, eta) for i in range(m)]
    share = [F32(e) for _, e in scans]
    count = [F32(hood.frequency[n].sum()) for n, _ in scans]
    paid, chosen = [F32(0)] * m, [False] * m
    selected: list[tuple[int, np.ndarray]] = []
    total = F32(0)
    while total < bound:
        residual = F32(bound - total)
        best = None
        for i in range(m):
            gain = min(share[i], residual)
            if chosen[i] or gain <= 0:
                continue
            with np.errstate(over="ignore"):
                value = F32(max(F32(count[i] - paid[i]), F32(0)) / gain)
            if best is None or value < best[1]:
                best = (i, value)
        if best is None:
            return None
        for i in range(m):
            gain = min(share[i], residual)
            if not chosen[i] and gain > 0:
                paid[i] = F32(paid[i] + F32(gain * best[1]))
        chosen[best[0]] = True
        selected.append((best[0], scans[best[0]][0]))
        total = f32_sum([s for s, c in zip(share, chosen) if c])
    return selected


def make_plan(
    query: Sequence[Token], costs: CostPolicy, params: SearchParams, frequencies: Callable[[list[Token]], dict[Token, int]], total_tokens: int,
    vocabulary_size: int, vocabulary: Callable[[], list[Token]] | None = None, anchored: bool = True,
) -> SearchPlan:
    """Checks, then plans; whatever is declined is raised here, before any data is searched.

    ``frequencies`` gives those of the asked tokens that the corpus has.
    Without ``anchored`` nothing is selected and nothing declined: for exhaustive search.
    """
    bound = strict_bound(params.threshold)
    query = tuple(query)
    m = len(query)
    deletion = np.array([costs.deletion(q) for q in query], dtype=np.float32)
    if anchored and not f32_sum(deletion) >= bound:
        raise errors.ThresholdUnavailable("deleting the whole query costs no more than the threshold")
    words = vocabulary() if costs.needs_vocabulary and vocabulary else None
    rows = {q: costs.row(q, words) for q in query}
    inserted, insert_rest = costs.insertions(words)
    numbers = {t: k for k, t in enumerate(dict.fromkeys([t for r, _ in rows.values() for t in r] + list(inserted)))}
    n = len(numbers)
    sub = np.zeros((m, n + 1), np.float32)
    for i, q in enumerate(query):
        row, rest = rows[q]
        sub[i] = rest
        for t, c in row.items():
            sub[i, numbers[t]] = c
    insertion = np.full(n + 1, insert_rest, np.float32)
    for t, c in inserted.items():
        insertion[numbers[t]] = c
    if not anchored:
        return SearchPlan(query, bound, numbers, sub, deletion, insertion, (), np.zeros((0, n + 1), bool), None, 0)
    found = frequencies(list(numbers))
    frequency = np.zeros(n + 1, np.int64)
    for t, f in found.items():
        frequency[numbers[t]] = f
    frequency[n] = total_tokens - frequency[:n].sum()
    present = np.append(frequency[:n] > 0, vocabulary_size > len(found))
    hood = Neighbourhood(sub, deletion, frequency, present)
    eta = F32(cost(params.threshold) / F32(m)) if m else F32(0)
    selected, adjusted = select_positions(hood, bound, eta), None
    if selected is None:
        radii = hood.radii(eta)
        low, high = 0, len(radii)
        while low < high:
            mid = (low + high) // 2
            attempt = select_positions(hood, bound, radii[mid])
            if attempt is None:
                low = mid + 1
            else:
                selected, adjusted, high = attempt, float(radii[mid]), mid
        if selected is None:
            raise errors.ThresholdUnavailable("no radius selects enough of the query")
    candidates = int(sum(int(frequency[near].sum()) for _, near in selected))
    if params.max_candidates is not None and candidates > params.max_candidates:
        raise errors.SearchTooExpensive(candidates, params.max_candidates)
    masks = np.stack([near for _, near in selected]) if selected else np.zeros((0, n + 1), bool)
    return SearchPlan(query, bound, numbers, sub, deletion, insertion, tuple(i for i, _ in selected), masks, adjusted, candidates)
