"""Directed edit-cost policies, from query to data: substitution, deletion of a query token, insertion of a data token.

A policy describes each query token's costs as exceptions and one cost for all
other tokens, so that planning needs no pass over the vocabulary. Costs are
single floats throughout. A token costs nothing against itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Hashable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa

from segtide import errors

Token = Hashable
F32 = np.float32
MAX = np.finfo(np.float32).max


def cost(value: float) -> np.float32:
    """A finite cost of at least zero as a single float."""
    with np.errstate(over="ignore"):
        v = F32(value)
    if not np.isfinite(v) or v < 0:
        raise errors.InvalidCost(f"{value!r} is not a finite cost of at least 0")
    return v + F32(0.0)


class CostPolicy:
    """``row`` and ``insertions`` return (exceptions, the cost of all other tokens)."""

    #: Whether rows list the whole vocabulary, which the planner then has to pass in.
    needs_vocabulary = False

    def row(self, token: Token, vocabulary: list[Token] | None = None) -> tuple[dict[Token, np.float32], np.float32]:
        raise NotImplementedError

    def deletion(self, token: Token) -> np.float32:
        raise NotImplementedError

    def insertions(self, vocabulary: list[Token] | None = None) -> tuple[dict[Token, np.float32], np.float32]:
        raise NotImplementedError


class UnitCosts(CostPolicy):
    """Levenshtein distance."""

    def row(self, token, vocabulary=None):
        return {token: F32(0)}, F32(1)

    def deletion(self, token):
        return F32(1)

    def insertions(self, vocabulary=None):
        return {}, F32(1)


@dataclass
class RuleCosts(CostPolicy):
    """Directed rules with defaults; a rule for a token against itself has no effect."""

    default_substitution: float = 1.0
    default_deletion: float = 1.0
    default_insertion: float = 1.0
    substitutions: dict[tuple[Token, Token], float] = field(default_factory=dict)
    deletions: dict[Token, float] = field(default_factory=dict)
    inserted: dict[Token, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("default_substitution", "default_deletion", "default_insertion"):
            setattr(self, name, cost(getattr(self, name)))
        for rules in (self.substitutions, self.deletions, self.inserted):
            for k, v in rules.items():
                rules[k] = cost(v)
        self._from: dict[Token, dict[Token, np.float32]] = {}
        for (a, b), v in self.substitutions.items():
            self._from.setdefault(a, {})[b] = v

    def set_substitution(self, a: Token, b: Token, value: float) -> "RuleCosts":
        self.substitutions[a, b] = self._from.setdefault(a, {})[b] = cost(value)
        return self

    def set_deletion(self, token: Token, value: float) -> "RuleCosts":
        self.deletions[token] = cost(value)
        return self

    def set_insertion(self, token: Token, value: float) -> "RuleCosts":
        self.inserted[token] = cost(value)
        return self

    def row(self, token, vocabulary=None):
        return {**self._from.get(token, {}), token: F32(0)}, self.default_substitution

    def deletion(self, token):
        return self.deletions.get(token, self.default_deletion)

    def insertions(self, vocabulary=None):
        return dict(self.inserted), self.default_insertion


def unit_vector(values, dimension: int | None = None) -> np.ndarray:
    """The vector of norm 1, computed in double and kept in single precision."""
    v = np.asarray(values, dtype=np.float32)
    if dimension is not None and v.shape != (dimension,):
        raise errors.InvalidEmbeddingDimension(f"expected {dimension} values, got {v.size}")
    if not v.size:
        raise errors.InvalidEmbeddingDimension("a vector has at least one value")
    bad = np.flatnonzero(~np.isfinite(v))
    if len(bad):
        raise errors.InvalidEmbeddingValue(f"value {v[bad[0]]} at {bad[0]} is not finite")
    norm = np.linalg.norm(v.astype(np.float64))
    if norm == 0:
        raise errors.ZeroNormEmbedding("a vector of norm 0 has no direction")
    return (v.astype(np.float64) / norm).astype(np.float32)


class EmbeddingStore:
    """Tokens and their unit vectors."""

    def __init__(self, vectors: Mapping[Token, object], dimension: int | None = None):
        self.dimension = dimension
        self._rows: dict[Token, np.ndarray] = {}
        self.rejected: list[Token] = []  #: tokens of a snapshot whose rows were none
        for token, v in vectors.items():
            self.insert(token, v)

    def insert(self, token: Token, values) -> np.ndarray | None:
        """Adds or replaces a vector; returns the one replaced."""
        if self.dimension is None:
            self.dimension = len(values)
        old = self._rows.get(token)
        self._rows[token] = unit_vector(values, self.dimension)
        self.__dict__.pop("_matrix", None)
        return old

    def get(self, token: Token) -> np.ndarray | None:
        return self._rows.get(token)

    def __len__(self) -> int:
        return len(self._rows)

    @property
    def tokens(self) -> list[Token]:
        return list(self._rows)

    @property
    def matrix(self) -> np.ndarray:
        if "_matrix" not in self.__dict__:
            self._matrix = np.stack(list(self._rows.values())) if self._rows else np.zeros((0, self.dimension or 0), np.float32)
        return self._matrix

    def verify(self, tolerance: float = 1e-5) -> None:
        """Raises unless every vector is finite, of one dimension and of norm 1, and none was rejected on opening."""
        if self.rejected:
            raise errors.CorruptIndex(f"{len(self.rejected)} vectors are none, that of {self.rejected[0]!r} first")
        for token, v in self._rows.items():
            if v.shape != (self.dimension,) or not np.isfinite(v).all() or abs(np.linalg.norm(v.astype(np.float64)) - 1) > tolerance:
                raise errors.CorruptIndex(f"the vector of {token!r} is not a unit vector of {self.dimension} values")


@dataclass
class CosineCosts(CostPolicy):
    """1 - cosine between vectors, within [0, 1]; ``missing`` where either token has none."""

    store: EmbeddingStore
    missing: float = 1.0
    deletion_cost: float = 1.0
    insertion_cost: float = 1.0

    def __post_init__(self) -> None:
        self.missing, self.deletion_cost, self.insertion_cost = cost(self.missing), cost(self.deletion_cost), cost(self.insertion_cost)

    def row(self, token, vocabulary=None):
        v = self.store.get(token)
        if v is None:
            return {token: F32(0)}, self.missing
        d = np.clip(F32(1) - self.store.matrix @ v, F32(0), F32(1)).astype(np.float32)
        return {**dict(zip(self.store.tokens, d)), token: F32(0)}, self.missing

    def deletion(self, token):
        return self.deletion_cost

    def insertions(self, vocabulary=None):
        return {}, self.insertion_cost


@dataclass
class CosineRows(CostPolicy):
    """Cosine costs of the query tokens alone: ``near`` has, of each, the tokens that cost less than ``missing``."""

    near: dict[Token, dict[Token, np.float32]]
    missing: float = 1.0
    deletion_cost: float = 1.0
    insertion_cost: float = 1.0

    def row(self, token, vocabulary=None):
        return {**self.near.get(token, {}), token: F32(0)}, cost(self.missing)

    def deletion(self, token):
        return cost(self.deletion_cost)

    def insertions(self, vocabulary=None):
        return {}, cost(self.insertion_cost)


def normalized(vectors):
    """A column of vectors, each as ``unit_vector`` makes it; null gives null, an invalid vector an error."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else unit_vector(v))

    return run(vectors)


def unit_rows(vectors: pa.ListArray, dimension: int) -> np.ndarray:
    """``unit_vector`` of each list, all in one pass; what is no vector of this dimension is left to it, for its error."""
    flat = vectors.flatten()
    if (vectors.value_lengths().to_numpy() == dimension).all() and not flat.null_count:
        y = flat.to_numpy().astype(np.float32).reshape(-1, dimension).astype(np.float64)
        norm = np.sqrt((y * y).sum(axis=1))
        if np.isfinite(norm).all() and norm.all():
            return (y / norm[:, None]).astype(np.float32)
    return np.stack([unit_vector(v, dimension) for v in vectors.to_pylist()])


#: Rows and columns of costs that are computed and returned at once.
TILE = 512


def cosine_rows(asked, vectors, block: int = 16 * TILE):
    """(query_token, token, cost) of all pairs of ``asked`` and ``vectors`` (token, embedding), computed on the executors.

    ``asked`` is sent to them ``block`` by ``block``, and ``vectors`` is read once for each; costs are made in tiles. Null tokens and vectors take no part.
    """
    from pyspark.sql import functions as F

    kind = vectors.schema["token"].dataType.simpleString()
    rows = asked.where("token IS NOT NULL AND embedding IS NOT NULL").toLocalIterator()
    out = None
    while part := [(r["token"], unit_vector(r["embedding"])) for r in itertools.islice(rows, block)]:
        shared = vectors.sparkSession.sparkContext.broadcast(([t for t, _ in part], np.stack([v for _, v in part])))

        def run(batches, shared=shared):
            names, x = shared.value
            places: dict = {}
            for i, t in enumerate(names):
                places.setdefault(t, []).append(i)
            names = pa.array(names)
            for batch in batches:
                if not batch.num_rows:
                    continue
                tokens, y = batch.column("token"), unit_rows(batch.column("embedding"), x.shape[1])
                same = [(i, j) for j, t in enumerate(tokens.to_pylist()) for i in places.get(t, ())]
                own_i, own_j = np.array(same, np.int64).reshape(-1, 2).T
                for at in range(0, len(y), TILE):
                    here = tokens.slice(at, TILE)
                    n = len(here)
                    for lo in range(0, len(x), TILE):
                        d = np.clip(F32(1) - x[lo : lo + TILE] @ y[at : at + TILE].T, F32(0), F32(1))
                        own = (own_i >= lo) & (own_i < lo + TILE) & (own_j >= at) & (own_j < at + TILE)
                        d[own_i[own] - lo, own_j[own] - at] = 0
                        m = len(d)
                        yield pa.record_batch([names.take(pa.array(np.repeat(np.arange(lo, lo + m), n))), here.take(pa.array(np.tile(np.arange(n), m))), pa.array(d.ravel())], names=["query_token", "token", "cost"])

        found = vectors.where("token IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, f"query_token {kind}, token {kind}, cost float")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.limit(0).select(F.col("token").alias("query_token"), "token", F.lit(0.0).cast("float").alias("cost"))


def cosine_policy(store: EmbeddingStore, vectors, query, missing: float = 1.0, deletion: float = 1.0, insertion: float = 1.0) -> CosineRows:
    """Cosine costs of a query's tokens, whose vectors are in ``store``, against a table (token, embedding) that stays where it is.

    Only what costs other than ``missing`` comes to the driver.
    """
    session = vectors.sparkSession
    kind = vectors.schema["token"].dataType.simpleString()
    asked = [(t, [float(v) for v in store.get(t)]) for t in dict.fromkeys(query) if store.get(t) is not None]
    if not asked:
        return CosineRows({}, missing, deletion, insertion)
    near: dict = {}
    for r in cosine_rows(session.createDataFrame(asked, f"token {kind}, embedding array<float>"), vectors).where(f"cost <> float({float(cost(missing))})").toLocalIterator():
        near.setdefault(r["query_token"], {})[r["token"]] = F32(r["cost"])
    return CosineRows(near, missing, deletion, insertion)


@dataclass
class CountingCosts(CostPolicy):
    """Another policy, with the number of token costs it was asked for: substitutions as far as a row lists them, deletions, insertions."""

    inner: CostPolicy
    substitutions_asked: int = 0
    deletions_asked: int = 0
    insertions_asked: int = 0

    @property
    def needs_vocabulary(self) -> bool:
        return self.inner.needs_vocabulary

    def row(self, token, vocabulary=None):
        found = self.inner.row(token, vocabulary)
        self.substitutions_asked += len(found[0])
        return found

    def deletion(self, token):
        self.deletions_asked += 1
        return self.inner.deletion(token)

    def insertions(self, vocabulary=None):
        found = self.inner.insertions(vocabulary)
        self.insertions_asked += len(found[0])
        return found


@dataclass
class FunctionCosts(CostPolicy):
    """Any three functions of tokens; they are asked for the whole vocabulary."""

    substitution: Callable[[Token, Token], float]
    delete: Callable[[Token], float]
    insert: Callable[[Token], float]
    needs_vocabulary = True

    def row(self, token, vocabulary=None):
        return {t: cost(self.substitution(token, t)) if t != token else F32(0) for t in vocabulary or ()}, F32(MAX)

    def deletion(self, token):
        return cost(self.delete(token))

    def insertions(self, vocabulary=None):
        return {t: cost(self.insert(t)) for t in vocabulary or ()}, F32(MAX)
