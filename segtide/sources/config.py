"""Cost configurations, embedding and rule files, and compiled snapshots of costs."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide import errors
from segtide.functions.costs import CosineCosts, CostPolicy, EmbeddingStore, RuleCosts, UnitCosts, cost
from segtide.sources.text import open_text, publish_text, read_lines, require_distinct

VERSION = 1


def tokens_of(text: str, tokenizer: str) -> list[str]:
    """What the native tokenisers give, for short texts on the driver."""
    if tokenizer == "character":
        return list(text)
    spaces = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
    return [w for w in text.translate({ord(c): 32 for c in spaces}).split(" ") if w]


def _single(text, tokenizer: str, where: str) -> str:
    if not isinstance(text, str) or tokens_of(text, tokenizer) != [text]:
        raise errors.InvalidFile(f"{where}: {text!r} is not a single token")
    return text


def _strict(value, fields: dict[str, bool], where: str) -> dict:
    """A JSON object with no unknown field and none missing that is True in ``fields``."""
    if not isinstance(value, dict):
        raise errors.InvalidFile(f"{where}: not an object")
    unknown = set(value) - set(fields)
    missing = {k for k, must in fields.items() if must} - set(value)
    if unknown or missing:
        raise errors.InvalidFile(f"{where}: " + ", ".join([f"unknown field {k!r}" for k in sorted(unknown)] + [f"missing field {k!r}" for k in sorted(missing)]))
    return value


def _records(path: str):
    with open_text(path) as f:
        for n, line in enumerate(f, 1):
            try:
                yield n, json.loads(line)
            except ValueError as e:
                raise errors.InvalidFile(f"{path}:{n}: {e}") from e


def _number(value, where: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise errors.InvalidFile(f"{where}: {value!r} is not a number")
    return float(value)


def _cost(value, where: str) -> float:
    try:
        return float(cost(_number(value, where)))
    except errors.InvalidCost as e:
        raise errors.InvalidCost(f"{where}: {e}") from e


def read_embeddings(path: str, tokenizer: str = "whitespace") -> EmbeddingStore:
    """JSON lines of ``token`` and ``embedding``; the first fixes the dimension."""
    store = EmbeddingStore({})
    for n, r in _records(path):
        where = f"{path}:{n}"
        _strict(r, {"token": True, "embedding": True}, where)
        token = _single(r["token"], tokenizer, where)
        if store.get(token) is not None:
            raise errors.InvalidFile(f"{where}: token {token!r} is repeated")
        if not isinstance(r["embedding"], list):
            raise errors.InvalidFile(f"{where}: the embedding is no list")
        try:
            store.insert(token, [_number(v, where) for v in r["embedding"]])
        except (errors.InvalidEmbeddingDimension, errors.InvalidEmbeddingValue, errors.ZeroNormEmbedding) as e:
            raise type(e)(f"{where}: {e}") from e
    if not len(store):
        raise errors.InvalidFile(f"{path} holds no embedding")
    return store


def read_rules(path: str, costs: RuleCosts, tokenizer: str = "whitespace") -> RuleCosts:
    """JSON lines of substitution (from, to), deletion (token) and insertion (token) rules, none repeated; may be empty."""
    fields = {"substitution": ("from", "to"), "deletion": ("token",), "insertion": ("token",)}
    for n, r in _records(path):
        where = f"{path}:{n}"
        op = r.get("operation") if isinstance(r, dict) else None
        if op not in fields:
            raise errors.InvalidFile(f"{where}: unknown operation {op!r}")
        _strict(r, {k: True for k in ("operation", "cost", *fields[op])}, where)
        key = tuple(_single(r[k], tokenizer, where) for k in fields[op])
        value = _cost(r["cost"], where)
        table = {"substitution": costs.substitutions, "deletion": costs.deletions, "insertion": costs.inserted}[op]
        if (key if op == "substitution" else key[0]) in table:
            raise errors.InvalidFile(f"{where}: the rule is repeated")
        getattr(costs, f"set_{op}")(*key, value)
    return costs


def load_costs(path: str, tokenizer: str = "whitespace") -> CostPolicy:
    """A configuration of type ``custom`` or ``embedding``; its data file is relative to it."""
    try:
        config = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise errors.InvalidFile(f"{path}: {e}") from e
    if not isinstance(config, dict) or config.get("type") not in ("custom", "embedding"):
        raise errors.InvalidFile(f"{path}: the type is neither custom nor embedding")
    if config.get("version") != VERSION:
        raise errors.UnsupportedVersion(f"{path}: configuration version {config.get('version')!r}; expected {VERSION}")
    here = Path(path).parent
    data = "rules" if config["type"] == "custom" else "embeddings"
    extra = {"defaults": False} if data == "rules" else {"missing_substitution_cost": False, "deletion_cost": False, "insertion_cost": False}
    _strict(config, {"version": True, "type": True, data: True, **extra}, path)
    _strict(config[data], {"path": True, "format": True}, f"{path}: {data}")
    if config[data]["format"] != "jsonl":
        raise errors.InvalidFile(f"{path}: unknown format {config[data]['format']!r}")
    file = str(here / config[data]["path"])
    if data == "rules":
        d = _strict(config.get("defaults", {}), {"substitution": False, "deletion": False, "insertion": False}, f"{path}: defaults")
        return read_rules(file, RuleCosts(*[_cost(d.get(k, 1.0), path) for k in ("substitution", "deletion", "insertion")]), tokenizer)
    return CosineCosts(read_embeddings(file, tokenizer), *[_cost(config.get(k, 1.0), path) for k in extra])


def save_costs(costs: CostPolicy, path: str, tokenizer: str) -> None:
    """A compiled snapshot: tables sorted by token beside the metadata, put in place at once."""
    part = Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    part.mkdir(parents=True)
    import pyarrow as pa
    import pyarrow.parquet as pq

    meta = {"version": VERSION, "tokenizer": tokenizer}
    if isinstance(costs, UnitCosts):
        meta["kind"] = "levenshtein"
    elif isinstance(costs, RuleCosts):
        meta |= {"kind": "custom", "defaults": [float(costs.default_substitution), float(costs.default_deletion), float(costs.default_insertion)]}
        rows = sorted([("s", a, b, float(v)) for (a, b), v in costs.substitutions.items()] + [("d", t, "", float(v)) for t, v in costs.deletions.items()] + [("i", t, "", float(v)) for t, v in costs.inserted.items()])
        pq.write_table(pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate([("op", pa.string()), ("a", pa.string()), ("b", pa.string()), ("cost", pa.float32())])}), part / "rules.parquet")
    elif isinstance(costs, CosineCosts):
        meta |= {"kind": "embedding", "dimension": costs.store.dimension, "costs": [float(costs.missing), float(costs.deletion_cost), float(costs.insertion_cost)]}
        tokens = sorted(costs.store.tokens)
        pq.write_table(pa.table({"token": pa.array(tokens, pa.string()), "embedding": pa.array([costs.store.get(t) for t in tokens], pa.list_(pa.float32()))}), part / "embeddings.parquet")
    else:
        raise ValueError("costs given as functions cannot be saved")
    (part / "metadata.json").write_text(json.dumps(meta, sort_keys=True), encoding="utf-8")
    target = Path(path)
    old = target.with_name(f"{target.name}.{uuid.uuid4().hex[:8]}.old")
    if target.exists():
        target.rename(old)
    part.rename(target)
    if old.exists():
        shutil.rmtree(old)


def open_costs(path: str, tokenizer: str | None = None) -> CostPolicy:
    """A snapshot; ``tokenizer`` is the index's, with which it must agree."""
    import pyarrow.parquet as pq

    try:
        meta = json.loads((Path(path) / "metadata.json").read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise errors.InvalidFile(f"{path} is no cost snapshot: {e}") from e
    if meta.get("version") != VERSION:
        raise errors.UnsupportedVersion(f"{path}: snapshot version {meta.get('version')!r}; expected {VERSION}")
    if tokenizer is not None and meta.get("tokenizer") != tokenizer:
        raise errors.TokenizerMismatch(f"{path} was compiled for the {meta.get('tokenizer')} tokenizer; the index has {tokenizer}")
    if meta.get("kind") == "levenshtein":
        return UnitCosts()
    if meta.get("kind") == "custom":
        out = RuleCosts(*meta["defaults"])
        for r in pq.read_table(Path(path) / "rules.parquet").to_pylist():
            {"s": lambda r: out.set_substitution(r["a"], r["b"], r["cost"]), "d": lambda r: out.set_deletion(r["a"], r["cost"]), "i": lambda r: out.set_insertion(r["a"], r["cost"])}[r["op"]](r)
        return out
    if meta.get("kind") == "embedding":
        store = EmbeddingStore({}, meta["dimension"])
        for r in pq.read_table(Path(path) / "embeddings.parquet").to_pylist():
            v = np.asarray(r["embedding"], np.float32)
            # a row that can't be a unit vector counts as missing; ``verify`` tells of it
            if v.shape == (store.dimension,) and np.isfinite(v).all() and v.any():
                store._rows[r["token"]] = v
            else:
                store.rejected.append(r["token"])
        return CosineCosts(store, *meta["costs"])
    raise errors.InvalidFile(f"{path}: unknown kind {meta.get('kind')!r}")


def word2vec(spark: SparkSession, path: str, header: str = "auto", transform: Callable | None = None) -> DataFrame:
    """(token, embedding) of a text file of vectors, in file order.

    A header of count and dimension is ``present``, ``absent`` or found out. Rejected: rows of
    another dimension, values that are no finite single floats, vectors of
    zero, repeated tokens, a header that promises other numbers.
    """
    if header not in ("auto", "present", "absent"):
        raise ValueError(f"unknown header mode {header!r}")
    lines = read_lines(spark, path, 1, "line")
    rows = lines.withColumn("p", F.split(F.rtrim("text"), " "))
    top = rows.where("line = 1").first()
    if top is None:
        raise errors.InvalidFile(f"{path} is empty")
    has = header == "present" or (header == "auto" and len(top["p"]) == 2 and all(x.isdigit() for x in top["p"]))
    promise = None
    if has:
        if len(top["p"]) != 2 or not all(x.isdigit() for x in top["p"]):
            raise errors.InvalidFile(f"{path}:1: no header of count and dimension")
        promise = tuple(map(int, top["p"]))
        rows = rows.where("line > 1")
    token = F.get("p", F.lit(0))
    token = transform(token) if transform else token
    rows = rows.select("line", token.alias("token"), F.expr("transform(slice(p, 2, greatest(size(p) - 1, 1)), x -> try_cast(x AS float))").alias("embedding"), (F.size("p") - 1).alias("dim"))
    facts = rows.agg(F.count("*").alias("n"), F.min_by("dim", "line").alias("dim")).first()
    if not facts["n"]:
        raise errors.InvalidFile(f"{path} holds no vector")
    dim = promise[1] if promise else facts["dim"]
    if promise and promise[0] != facts["n"]:
        raise errors.InvalidFile(f"{path}: the header promises {promise[0]} vectors, there are {facts['n']}")
    bad = F.when((F.col("dim") != dim) | (F.col("dim") < 1), "another dimension").when(F.col("token") == "", "no token").when(
        F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "a value that is no finite float").when(~F.exists("embedding", lambda x: x != 0), "a norm of zero")
    worst = rows.select("line", bad.alias("bad")).where("bad IS NOT NULL").orderBy("line").first()
    if worst:
        raise errors.InvalidFile(f"{path}:{worst['line']}: {worst['bad']}")
    twice = rows.groupBy("token").agg(F.max("line").alias("line"), F.count("*").alias("n")).where("n > 1").orderBy("line").first()
    if twice:
        raise errors.InvalidFile(f"{path}:{twice['line']}: token {twice['token']!r} is repeated")
    return rows.orderBy("line").select("token", "embedding")


def convert_embeddings(spark: SparkSession, source: str, target: str, header: str = "auto", form: str = "none", config: str | None = None, missing: float = 1.0, deletion: float = 1.0, insertion: float = 1.0) -> int:
    """Vectors of a text file as JSON lines, optionally with a cost configuration beside them; returns their number."""
    from segtide.functions.normalize import normalize

    if config is not None and (target == "-" or Path(target).suffix in (".gz", ".bz2", ".xz", ".lzma")):
        raise ValueError("a cost configuration needs a plain file of embeddings")
    require_distinct(source, target, config)
    costs = [float(cost(c)) for c in (missing, deletion, insertion)]
    rows = word2vec(spark, source, header, (lambda c: normalize(c, form)) if form != "none" else None)
    n = 0
    with publish_text(target) as f:
        for r in rows.toLocalIterator():
            f.write(json.dumps({"token": r["token"], "embedding": [float(v) for v in r["embedding"]]}, ensure_ascii=False) + "\n")
            n += 1
    if config is not None:
        path = Path(target).resolve()
        base = Path(config).resolve().parent
        name = str(path.relative_to(base)) if path.is_relative_to(base) else str(path)
        Path(config).write_text(json.dumps({"version": VERSION, "type": "embedding", "embeddings": {"path": name, "format": "jsonl"}, "missing_substitution_cost": costs[0], "deletion_cost": costs[1], "insertion_cost": costs[2]}, indent=2) + "\n", encoding="utf-8")
    return n
