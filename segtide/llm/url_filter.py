"""URL filters: one trie over reversed host labels and path segments, longest match first.

An entry is ``host`` or ``host/segment/...``. Its host stands for the host and
all its subdomains, its path for that path and all below it. Of the matching
entries the one with most host labels decides, among those the one with most
path segments, and of an allow and a block entry for the same place the block.
A URL that no entry matches is allowed.

The trie is broadcast up to ``max_broadcast_entries`` entries. Beyond that the
entries are joined by hashed place: each URL asks for its own at most
labels x segments places, so the join is an equality join of any size. Both ways
give the same rows, and raise ValueError for an entry without a host or with another verdict.

Defined results: a null, empty or hostless URL is ``invalid`` and not kept.
Scheme, user, port, query, fragment, letter case of the host, a trailing dot
and empty path segments do not matter; percent escapes of path segments are
decoded. A host given as an IP address is one label. Very long URLs are read
whole; repeated rows each get the same row; empty tables give no rows; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import map_batches

URL = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?([^?#]*)")
ADDRESS = re.compile(r"^\d+\.\d+\.\d+\.\d+$")


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """(reversed host labels, path segments), or None where there is no host."""
    m = URL.match(url or "")
    host = m[1].lower().rstrip(".").strip() if m else ""
    if not host:
        return None
    labels = [host] if host[0] == "[" or ADDRESS.match(host) else host.split(".")[::-1]
    return labels, [unquote(s) for s in m[2].split("/") if s]


def problem(text: str | None, verdict: str | None) -> str | None:
    """What is wrong with an entry, if anything."""
    if verdict not in ("allow", "block"):
        return f"verdict {verdict!r} of {text!r} is neither allow nor block"
    return f"entry {text!r} has no host" if parts(text) is None else None


class Trie:
    """Nodes are dicts: a host label or, as a 1-tuple, a path segment leads on; None holds (verdict, entry)."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for text, verdict in entries:
            if wrong := problem(text, verdict):
                raise ValueError(wrong)
            p = parts(text)
            node = self.root
            for key in [*p[0], *((s,) for s in p[1])]:
                node = node.setdefault(key, {})
            if None not in node or (verdict == "block" and node[None][0] == "allow"):
                node[None] = (verdict, place(*p))

    def find(self, labels: list[str], segments: list[str]) -> tuple[str, str] | None:
        """The (verdict, entry) of the longest match."""
        best, node = None, self.root
        for label in labels:
            node = node.get(label)
            if node is None:
                break
            here, below = node.get(None), node
            for s in segments:
                below = below.get((s,))
                if below is None:
                    break
                here = below.get(None, here)
            best = here or best
        return best


def place(labels: list[str], segments: list[str]) -> str:
    return "/".join([".".join(labels[::-1]), *segments])


def filter_urls(
    urls: DataFrame, entries: Iterable[tuple[str, str]] | DataFrame, *, id_col: str = "page_id", url_col: str = "url",
    entry_col: str = "entry", verdict_col: str = "verdict", max_broadcast_entries: int = 1_000_000,
) -> DataFrame:
    """(id, verdict, entry, kept) for every row. ``entries``: (entry, 'allow' | 'block') pairs, or a table of them."""
    if isinstance(entries, DataFrame):
        given = entries.select(F.col(entry_col).alias("entry"), F.col(verdict_col).alias("verdict"))
        if given.limit(max_broadcast_entries + 1).count() > max_broadcast_entries:
            return _joined(urls, given, id_col, url_col)
        entries = [tuple(r) for r in given.collect()]
    shared = urls.sparkSession.sparkContext.broadcast(Trie(entries))
    kind = urls.schema[id_col].dataType.simpleString()

    def make():
        trie = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for u in batch.column("u").to_pylist():
                p = parts(u)
                out.append(("invalid", None) if p is None else trie.find(*p) or ("allow", None))
            verdicts = [v for v, _ in out]
            return pa.record_batch([batch.column(0), pa.array(verdicts, pa.string()), pa.array([e for _, e in out], pa.string()), pa.array([v == "allow" for v in verdicts])], names=[id_col, "verdict", "entry", "kept"])
        return step

    return map_batches(urls.select(F.col(id_col), F.col(url_col).alias("u")), make, f"`{id_col}` {kind}, verdict string, entry string, kept boolean")


def _prefixes(labels: list[str], segments: list[str]) -> list[bytes]:
    """A digest of each place that could match, by falling precedence; each path's are made in one pass."""
    out = []
    for i in range(len(labels), 0, -1):
        h = hashlib.blake2b(".".join(labels[:i][::-1]).encode("utf-8", "surrogatepass"), digest_size=16)
        mine = [h.digest()]
        for s in segments:
            h.update(b"/" + s.replace("/", "//").encode("utf-8", "surrogatepass"))  # a decoded slash is no border
            mine.append(h.digest())
        out += mine[::-1]
    return out


def _joined(urls: DataFrame, entries: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """The same result by an equality join on digests of places, for lists too large to broadcast."""

    def asked(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # a batch a URL, as long paths have many places
                p = parts(batch.column("u")[at].as_py())
                mine = _prefixes(*p) if p else [None]
                n = len(mine)
                copied = [batch.column(c).take(pa.array(np.full(n, at))) for c in ("n", "id", "copies")]
                yield pa.record_batch([*copied, pa.array(np.arange(n)), pa.array(mine, pa.binary()), pa.array(np.full(n, p is not None))], names=["n", "id", "copies", "rank", "place", "ok"])

    kind = urls.schema[id_col].dataType.simpleString()

    def normal(batches):
        for batch in batches:
            rows = list(zip(batch.column("entry").to_pylist(), batch.column("verdict").to_pylist()))
            wrong = [problem(*r) for r in rows]
            p = [None if w else parts(r[0]) for r, w in zip(rows, wrong)]
            yield pa.record_batch([pa.array([_prefixes(*x)[0] if x else None for x in p], pa.binary()), pa.array([place(*x) if x else None for x in p], pa.string()), batch.column("verdict"), pa.array(wrong, pa.string())], names=["place", "entry", "v", "wrong"])

    rules = entries.mapInArrow(normal, "place binary, entry string, v string, wrong string")
    if wrong := rules.where("wrong IS NOT NULL").select("wrong").first():
        raise ValueError(wrong[0])
    rules = rules.groupBy("place").agg(F.max(F.struct("v", "entry")).alias("rule"))  # block sorts after allow
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).groupBy("id", "u").agg(F.count("*").alias("copies"))
    key = F.sha2(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "u")), 256)  # which leaves out what is null
    many = rows.select(key.alias("n"), "id", "u", "copies").mapInArrow(asked, f"n string, id {kind}, copies long, rank long, place binary, ok boolean").join(rules, "place", "left")
    best = many.groupBy("n").agg(F.first("id").alias("id"), F.first("copies").alias("copies"), F.min(F.when(F.col("rule").isNotNull(), F.struct("rank", "rule"))).alias("b"), F.first("ok").alias("ok"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    verdict = F.when(~F.col("ok"), "invalid").otherwise(F.coalesce("b.rule.v", F.lit("allow")))
    return best.select(F.col("id").alias(id_col), verdict.alias("verdict"), F.col("b.rule.entry").alias("entry"), (verdict == "allow").alias("kept"))
