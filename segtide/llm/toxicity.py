"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon's terms form a trie. The automaton of "within ``max_edits`` of a
term" is walked along the trie for all terms at once and determinised once, on
the driver, so that executors read each character of each word exactly once in
one table. A hit's score depends on the window around it: quoting and
reporting cues lower it, direct address and further hits raise it. A document
is toxic if its hits' scores add up to ``threshold``.

``learn_lexicon`` mines the terms from labelled documents. Support is counted
in distinct (word before, word after) contexts, so copies of one toxic
document, or one passage in many, count once.

Defined results: a null or empty text has no hits. Whole texts are read, however
long. Every row is judged, repeated rows each give the same row; null
identifiers are kept. Among terms as near as each other the first in sort order
is the hit. An empty table gives no rows; an empty lexicon no hits. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import Scratch, char_tables, chunks, codes, map_batches, owners, runs, sample_bound, sample_rank, texts_of

#: Characters that may stand alone between two letters of one word, as in ``st*pid``.
JOINERS = "@$*!'’"
QUOTES = "\"“”«»„‟"
REPORTING = frozenset(
    "said says wrote writes called calling quote quoted quotes quoting word words term terms insult slur defined means meaning "
    "sagte schrieb nannte zitat wort beleidigung dit écrit appelé citation mot insulte dijo escribió llamó cita palabra insulto".split()
)
ADDRESS = frozenset("you your youre u du dich dir dein deine ihr euch tu toi te vous votre ton ta eres usted ustedes vosotros tú".split())


@dataclass(frozen=True)
class Term:
    text: str
    weight: float = 1.0
    max_edits: int = 1


@dataclass(frozen=True)
class Automaton:
    """``table[state, class]``; state 0 is dead, 1 the start; ``accept`` is a term's index or -1."""

    terms: tuple[Term, ...]
    classes: dict[int, int]
    table: np.ndarray
    accept: np.ndarray
    edits: np.ndarray
    longest: int


def compile_automaton(terms: Iterable[Term]) -> Automaton:
    """Determinises the product of the trie with the Levenshtein automata of its terms."""
    terms = tuple(sorted({t.text: t for t in terms if t.text}.values(), key=lambda t: t.text))
    child: list[dict[str, int]] = [{}]
    end, room = [-1], [-1]  # the term that ends at a node; the most edits of any term below it
    for k, t in enumerate(terms):
        node, path = 0, [0]
        for ch in t.text:
            if ch not in child[node]:
                child[node][ch] = len(child)
                child.append({})
                end.append(-1)
                room.append(-1)
            node = child[node][ch]
            path.append(node)
        end[node] = k
        for p in path:
            room[p] = max(room[p], t.max_edits)
    alphabet = sorted({ch for t in terms for ch in t.text})
    classes = {ord(ch): i + 1 for i, ch in enumerate(alphabet)}

    def closed(items: dict[int, int]) -> frozenset:
        todo = list(items.items())
        while todo:  # a term's letter that the word lacks
            node, e = todo.pop()
            if items[node] < e:
                continue
            for c in child[node].values():
                if e + 1 <= room[c] and e + 1 < items.get(c, 99):
                    items[c] = e + 1
                    todo.append((c, e + 1))
        return frozenset(items.items())

    def step(state: frozenset, ch: str | None) -> frozenset:
        out: dict[int, int] = {}
        for node, e in state:
            hit = child[node].get(ch) if ch else None
            if hit is not None and e <= room[hit] and e < out.get(hit, 99):
                out[hit] = e
            e += 1
            if e <= room[node]:
                if e < out.get(node, 99):
                    out[node] = e  # a letter that the term lacks
                for c in child[node].values():
                    if e <= room[c] and e < out.get(c, 99):
                        out[c] = e
        return closed(out)

    start = closed({0: 0}) if terms else frozenset()
    number, rows, states = {frozenset(): 0, start: 1}, [[0] * (len(alphabet) + 1)], [frozenset(), start]
    if not terms:
        rows.append([0] * (len(alphabet) + 1))
    at = 1
    while terms and at < len(states):
        state = states[at]
        near = {ch for node, _ in state for ch in child[node]}
        other = step(state, None)
        row = []
        for ch in (None, *alphabet):
            nxt = step(state, ch) if ch in near else other
            if nxt not in number:
                number[nxt] = len(states)
                states.append(nxt)
            row.append(number[nxt])
        rows.append(row)
        at += 1
    accept, edits = np.full(len(states), -1, np.int32), np.zeros(len(states), np.int8)
    for i, state in enumerate(states):
        best = min(((e, end[n]) for n, e in state if end[n] >= 0 and e <= terms[end[n]].max_edits), default=None)
        if best:
            edits[i], accept[i] = best
    longest = max((len(t.text) + t.max_edits for t in terms), default=0)
    return Automaton(terms, classes, np.array(rows, dtype=np.int32), accept, edits, longest)


def match_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, machine: Automaton) -> np.ndarray:
    """The accepting state of each lower-cased word, 0 where there is none."""
    final = np.zeros(len(starts), np.int32)
    classes = np.zeros(int(buf.max(initial=0)) + 1, np.int32)
    for c, k in machine.classes.items():
        if c < len(classes):
            classes[c] = k
    cls = classes[buf]
    flat, width = machine.table.ravel(), machine.table.shape[1]
    who = np.flatnonzero(ends - starts <= machine.longest)
    state = np.ones(len(who), np.int32)
    at, stop = starts[who], ends[who]
    while len(who):
        state = flat[state * width + cls[at]]
        at = at + 1
        over = at == stop
        final[who[over]] = state[over]
        go = (state != 0) & ~over
        who, state, at, stop = who[go], state[go], at[go], stop[go]
    final[machine.accept[final] < 0] = 0
    return final


def words_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, the words' starts and ends, and each word's text."""
    lower, kind = char_tables()
    buf, begin, _ = codes(texts)
    inside = (kind[buf] & 3) - 1 < 2  # uint8: 0 wraps round to 255
    joiner = np.isin(buf, np.array([ord(c) for c in JOINERS], np.uint32))
    joiner[1:-1] &= inside[:-2] & inside[2:]
    if len(joiner):
        joiner[[0, -1]] = False
    starts, ends = runs(inside | joiner)
    return lower[buf], starts, ends, owners(starts, begin)


def context_factor(text: str, start: int, end: int, hits_near: int, window: int) -> tuple[float, bool]:
    """(factor, quoted) of a hit from the ``window`` characters on both sides of it."""
    before, after = text[max(0, start - window) : start], text[end : end + window]
    quoted = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
    cues = set(re.findall(r"\w+", (before + " " + after).lower()))
    reported = not REPORTING.isdisjoint(cues)
    factor = (0.05 if reported else 0.2) if quoted else (0.5 if reported and hits_near == 0 else 1.0)
    if not quoted:
        factor *= (1.25 if not ADDRESS.isdisjoint(cues) else 1.0) * (1.25 if hits_near else 1.0)
    return factor, quoted


def score_texts(texts: list[str], machine: Automaton, *, window: int = 80, per_edit: float = 0.6) -> list[tuple[int, float, int, int, list[str]]]:
    """(text's index, score, hits, quoted hits, terms) of each text that has a hit."""
    found = []
    if not machine.terms:
        return found
    for i, j in chunks(texts):
        low, starts, ends, who = words_in(texts[i:j])
        final = match_words(low, starts, ends, machine)
        hit = np.flatnonzero(final)
        if not len(hit):
            continue
        begin = codes(texts[i:j])[1]
        cuts = np.flatnonzero(np.diff(who[hit], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            doc = int(who[hit[a]])
            where = starts[hit[a:b]] - begin[doc]
            near = np.searchsorted(where, where + window, side="right") - np.searchsorted(where, where - window) - 1
            score, quoted, names = 0.0, 0, set()
            for k, h in enumerate(hit[a:b]):
                term = machine.terms[machine.accept[final[h]]]
                factor, q = context_factor(texts[i + doc], int(where[k]), int(ends[h] - begin[doc]), int(near[k]), window)
                score += term.weight * per_edit ** int(machine.edits[final[h]]) * factor
                quoted += q
                names.add(term.text)
            found.append((i + doc, score, int(b - a), quoted, sorted(names)))
    return found


def score_documents(docs: DataFrame, machine: Automaton, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 1.0, window: int = 80) -> DataFrame:
    """(id, score, hits, quoted_hits, terms) of the toxic documents: those whose score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [r for r in score_texts(texts_of(batch, "t"), shared.value, window=window) if r[1] >= threshold]
            cols = list(zip(*rows)) if rows else [()] * 5
            return pa.record_batch(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.string()))],
                names=[id_col, "score", "hits", "quoted_hits", "terms"],
            )
        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col).alias("t")), make, f"`{id_col}` {kind}, score double, hits long, quoted_hits long, terms array<string>")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], *, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(t, y): the texts of at most about ``most[y]`` labelled identifiers of each class, chosen by hash, each text once a class."""
    given = labels.where(F.col(label).isin(list(most)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r[0]: r[1] for r in given.groupBy("y").count().collect()}
    bound = F.coalesce(*[F.when(F.col("y") == y, F.lit(sample_bound(n, counts.get(y, 0))).cast("long")) for y, n in most.items()])
    chosen = given.where(sample_rank(F.col("i"), seed=seed) < bound)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    return texts.join(F.broadcast(chosen), "i").select("t", "y").distinct()  # broadcast: its size is bounded by ``most``


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_toxic: int = 5_000, max_clean: int = 15_000, precision: float = 0.8, alpha: float = 0.05, min_fuzzy: int = 5, seed: int = 11,
) -> list[Term]:
    """Terms whose contexts are toxic ones beyond chance, from at most about ``max_toxic`` + ``max_clean`` labelled rows.

    A term needs a share of toxic contexts of ``precision`` and a Chernoff bound
    below ``alpha`` over all words together. It may be matched with one edit if
    it has ``min_fuzzy`` letters and the sample's other words within one edit
    are hardly ever in clean contexts.
    """
    scratch = Scratch(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, {1: max_toxic, 0: max_clean}, id_col=id_col, text_col=text_col, seed=seed)
    words = sample.select("y", F.array_remove(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), "").alias("w"))
    one = words.select("y", F.explode(F.expr("transform(w, (x, i) -> struct(x AS word, xxhash64(get(w, i - 1), get(w, i + 1)) AS c))")).alias("e"))
    counts = one.select("y", "e.word", "e.c").distinct().groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counts = scratch.write(counts.where("length(word) BETWEEN 2 AND 40"), "words")
    a_all, b_all, size = counts.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    if not a_all:
        return []
    p0 = min(max(a_all / (a_all + (b_all or 0)), 1e-9), 1 - 1e-9)
    n, share = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    kl = share * F.log(share / p0) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p0))).otherwise(0.0)
    picked = counts.where((F.col("a") > 0) & (share >= precision) & (share > p0) & (n * kl >= math.log(size / alpha))).collect()
    picked.sort(key=lambda r: r["word"])
    trial = compile_automaton(Term(r["word"], 1.0, 1) for r in picked if len(r["word"]) >= min_fuzzy)
    shared = docs.sparkSession.sparkContext.broadcast(trial)

    def make():
        m = shared.value
        own = {t.text for t in m.terms}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("word").to_pylist()
            buf, s, e = codes(texts)
            final = match_words(buf, s, e, m)
            keep = [i for i in np.flatnonzero(final).tolist() if texts[i] not in own]
            return pa.record_batch([pa.array([m.terms[m.accept[final[i]]].text for i in keep], pa.string()), batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["term", "a", "b"])
        return step

    bad = {r[0] for r in map_batches(counts.select("word", "a", "b"), make, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("b > 0.02 * a").collect()}
    scratch.drop("words")
    return [Term(r["word"], 1.0, int(len(r["word"]) >= min_fuzzy and r["word"] not in bad)) for r in picked]
