"""``python -m segtide``: index, costs, search, convert-embeddings, preprocess, passages, generate, measure."""

from __future__ import annotations

import argparse
import sys
import time
import uuid
from pathlib import Path

from segtide import errors


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("segtide").getOrCreate()


class Clock:
    """Milliseconds of named phases, reported on standard error."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, float]] = []
        self.begun = self.last = time.perf_counter()

    def mark(self, name: str) -> None:
        now = time.perf_counter()
        self.parts.append((name, (now - self.last) * 1000))
        self.last = now

    def report(self) -> None:
        total = (time.perf_counter() - self.begun) * 1000
        print("timing: " + " ".join(f"{n}={ms:.3f}ms" for n, ms in [*self.parts, ("total", total)]), file=sys.stderr)


def build_index(spark, index: str, corpus: str, tokenizer: str, clock: Clock) -> None:
    from pyspark.sql import functions as F

    from segtide.functions.tokens import TOKENIZERS
    from segtide.operators.index import SegmentIndex, _hadoop, put_in_place
    from segtide.sources.text import read_lines

    lines = read_lines(spark, corpus)
    clock.mark("read")
    sources = lines.select("seq_id", "text")
    # all is written beside the index and put in its place at the end: a failed run leaves the old one as it was
    part = f"{index.rstrip('/')}.{uuid.uuid4().hex[:8]}.part"
    try:
        sources.write.parquet(f"{part}/sources")
        sources = spark.read.parquet(f"{part}/sources")
        built = SegmentIndex.build(sources.select("seq_id", TOKENIZERS[tokenizer](F.col("text")).alias("tokens")), tokenizer=tokenizer)
        clock.mark("build")
        built.save(f"{part}/index")
        put_in_place(spark, part, index)
    except BaseException:
        fs, folder = _hadoop(spark, part)
        fs.delete(folder, True)
        raise
    clock.mark("save")


def find(spark, index: str, query: str, threshold: float, costs: str | None, verify: bool, clock: Clock):
    from segtide.functions.costs import CosineCosts, UnitCosts
    from segtide.operators.index import SegmentIndex
    from segtide.operators.search import locate
    from segtide.plans.planner import SearchParams
    from segtide.sources.config import load_costs, open_costs, tokens_of
    from segtide.sources.text import tsv_lines

    opened = SegmentIndex.open(spark, f"{index}/index")
    if verify:
        opened.verify()
    clock.mark("open")
    policy = UnitCosts() if costs is None else open_costs(costs, opened.tokenizer) if Path(costs).is_dir() else load_costs(costs, opened.tokenizer)
    if verify and isinstance(policy, CosineCosts):
        policy.store.verify()
    clock.mark("costs")
    matches = opened.searcher(policy).search(tokens_of(query, opened.tokenizer), SearchParams(threshold), ordered=False)
    yield from tsv_lines(locate(matches, spark.read.parquet(f"{index}/sources"), opened.tokenizer))
    clock.mark("search")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="segtide", description="Exact weighted-edit-distance segment search.")
    sub = p.add_subparsers(dest="command", required=True)
    tok = dict(choices=["character", "whitespace"], default="character")
    c = sub.add_parser("index", help="index the lines of a text")
    c.add_argument("index")
    c.add_argument("corpus", nargs="?", default="-")
    c.add_argument("--tokenizer", **tok)
    c.add_argument("--timing", action="store_true")
    c = sub.add_parser("costs", help="compile a cost configuration")
    c.add_argument("costs")
    c.add_argument("snapshot")
    c.add_argument("--tokenizer", **tok)
    c.add_argument("--timing", action="store_true")
    c = sub.add_parser("search", help="print the segments within a threshold")
    c.add_argument("index")
    c.add_argument("query")
    c.add_argument("-t", "--threshold", type=float, default=0.0)
    c.add_argument("--costs")
    c.add_argument("--verify", action="store_true")
    c.add_argument("--timing", action="store_true")
    c = sub.add_parser("convert-embeddings", help="vectors of a text file as JSON lines")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--header", choices=["auto", "present", "absent"], default="auto")
    c.add_argument("--normalization", choices=["none", "nfc", "nfkc", "nfkc-casefold"], default="none")
    c.add_argument("--cost-config")
    for name in ("missing-substitution", "deletion", "insertion"):
        c.add_argument(f"--{name}-cost", type=float, default=1.0)
    c = sub.add_parser("preprocess", help="normalise a text and part its words by blanks")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--normalization", choices=["none", "nfc", "nfkc", "nfkc-casefold"], default="none")
    c.add_argument("--tokenizer", choices=["whitespace", "character"], default="whitespace")
    c.add_argument("--analyzer", help="module:function of a text column that gives its tokens; instead of a tokenizer")
    c = sub.add_parser("passages", help="texts of an archive of passages, and their metadata")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--metadata")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("generate", help="write the seeded corpus of the workloads")
    c.add_argument("output")
    for name, value in (("sequences", 20_000), ("length", 32), ("vocabulary", 256), ("hot", 8)):
        c.add_argument(f"--{name}", type=int, default=value)
    c.add_argument("--seed", type=int)
    c = sub.add_parser("measure", help="time building, saving, opening and searching a corpus of blank-parted tokens")
    c.add_argument("corpus")
    c.add_argument("--query")
    c.add_argument("-t", "--threshold", type=float, default=0.0)
    c.add_argument("--warm-runs", type=int, default=5)
    c.add_argument("--policy", choices=["levenshtein", "cosine"], default="levenshtein")
    return p


#: Arguments that name a file or folder.
PATHS = ("index", "corpus", "costs", "snapshot", "input", "output", "metadata", "cost_config")


def column_function(path: str):
    """``module:name`` of a function of a text column that gives its tokens, such as a morphological analyser's."""
    import importlib

    module, _, name = path.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"{path!r} names no function: {e}") from e


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    clock = Clock()
    from pyspark.errors import PySparkException

    from segtide.sources.text import require_distinct

    try:
        # before anything is opened, as an output that is an input would be lost
        require_distinct(*[v for k, v in vars(a).items() if k in PATHS])
        if a.command == "index":
            build_index(_spark(), a.index, a.corpus, a.tokenizer, clock)
        elif a.command == "costs":
            from segtide.sources.config import load_costs, save_costs

            loaded = load_costs(a.costs, a.tokenizer)
            clock.mark("read")
            save_costs(loaded, a.snapshot, a.tokenizer)
            clock.mark("save")
        elif a.command == "search":
            for line in find(_spark(), a.index, a.query, a.threshold, a.costs, a.verify, clock):
                print(line)
        elif a.command == "convert-embeddings":
            from segtide.sources.config import convert_embeddings

            convert_embeddings(_spark(), a.input, a.output, a.header, a.normalization, a.cost_config, a.missing_substitution_cost, a.deletion_cost, a.insertion_cost)
        elif a.command == "preprocess":
            from segtide.sources.text import preprocess, publish_text, read_lines

            from segtide.functions.tokens import TOKENIZERS

            tokens = column_function(a.analyzer) if a.analyzer else TOKENIZERS["character"] if a.tokenizer == "character" else None
            rows = preprocess(read_lines(_spark(), a.input), tokens, form=a.normalization).orderBy("seq_id")
            with publish_text(a.output) as f:
                for r in rows.toLocalIterator():
                    f.write(r["text"] + "\n")
        elif a.command == "generate":
            from segtide.sources.synthetic import CORPUS_SEED, corpus
            from segtide.sources.text import publish_text

            with publish_text(a.output) as f:
                for row in corpus(a.sequences, a.length, a.vocabulary, a.hot, CORPUS_SEED if a.seed is None else a.seed):
                    f.write(" ".join(row) + "\n")
        elif a.command == "measure":
            import json

            from segtide.measure import measure

            print(json.dumps(measure(_spark(), a.corpus, a.query, a.threshold, a.warm_runs, a.policy)))
        else:
            import json
            from contextlib import nullcontext

            from segtide.sources.text import publish_text, read_passages

            rows = read_passages(_spark(), a.input, a.limit).orderBy("line")
            with publish_text(a.output) as f, publish_text(a.metadata) if a.metadata else nullcontext() as m:
                for r in rows.toLocalIterator():
                    f.write(r["text"] + "\n")
                    if m:
                        m.write(json.dumps({k: r[k] for k in ("line", "id", "pageid", "revid", "title", "section")}, ensure_ascii=False) + "\n")
    except (errors.SegtideError, OSError, ValueError, PySparkException) as e:
        print(f"error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        return 1
    if getattr(a, "timing", False):
        clock.report()
    return 0
