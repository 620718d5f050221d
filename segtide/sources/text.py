"""Lines of text as sequences, compressed files, and the writers of results."""

from __future__ import annotations

import bz2
import gzip
import lzma
import sys
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segtide import errors

_SUFFIXES = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open, ".lzma": lzma.open}


def open_text(path: str, mode: str = "rt"):
    """A text file by its suffix; ``-`` is standard input or output. Writing makes the parents."""
    if path == "-":
        return sys.stdin if "r" in mode else sys.stdout
    if "w" in mode:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    return _SUFFIXES.get(Path(path).suffix, open)(path, mode, encoding="utf-8", newline="\n" if "w" in mode else "")


def require_distinct(*paths: str | None) -> None:
    """Raises where two of the paths are one file, before any of them is opened; ``-`` and None are no files."""
    seen: dict[Path, str] = {}
    for p in paths:
        if p is None or p == "-":
            continue
        real = Path(p).resolve()
        if real in seen:
            raise ValueError(f"{p} and {seen[real]} are the same file")
        seen[real] = p


@contextmanager
def publish_text(path: str):
    """A text file for writing that takes its name once it is written to the end; a failed run leaves what was there."""
    if path == "-":
        yield sys.stdout
        return
    target = Path(path)
    part = target.with_name(f"{target.stem}.{uuid.uuid4().hex[:8]}.part{target.suffix}")
    try:
        with open_text(str(part), "wt") as f:
            yield f
        part.replace(target)
    finally:
        part.unlink(missing_ok=True)


def number_lines(lines: DataFrame, start: int = 0, name: str = "seq_id") -> DataFrame:
    """Adds dense numbers in file order without gathering the rows: a partition's offset and the place within it.

    Rows must come straight from one scan of one file, whose partitions are in its order.
    """
    marked = lines.withColumn("_m", F.monotonically_increasing_id())
    sizes = marked.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_o"))  # one row a partition
    place = F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_o") + start
    return marked.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_p").withColumn(name, place).drop("_m", "_p", "_n", "_o")


def read_lines(spark: SparkSession, path: str, start: int = 0, name: str = "seq_id") -> DataFrame:
    """(name, text): a line is what stands before a line feed, less one carriage return; bytes that are no UTF-8 are an error."""
    if path == "-" or Path(path).suffix in (".xz", ".lzma"):
        with open_text(path) as f:
            rows = [(start + n, line.rstrip("\n").removesuffix("\r")) for n, line in enumerate(f)]
        return spark.createDataFrame(rows, f"{name} long, text string")
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.regexp_replace("value", r"\r\z", "")
    checked = F.when(F.is_valid_utf8("value"), text).otherwise(F.raise_error(F.lit(f"{path} is not UTF-8")))
    return number_lines(raw, start, name).select(name, checked.alias("text"))


def format_f32(value: Column) -> Column:
    """The shortest decimal that reads back as the same single float, without exponent or trailing zeros."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or np.isnan(v) else np.format_float_positional(np.float32(v), unique=True, trim="-"))

    return run(value)


def _field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '\t"\n\r') else text


def tsv_lines(located: DataFrame):
    """The lines of located matches: id, distance, first and last byte, text; no header, quoted only where needed."""
    rows = located.orderBy("seq_id", "byte_start", "byte_end").select("seq_id", format_f32(F.col("distance")).alias("d"), "byte_start", "byte_end", "matched_text")
    for r in rows.toLocalIterator():
        yield "\t".join([str(r[0]), r[1], str(r[2]), str(r[3]), _field(r[4])])


def write_tsv(located: DataFrame, path: str) -> None:
    """The same as files written by the executors."""
    rows = located.orderBy("seq_id", "byte_start", "byte_end").select(F.col("seq_id"), format_f32(F.col("distance")).alias("distance"), "byte_start", "byte_end", "matched_text")
    rows.write.options(sep="\t", header=False, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)


def preprocess(lines: DataFrame, tokenize=None, form: str = "none", text_col: str = "text") -> DataFrame:
    """Each text normalised, then its tokens parted by single blanks; one row in, one out.

    ``tokenize`` is a Column -> Column function that gives an array of strings;
    by default the words between white space. A morphological analyser fits in here.
    """
    from segtide.functions.normalize import normalize
    from segtide.functions.tokens import flatten

    text = normalize(F.col(text_col), form)
    return lines.withColumn(text_col, F.array_join(F.filter(tokenize(text), lambda t: flatten(t) != ""), " ") if tokenize else flatten(text))


def read_passages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(line, id, pageid, revid, title, section, text): flattened passages with text, numbered from 1; ``limit`` counts those kept."""
    from segtide.functions.tokens import flatten

    schema = "id long, pageid long, revid long, title string, section string, text string"
    raw = spark.read.text(path).where(F.trim("value") != "")
    rows = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("p")).select("p.*")
    bad = F.col("id").isNull() | F.col("pageid").isNull() | F.col("revid").isNull() | (F.least("id", "pageid", "revid") < 0) | F.col("title").isNull() | F.col("section").isNull() | F.col("text").isNull()
    rows = rows.withColumn("text", F.when(bad, F.raise_error(F.lit(f"{path}: a passage lacks a field or has a negative number"))).otherwise(flatten(F.col("text")))).where("text <> ''")
    numbered = number_lines(rows, 1, "line")
    return (numbered.where(F.col("line") <= max(limit, 0)) if limit is not None else numbered).select("line", "id", "pageid", "revid", "title", "section", "text")


def release_url(dataset: str, dump: str, base: str) -> str:
    """Where an archive of passages would be; nothing is fetched here."""
    return f"{base.rstrip('/')}/{dataset}/{dump}/{dataset}-{dump}.json.gz"
