"""The index: corpus, vocabulary and postings as DataFrames, kept in Parquet.

Tokens stay tokens of any atomic type. There is no numbering of the vocabulary,
so building needs no global order: frequencies are one aggregation, postings one
explode, sorted by token so that Parquet's row-group statistics are the inverted list.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segtide import errors

VERSION = 1


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def put_in_place(spark: SparkSession, part: str, path: str) -> None:
    """Renames a finished folder to ``path``; what was there is kept beside it until that is done, and comes back if it fails."""
    fs, target = _hadoop(spark, path)
    _, ready = _hadoop(spark, part)
    old = None
    if fs.exists(target):
        _, old = _hadoop(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.old")
        if not fs.rename(target, old):
            raise OSError(f"could not move the old {path} aside")
    if not fs.rename(ready, target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"could not put {path} in place")
    if old is not None:
        fs.delete(old, True)


@dataclass
class SegmentIndex:
    """``corpus`` (seq_id, tokens), ``vocabulary`` (token, frequency), ``postings`` (token, seq_id, pos); ``inverted`` where postings are saved, sorted by token."""

    spark: SparkSession
    corpus: DataFrame
    vocabulary: DataFrame
    postings: DataFrame
    token_type: str
    tokenizer: str | None = None
    total_tokens: int | None = None
    vocabulary_size: int | None = None
    inverted: bool = False

    @classmethod
    def build(cls, sequences: DataFrame, id_col: str = "seq_id", tokens_col: str = "tokens", tokenizer: str | None = None) -> "SegmentIndex":
        """From any DataFrame of identified arrays; null arrays count as empty.

        A null token has no frequency and no posting, so it anchors nothing and equals no query token; in a match it
        takes a place, at the cost of a token that the policy knows nothing of.
        """
        corpus = sequences.select(F.col(id_col).cast("long").alias("seq_id"), F.coalesce(F.col(tokens_col), F.array().cast(sequences.schema[tokens_col].dataType)).alias("tokens"))
        postings = corpus.select("seq_id", F.posexplode("tokens").alias("pos", "token")).where("token IS NOT NULL").select("token", "seq_id", "pos")
        vocabulary = postings.groupBy("token").agg(F.count("*").alias("frequency"))
        return cls(sequences.sparkSession, corpus, vocabulary, postings, corpus.schema["tokens"].dataType.elementType.simpleString(), tokenizer)

    def count(self) -> tuple[int, int]:
        """(all tokens, distinct tokens), computed once."""
        if self.total_tokens is None:
            row = self.vocabulary.agg(F.coalesce(F.sum("frequency"), F.lit(0)), F.count("*")).first()
            self.total_tokens, self.vocabulary_size = int(row[0]), int(row[1])
        return self.total_tokens, self.vocabulary_size

    def frequencies(self, tokens: list) -> dict:
        """Those of the tokens that occur."""
        if not tokens:
            return {}
        if len(tokens) <= 1000:
            found = self.vocabulary.where(F.col("token").isin(list(tokens)))
        else:
            asked = self.spark.createDataFrame([(t,) for t in tokens], f"token {self.token_type}")
            found = self.vocabulary.join(asked, "token", "left_semi")
        return {r["token"]: r["frequency"] for r in found.collect()}

    def numbered_vocabulary(self) -> DataFrame:
        """(token, symbol, frequency): numbers by falling frequency, ties by first occurrence. Numbering sorts the vocabulary as a whole; searches don't need it."""
        first = self.postings.groupBy("token").agg(F.count("*").alias("frequency"), F.min(F.struct("seq_id", "pos")).alias("first"))
        order = Window.orderBy(F.desc("frequency"), "first")
        return first.select("token", (F.row_number().over(order) - 1).cast("long").alias("symbol"), "frequency")

    def encode(self) -> DataFrame:
        """(seq_id, symbols) by the numbered vocabulary; null tokens have none."""
        coded = self.postings.join(self.numbered_vocabulary(), "token").groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("s"))
        return self.corpus.join(coded, "seq_id", "left").select("seq_id", F.coalesce(F.transform("s", lambda x: x["symbol"]), F.array().cast("array<long>")).alias("symbols"))

    def decode(self, coded: DataFrame) -> DataFrame:
        """(seq_id, tokens) of (seq_id, symbols) as ``encode`` gives them; a symbol that no token has is an error."""
        one = coded.select("seq_id", F.posexplode_outer("symbols").alias("pos", "symbol"))
        named = one.join(self.numbered_vocabulary().select("token", "symbol"), "symbol", "left")
        token = F.when(F.col("symbol").isNotNull() & F.col("token").isNull(), F.raise_error(F.concat(F.lit("no token has symbol "), F.col("symbol")))).otherwise(F.col("token"))
        rows = named.withColumn("token", token).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("pos", "token")))).alias("t"))
        return rows.select("seq_id", F.transform("t", lambda x: x["token"]).alias("tokens"))

    def with_vocabulary_at(self, path: str) -> "SegmentIndex":
        """The same index over a vocabulary that is written to ``path``, or read from there if it is there already; corpus and postings stay views, so nothing of their size is moved."""
        if not _exists(self.spark, path):
            part = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.part"
            self.vocabulary.write.parquet(part)
            put_in_place(self.spark, part, path)
        vocabulary = self.spark.read.schema(f"token {self.token_type}, frequency long").parquet(path)
        return SegmentIndex(self.spark, self.corpus, vocabulary, self.postings, self.token_type, self.tokenizer)

    def alphabet(self) -> DataFrame:
        return self.vocabulary.select("token")

    def save(self, path: str) -> "SegmentIndex":
        """Writes the tables beside ``path``, then puts them in its place; metadata come last. Returns the saved index."""
        part = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.part"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.corpus.repartition(parts, "seq_id").write.parquet(f"{part}/corpus")  # a table of one file becomes one of many
        corpus = self.spark.read.parquet(f"{part}/corpus")
        fresh = SegmentIndex.build(corpus, tokenizer=self.tokenizer)
        fresh.vocabulary.sortWithinPartitions("token").write.parquet(f"{part}/vocabulary")
        # by sequence too, so that a frequent token isn't one task's
        fresh.postings.repartitionByRange("token", "seq_id").sortWithinPartitions("token", "seq_id", "pos").write.parquet(f"{part}/postings")
        row = self.spark.read.parquet(f"{part}/vocabulary").agg(F.coalesce(F.sum("frequency"), F.lit(0)), F.count("*")).first()
        meta = {"version": VERSION, "tokenizer": self.tokenizer, "token_type": self.token_type, "sequence_count": corpus.count(), "total_tokens": int(row[0]), "vocabulary_size": int(row[1])}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{part}/metadata")
        put_in_place(self.spark, part, path)
        return SegmentIndex.open(self.spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "SegmentIndex":
        try:
            text = "".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect())
            meta = json.loads(text)
        except Exception as e:
            raise errors.InvalidFile(f"{path} is no index: {str(e).splitlines()[0]}") from e
        fields = {"version", "tokenizer", "token_type", "sequence_count", "total_tokens", "vocabulary_size"}
        if not isinstance(meta, dict) or set(meta) != fields:
            raise errors.InvalidFile(f"the metadata of {path} do not have the fields {sorted(fields)}")
        if meta["version"] != VERSION:
            raise errors.UnsupportedVersion(f"index version {meta['version']}; expected {VERSION}")
        t = meta["token_type"]
        missing = [n for n in ("corpus", "vocabulary", "postings") if not _exists(spark, f"{path}/{n}")]
        if missing:
            raise errors.InvalidFile(f"{path} lacks the tables {missing}")
        return cls(
            spark, spark.read.schema(f"seq_id long, tokens array<{t}>").parquet(f"{path}/corpus"), spark.read.schema(f"token {t}, frequency long").parquet(f"{path}/vocabulary"),
            spark.read.schema(f"token {t}, seq_id long, pos int").parquet(f"{path}/postings"), t, meta["tokenizer"], meta["total_tokens"], meta["vocabulary_size"], True,
        )

    def problems(self) -> DataFrame:
        """(problem, rows) of what disagrees between the three tables."""
        real = self.corpus.select("seq_id", F.posexplode("tokens").alias("pos", "token")).where("token IS NOT NULL").select("token", "seq_id", "pos")
        key = ["token", "seq_id", "pos"]
        counted = real.groupBy("token").agg(F.count("*").alias("n"))
        checks = {
            "posting without token": self.postings.join(real, key, "left_anti"),
            "token without posting": real.join(self.postings, key, "left_anti"),
            "repeated posting": self.postings.groupBy(*key).count().where("count > 1"),
            "wrong frequency": self.vocabulary.join(counted, "token", "full").where("NOT (frequency <=> n)"),
            "repeated token": self.vocabulary.groupBy("token").count().where("count > 1"),
            "repeated sequence": self.corpus.groupBy("seq_id").count().where("count > 1"),
        }
        out = None
        for name, rows in checks.items():
            one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("problem"), "rows")
            out = one if out is None else out.unionByName(one)
        return out.where("rows > 0")

    def verify(self) -> None:
        found = self.problems().collect()
        if found:
            raise errors.CorruptIndex("; ".join(f"{r['problem']}: {r['rows']}" for r in found))

    def searcher(self, costs):
        from segtide.operators.search import Searcher

        return Searcher(self, costs)
