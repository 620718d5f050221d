"""The folder that driver and executors share, for tables that outlive a plan."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from segtide.operators.index import SegmentIndex


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset in local mode, as in tests, one is made that goes with the driver."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="segtide-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        sc.setCheckpointDir(path)
    return path


def _state_path(spark: SparkSession, table: str, name: str) -> str:
    """A folder in the shared one for each state of the table's files."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(table)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(source))
    return f"{shared_dir(spark)}/segtide-{name}-{hashlib.sha256(chr(10).join(files).encode()).hexdigest()[:24]}"


def saved_index(spark: SparkSession, table: str, make: Callable[[DataFrame], "SegmentIndex"], name: str) -> "SegmentIndex":
    """The index that ``make`` builds of a Parquet table, saved in the shared folder once for each state of the table's files, and opened."""
    from segtide.operators.index import SegmentIndex

    path = _state_path(spark, table, f"index-{name}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        make(spark.read.parquet(table)).save(path)
    return SegmentIndex.open(spark, path)


def table_index(spark: SparkSession, table: str, make: Callable[[DataFrame], "SegmentIndex"], name: str) -> "SegmentIndex":
    """The index that ``make`` builds of a Parquet table, as views of it; only the vocabulary is saved, once for each state of the table's files.

    Planning, and declining, needs no more than the vocabulary, and a search is one pass over the table.
    """
    return make(spark.read.parquet(table)).with_vocabulary_at(_state_path(spark, table, f"vocabulary-{name}"))
