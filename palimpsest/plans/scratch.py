"""Tables in the folder that the cluster shares, to cut the lineage of plans that loop.

Executors may be lost at any time, so nothing is kept on one executor only: what
is read more than once, or ends a loop's round, is a Parquet table below
``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
folder, and any other an error, as its executors couldn't read one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []

#: Rows of an Arrow batch while a table is written: batches of texts at Spark's default of 10,000 take hundreds of MB besides the heap.
BATCH_ROWS = 2_000
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a few numbers each that may be broadcast, some 16 MB.
FEW = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; nothing is left to delete with
            return


atexit.register(_clean)


class Scratch:
    """Tables of one operator's run. ``put`` writes one, ``drop`` deletes the last of a name early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.count = 0
        _made.append((spark, self.root))

    def put(self, df: DataFrame, name: str = "t", file_rows: int = 0) -> DataFrame:
        """Writes the rows and reads them again; with `file_rows`, at most so many to a file, and packed tighter. The session's batch size is lowered for the write only."""
        self.count += 1
        path = self.paths[name] = f"{self.root}/{name}-{self.count}"
        before = self.spark.conf.get(BATCHES)
        if not 0 < int(before) <= BATCH_ROWS:
            self.spark.conf.set(BATCHES, str(BATCH_ROWS))
        try:
            df.write.options(**({"maxRecordsPerFile": file_rows, "compression": "zstd"} if file_rows else {})).parquet(path)
        finally:
            self.spark.conf.set(BATCHES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, self.paths.pop(name))


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """`df`, to be broadcast if it has been counted and has at most `most` rows; otherwise Spark chooses a join that is sorted and can be split."""
    return F.broadcast(df) if df.count() <= most else df  # partial counts; a limit would send its rows to one task


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any spelling."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name
