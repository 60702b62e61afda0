"""Session defaults and scratch tables that outlive the loss of an executor.

Iterative operators cut their lineage by writing a Parquet table to the shared
folder named by ``spark.checkpoint.dir``.  Only a session whose executors are
threads of this process may go without that setting; it gets a temporary folder.
"""

from __future__ import annotations

import atexit
import importlib.util
import operator
import re
import shutil
import tempfile
import uuid
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table, in bytes of Parquet, that an operator may broadcast by itself.
BROADCAST_BYTES = 64 << 20
#: Largest number of rows that an operator may broadcast by itself.
BROADCAST_ROWS = 400_000
#: Bytes that a value takes in a broadcast row: of a fixed width, or of a type that has no bound of its own.
FIXED_BYTES, LOOSE_BYTES = 16, 256

UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"
#: Whether Spark removes the shuffle files of a query as soon as it has run.
FREED_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: After how many rows, least and most, a Parquet writer looks at the size of its pages and row groups.
PAGE_CHECKS = ("parquet.page.size.row.check.min", "parquet.page.size.row.check.max")
#: Parquet writers of this version store of a text what differs from the text before.
WRITER_VERSION = "parquet.writer.version"
#: Bytes of a page, and its setting.  A page begins with a whole text; with texts longer than a page, each would be stored whole.
PAGE_SIZE, PAGE_BYTES = "parquet.page.size", 64 << 20

_local_root: str | None = None


def session(app: str = "newsloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings this engine is tuned for; every one can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    spark = sound(SparkSession.builder.appName(app).master(master).config(map=settings).getOrCreate())
    if not known_to_workers(spark):
        ship_package(spark)
    return spark


def known_to_workers(spark: SparkSession) -> bool:
    """Whether the Python workers can import this package; they are processes of their own, also on one machine."""
    name = __name__.partition(".")[0]
    return spark.sparkContext.parallelize([name], 1).map(importlib.util.find_spec).map(operator.truth).first()


def sound(spark: SparkSession) -> SparkSession:
    """The session with a rewriting of Spark 4.1 turned off that gives wrong results.

    It takes a union of inputs that are partitioned alike for partitioned itself,
    also where adaptive execution has merged the partitions of one input only;
    rows of one key are then aggregated apart.
    """
    if spark.conf.get(UNION_PARTITIONING, "true") != "false":
        spark.conf.set(UNION_PARTITIONING, "false")
    return spark


def large_rows(spark: SparkSession) -> SparkSession:
    """The session with Parquet writers that look at their size at every row, unless it says otherwise.

    By default they do so after 100 to 10 000 rows, guessed from the rows before:
    where rows of a MB follow on small ones, they buffer more than a GB.
    """
    for name in PAGE_CHECKS:
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, "1")
    return spark


def growing_texts(spark: SparkSession, columns: list[str]) -> SparkSession:
    """The session with Parquet writers that store texts by what differs from the row before, unless it says otherwise.

    ``columns`` hold long texts that each begin with the one before.  They get no
    dictionary: with one, a page ends by the length of its texts, not by what is
    stored of them.  Nor is their least and largest text, too long to be stored, looked for.
    Spark 4.1's vectorized reader reads such pages wrongly if they aren't compressed
    (other readers don't): a session that compresses nothing is left as it is.
    """
    if spark.conf.get("spark.sql.parquet.compression.codec").lower() in ("uncompressed", "none"):
        return spark
    for name, value in ((WRITER_VERSION, "v2"), (PAGE_SIZE, str(PAGE_BYTES)), *((f"parquet.{what}#{c}", "false") for c in columns for what in ("enable.dictionary", "column.statistics.enabled"))):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def threads_only(spark: SparkSession) -> bool:
    """Whether the executors are threads of this process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python workers import it by name."""
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="newsloom-package-")  # of the driver, which serves the archive as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/newsloom", "zip", root.parent, root.name))


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``; a folder of this machine only if the executors are threads of this process."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not threads_only(spark):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {spark.sparkContext.master} share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


class Scratch:
    """Tables written by one run of an operator.

    ``keep`` writes a DataFrame and reads it back, so that lineage ends at files
    on shared storage.  Shuffle files of that run go at once: by default they stay
    until the driver happens to collect its garbage.  ``drop`` removes a table that
    no later step reads.
    With ``merge`` no table is broadcast, nor what is derived from one table: Spark
    takes a table to be as large as its compressed file, and one of numbers needs
    many times that in the driver.  Joins with it sort and merge instead.
    What remains is removed by ``close`` - at the end of a ``with`` block, once
    results are written -, by ``release`` for all that is open, and at the latest
    when the process ends.
    """

    open: ClassVar[set[Scratch]] = set()

    def __init__(self, spark: SparkSession, label: str, merge: bool = False):
        self.spark = sound(spark)
        self.merge = merge
        self.root = f"{shared_folder(spark)}/newsloom-{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        Scratch.open.add(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        before = self.spark.conf.get(FREED_SHUFFLES)
        self.spark.conf.set(FREED_SHUFFLES, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(FREED_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out = out.hint("merge") if self.merge else out
        out._scratch_path = path  # noqa: SLF001 - a frame knows its own table; ids of objects are used again
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._delete(path)

    def bytes_of(self, df: DataFrame) -> int:
        """Size on disk of a kept table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # noqa: SLF001
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()  # noqa: SLF001

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001

    def close(self) -> None:
        Scratch.open.discard(self)
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session may already be gone
            path = self.root.removeprefix("file://").removeprefix("file:")
            if path.startswith("/"):
                shutil.rmtree(path, ignore_errors=True)


@atexit.register
def release() -> None:
    """Removes the tables of all operators that have run; for long sessions, once their results are written."""
    for s in list(Scratch.open):
        s.close()


def row_bytes(df: DataFrame) -> int:
    """Bytes a row of ``df`` is taken to need in a broadcast."""
    loose = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return sum(LOOSE_BYTES if isinstance(f.dataType, loose) else FIXED_BYTES for f in df.schema.fields)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows, and the bytes they are taken to need, are within the bounds."""
    return F.broadcast(df) if rows <= limit and rows * row_bytes(df) <= BROADCAST_BYTES else df
