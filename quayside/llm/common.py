"""What the operators of this subpackage share: shared folders, tables, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators of words and the characters stripped from lines, ``[\x20\x09-\x0D]``.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may leave the setting unset: it then gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what Arrow's pool and the C library hold without need to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library can be asked to shrink
        ctypes.CDLL(None).malloc_trim(0)


_shipped: set[str] = set()


def in_tasks(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow``, with this package sent along once per application so that workers can import it.

    Workers outlive their tasks, so each task ends by giving back memory that the next stage may need.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='run-')}/quayside", "zip", root, "quayside")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


class Kept:
    """An object that a Python worker keeps for the tasks that follow, and gives back when it has been idle.

    ``with kept as x`` makes the object if there is none. Some seconds after its last use it is let go, so an
    idle worker does not hold on to memory that the next stage needs.
    """

    def __init__(self, make: Callable, seconds: float = 2.0):
        self.make, self.seconds, self.held = make, seconds, None
        self.lock, self.timer = threading.Lock(), None

    def __enter__(self):
        if self.timer:
            self.timer.cancel()
        self.lock.acquire()
        if self.held is None:
            self.held = self.make()
        return self.held

    def __exit__(self, *_):
        self.lock.release()
        self.timer = threading.Timer(self.seconds, self._let_go)
        self.timer.daemon = True
        self.timer.start()

    def _let_go(self) -> None:
        if self.lock.acquire(blocking=False):  # in use again otherwise
            self.held = None
            gc.collect()
            give_back()
            self.lock.release()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches one at a time."""
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}
