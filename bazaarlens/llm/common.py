"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one step inside a task holds at once. A longer single text is a step of its own.
STEP_CHARS = 2_000_000
#: Rows of one Arrow batch where stages share their workers; the JVM and a worker hold two batches at times.
BATCH_ROWS = 2_000

_HELD: dict[str, Callable[[], None]] = {}


def task_of(operator: str, forget: Callable[[], None] | None = None) -> None:
    """A task of `operator` begins in this worker: what other operators remember in it is dropped.

    Spark hands a Python worker on from stage to stage. Words and models serve the next task of the same operator; those of
    all operators of a pipeline would add up. `forget` drops what `operator` itself remembers.
    """
    others = [o for o in _HELD if o != operator]
    for other in others:
        _HELD.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    if forget is not None:
        _HELD[operator] = forget


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, for this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    # zero and less: no limit
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a plain local session (one process) that names none gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        held = spark.sparkContext.getCheckpointDir()
        if held is not None:
            folder = held.rsplit("/", 1)[0]
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The copy survives lost executors, and its size on disk is what the optimizer decides broadcasts by.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def hash_first(df: DataFrame, column: str, rows: int) -> DataFrame:
    """The `rows` rows that come first in the order of a hash of a column: a bounded, repeatable sample.

    Only rows whose hash is small for the size of the table are sorted, some 4 * rows of them, so the
    sort does not grow with the table.
    """
    place = F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(1 << 53))
    total = df.count()
    return df.where(place * total <= 4.0 * rows).orderBy(place, column).limit(rows)


def steps(lengths: np.ndarray, most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to about `most`."""
    start = total = 0
    for at, size in enumerate(lengths.tolist()):
        if total and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(lengths):
        yield start, len(lengths)


def text_steps(
    batches: Iterable[pa.RecordBatch], column: str, most: int = STEP_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, of about `most` characters, with their texts; a null text is empty."""
    for batch in batches:
        sizes = pc.utf8_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in steps(sizes, most):
            rows = batch.slice(a, b - a)
            yield rows, [t or "" for t in rows.column(column).to_pylist()]


def code_points(text: str) -> np.ndarray:
    """One number for each character. Lone surrogates cannot come out of Arrow."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
