"""What several operators share: the word pattern, checkpoints, and Arrow column helpers."""

from __future__ import annotations

import ctypes
import hashlib
import re
import sys
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Salts that the rows of one key are dealt over in joins; a set of salts is a long.
SALTS = 64
#: Texts that a worker holds as Python objects, with what it computes of them, at a time.
PART = 500
#: Seconds from one call of trim_driver() that does something to the next; a call takes some 20 ms.
TRIM_EVERY = 2.0
_trimmed = -TRIM_EVERY


def salt(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts(column: Column) -> Column:
    """An aggregate: which salts occur, one bit each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), column))


def each_salt(held: Column) -> Column:
    """A row for each salt of salts(). So a side that is joined by key and salt has as many rows of a key as its other side can be split into, and a rare key has one."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(held, i) == 1))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key at most. Rows of left that share a key are dealt over salts of `by`, and right's row goes to each salt that has some, so no key meets in one task."""
    dealt = left.withColumn("_salt", salt(*by))
    need = dealt.select(*keys, "_salt").distinct().join(right, keys)
    return dealt.join(need, [*keys, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may lack it, as in tests; elsewhere a folder of one machine would lose data."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame, forget: bool = False) -> DataFrame:
    """df, computed once and kept in the folder that all executors share. A lost executor costs a reread of these files, not a rerun of what made them.

    So the shuffles that made df are of no more use, and their files are deleted at once.
    The optimizer goes on knowing what holds for the rows and how they are dealt. In a loop of joins what it
    knows of each round multiplies, until planning takes longer than the work: `forget` drops it.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)
    drop_shuffles(df)
    trim_driver(spark)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.logicalPlan().rdd(), kept._jdf.schema(), False), spark) if forget else kept


def drop_shuffles(df: DataFrame) -> None:
    """Delete the shuffle files of df's run, which is over. Spark keeps them until the driver collects its garbage, and a driver with little to do rarely does.

    Shuffles that miss parts are left to Spark: a side that an adaptive plan found needless may still be running. So are those of plans that aren't adaptive.
    """
    plan, sc = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":
        return
    tracker = sc._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    for i in plan.context().shuffleIds():
        missing = tracker.findMissingPartitions(i)
        if missing.isDefined() and missing.get().isEmpty():
            sc._jsc.sc().shuffleDriverComponents().removeShuffle(i, False)


def release(*frames: DataFrame | None) -> None:
    """Delete the files of checkpointed frames that nothing reads any more."""
    for df in frames:
        at = None if df is None else df._jdf.logicalPlan().rdd().getCheckpointFile()
        if at is not None and at.isDefined():
            delete(df.sparkSession, at.get())


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shipped(spark: SparkSession, name: str, data: bytes) -> str:
    """data as a file that every executor copies once to its own Spark folder: SparkFiles.get() of the name returned, which holds a digest of data."""
    name = f"{name}-{hashlib.sha256(data).hexdigest()[:24]}"
    path = f"{shared_folder(spark)}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        stream = fs.create(at, True)
        try:
            for i in range(0, len(data), 1 << 22):
                stream.write(bytearray(data[i : i + (1 << 22)]))
        finally:
            stream.close()
    if not any(x.rsplit("/", 1)[-1] == name for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: for what is read more than once, a few columns at a time."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """A text column's Python strings, PART of them in memory at a time; null is the empty text."""
    for part in parts(column):
        for x in part.to_pylist():
            yield x or ""


def parts(rows: pa.Array | pa.ChunkedArray | pa.RecordBatch) -> Iterator:
    """PART rows at a time, without a copy."""
    for i in range(0, len(rows), PART):
        yield rows.slice(i, PART)


def give_back() -> None:
    """Return to the system what this process has freed. Workers outlive their tasks, and what one stage freed would count beside the next one's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc has it
        trim(0)


def trim_driver(spark: SparkSession) -> None:
    """give_back() in the driver: its Python and its JVM. What the JVM's compiler and codecs free stays with the C library, and over a run of many plans it comes to hundreds of MB beside the heap.

    JVMs without such a command (other systems, before 17.0.9) keep what they have.
    """
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_EVERY:
        return
    give_back()
    sc = spark.sparkContext
    java, gateway = sc._jvm.java.lang, sc._gateway
    call = gateway.new_array(java.Object, 4)  # name, operation, no parameters, no signature
    call[0], call[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:
        pass
    _trimmed = time.monotonic()


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where each run begins when runs of these lengths lie one after the other."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def plain(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
