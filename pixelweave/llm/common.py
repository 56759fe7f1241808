"""What the operators of this subpackage share: shared-folder tables, ordering and worker-side caches."""

from __future__ import annotations

import contextlib
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as the contracts define words: everything between these.
WORD = r"[^\x20\x09-\x0D]+"


def ship_by_value() -> None:
    """Let functions of this subpackage travel inside the plan, so that executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules["pixelweave.llm"])


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker process, across tasks, until another owner asks for one.

    Workers are used by one operator after another; what the last one remembered goes when the next one begins, and the
    memory behind it is given back to the system.
    """
    name = "_pixelweave_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    held = sys.modules[name].__dict__
    if held.get("owner") != owner:
        fresh = "owner" not in held
        held["owner"], held["entries"] = owner, {}
        if not fresh:
            give_back()
    return held["entries"]


def give_back() -> None:
    """Return freed memory of this process to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system: nothing to do
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, as a task's function that gives its memory back at its end: workers live on, one stage after another."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pixelweave-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    rows: how many Python code gets at a time meanwhile; the session's own number holds again afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelweave/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, rows):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Within this, Python code gets so many rows at a time; texts may be long, so they are few."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if rows:
            spark.conf.set(name, before)


def finished(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files behind them.

    What was made from them must have been written by itself. Spark frees the files of a shuffle once the driver has
    collected the plan that made it, which otherwise may take until long after the job.
    """
    spark = tables[0].sparkSession
    jvm = spark._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(column: str | Column) -> Column:
    """crc32 of an id's decimal text (a null id counts as the empty text)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def unit_hash(*columns: Column) -> Column:
    """A repeatable number in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def ranked(df: DataFrame, order: list[Column], name: str, index: str) -> DataFrame:
    """df with index = 0, 1, ... in the given order, without gathering all rows in one task.

    Rows are dealt by range, numbered within each range, and shifted by the number of rows in the ranges
    before; only one count per range reaches the driver.
    """
    spark = df.sparkSession
    dealt = written(df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), name)
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    offsets = F.array(*[F.lit(x).cast("long") for x in before or [0]])
    return dealt.withColumn(index, local.cast("long") + F.element_at(offsets, F.col("_range") + 1)).drop("_range")
