"""Matrices as folders of Parquet tables, one folder per resolution, written beside their place and moved there."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.columns import MOST
from pixelweave.functions.genome import Layout

FORMAT, VERSION = "pixelweave", 1
META = "format string, version int, bin_type string, bin_size int, storage_mode string, nbins long, nchroms int, nnz long, assembly string, generated_by string, attributes string"


def codec(preset: str) -> str:
    """gzip, gzip0-gzip9, blosc:zstd:N, blosc:lz4:N or none -> Parquet's codec."""
    if re.fullmatch(r"gzip[0-9]?", preset):
        return "gzip"
    if found := re.fullmatch(r"blosc:(zstd|lz4)(:[0-9]+)?", preset):
        return {"zstd": "zstd", "lz4": "lz4_raw"}[found[1]]
    if preset == "none":
        return "none"
    raise ValueError(f"unknown compression preset {preset!r}: use gzip[0-9], blosc:zstd:N, blosc:lz4:N or none")


def memory_gb(mem: float | None = None, chunksize: int | None = None, threads: int = 8) -> float:
    """The memory hint of the command line: --mem, or --chunksize times threads times 40 bytes, but never both."""
    if mem is not None and chunksize is not None:
        raise ValueError("mem and chunksize exclude one another")
    return max(chunksize * threads * 40e-9, 0.25) if chunksize is not None else 4.0 if mem is None else mem


def workspace(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where the master is local and none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/pixelweave-api/{uuid.uuid4().hex}"


class Files:
    """The few file operations needed, on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"could not move {a} to {b}")

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []


def replaced(spark: SparkSession, path: str, write: Callable[[str], None], backup: bool = False) -> None:
    """Write beside path, then put it in place; what was there is kept until then, and a failure leaves it alone.

    backup keeps it as path.bak, instead of an earlier backup; else earlier backups are not touched.
    """
    files, path = Files(spark, path), path.rstrip("/")
    beside, aside = f"{path}._tmp-{uuid.uuid4().hex}", f"{path}._old-{uuid.uuid4().hex}"
    try:
        write(beside)
    except BaseException:
        files.delete(beside)
        raise
    had = files.exists(path)
    if had:
        files.rename(path, aside)
    try:
        files.rename(beside, path)
    except BaseException:
        if had:
            files.rename(aside, path)
        files.delete(beside)
        raise
    if had and backup:
        files.delete(f"{path}.bak")
        files.rename(aside, f"{path}.bak")
    elif had:
        files.delete(aside)


def sorted_pixels(pixels: DataFrame) -> DataFrame:
    """Files hold ranges of bin1_id in order, so that a row range skips most row groups."""
    rows = pixels.select(F.col("bin1_id").cast("long"), F.col("bin2_id").cast("long"), F.col("count").cast("int"))
    return rows.repartitionByRange("bin1_id", "bin2_id").sortWithinPartitions("bin1_id", "bin2_id")


def write_level(path: str, layout: Layout, assembly: str, pixels: DataFrame, bins: DataFrame, attributes: dict, preset: str = "gzip4") -> None:
    spark, how = pixels.sparkSession, codec(preset)
    sorted_pixels(pixels).write.option("compression", how).parquet(f"{path}/pixels")
    bins.repartitionByRange("bin_id").sortWithinPartitions("bin_id").write.option("compression", how).parquet(f"{path}/bins")
    rows = [(k, c, n) for k, (c, n) in enumerate(layout.sizes)]
    spark.createDataFrame(rows, "chrom_id int, name string, length int").coalesce(1).write.parquet(f"{path}/chroms")
    written = spark.read.parquet(f"{path}/pixels")
    nnz = written.count()
    # pixels at the largest count, by statistics of the files where there are none
    full = written.where(F.col("count") == MOST).count()
    if full:
        warnings.warn(f"{full} pixels reached the largest count, {MOST}, and were cut there", stacklevel=2)
    write_meta(spark, path, layout, assembly, nnz, attributes | {"saturated": full})


def write_meta(spark: SparkSession, path: str, layout: Layout, assembly: str, nnz: int, attributes: dict) -> None:
    row = (FORMAT, VERSION, "fixed", layout.binsize, "symmetric-upper", layout.nbins, len(layout.sizes), nnz, assembly, "pixelweave", json.dumps(attributes, sort_keys=True))
    spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """The meta row; other layouts than fixed bins with the upper triangle stored are refused."""
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["storage_mode"] != "symmetric-upper":
        raise ValueError(f"storage mode {meta['storage_mode']!r} is not supported")
    if meta["bin_type"] != "fixed":
        raise ValueError(f"bin type {meta['bin_type']!r} is not supported")
    return meta | {"attributes": json.loads(meta["attributes"])}


def check_counts(pixels: DataFrame) -> None:
    kind = dict(pixels.dtypes)["count"]
    if kind not in ("int", "bigint", "smallint", "tinyint"):
        raise ValueError(f"counts of type {kind} are not supported")


def write_view(path: str, view: str, regions: DataFrame, expected: DataFrame) -> None:
    """Replace one view's expected table and regions; other views remain."""
    for name, table in (("views", regions), ("expected", expected)):
        table.withColumn("view", F.lit(view)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("view").parquet(f"{path}/{name}")
