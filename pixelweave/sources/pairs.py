"""Pairs files: tab-separated read pairs under a header that lists the chromosomes."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.columns import local_bin
from pixelweave.functions.genome import Layout

#: Lines of a header, at most, that the driver reads.
HEADER_LINES = 1_000_000


def spool(spark: SparkSession, stream=None) -> str:
    """Standard input as a file, for path '-': in the folder that all executors share, or a local one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("standard input needs spark.checkpoint.dir, a folder that all executors share")
    path = f"{(shared or tempfile.gettempdir()).rstrip('/')}/stdin-{uuid.uuid4().hex}.pairs"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(to)
    for block in iter(lambda: (stream or sys.stdin.buffer).read(1 << 20), b""):
        out.write(block)
    out.close()
    files.deleteOnExit(to)
    return path


def header_sizes(lines: list[str]) -> list[tuple[str, int]]:
    """Chromosome sizes in header order; the header ends at the first blank or other line."""
    sizes = []
    for line in lines:
        if not line.startswith("#"):
            break
        if line.startswith("#chromsize:"):
            parts = line.removeprefix("#chromsize:").split()
            if len(parts) == 2:
                if not parts[1].isdigit():
                    raise ValueError(f"not a chromosome size: {line!r}")
                sizes.append((parts[0], int(parts[1])))
    return sizes


def head_lines(lines: DataFrame, number: int) -> list[str]:
    """The first lines: of several files, those of the first by name that has any. limit() reads as few partitions as it can."""
    files = sorted(lines.inputFiles())
    for one in files if len(files) > 1 else [None]:
        # partitions are dealt by size, not by name: a condition on the path leaves one file to scan
        rows = lines if one is None else lines.where(F.col("_metadata.file_path").endswith("/" + one.partition(":")[2].lstrip("/")))  # file:/a, file:///a
        if head := [r["value"] for r in rows.limit(number).collect()]:
            return head
    return []


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(value: lines of a file or of a folder's files, chromosome sizes).

    Of several files the first by name has the header; further headers are comments. Gzip is known by suffix and dealt
    out after the scan.
    """
    path = spool(spark) if path == "-" else path
    lines = spark.read.text(path)
    step = 256
    while True:
        head = head_lines(lines, step)
        if len(head) < step or any(not x.startswith("#") for x in head):
            break
        if step >= HEADER_LINES:
            raise ValueError(f"the header has more than {HEADER_LINES} lines")
        step *= 8
    if path.endswith(".gz"):
        lines = lines.repartition(max(2, spark.sparkContext.defaultParallelism))
    return lines, header_sizes(head)


def parse(lines: DataFrame) -> DataFrame:
    """chrom1, pos1, chrom2, pos2 of the data lines; blank, comment and short lines are skipped."""
    parts = F.split("value", "\t")
    return (
        lines.where((F.length("value") > 0) & ~F.col("value").startswith("#"))
        .select(parts.alias("p"))
        .where(F.size("p") >= 5)
        .select(F.col("p")[1].alias("chrom1"), F.col("p")[2].try_cast("long").alias("pos1"), F.col("p")[3].alias("chrom2"), F.col("p")[4].try_cast("long").alias("pos2"))
    )


def binned(pairs: DataFrame, layout: Layout, zero_based: bool = False) -> DataFrame:
    """bin1_id <= bin2_id of each pair.

    An unknown chromosome, a position that is no number or negative, or one past its chromosome's last bin stops the
    job, naming the pair. A position past the length but inside the last bin is accepted.
    """
    rows = [(c, layout.offsets[k], layout.counts[k]) for c, k in layout.index.items()]
    known = pairs.sparkSession.createDataFrame(rows, "c string, first long, number long")

    def side(k: int) -> DataFrame:  # one row per chromosome of the header
        return F.broadcast(known.select(F.col("c").alias(f"chrom{k}"), F.col("first").alias(f"first{k}"), F.col("number").alias(f"number{k}")))

    def bin_of(k: int):
        p, here = F.col(f"pos{k}"), local_bin(F.col(f"pos{k}"), layout.binsize, zero_based)
        said = F.concat_ws(":", F.coalesce(f"chrom{k}", F.lit("?")), F.coalesce(p.cast("string"), F.lit("not a number")))
        what = F.when(F.col(f"first{k}").isNull(), "unknown chromosome: ").when(p.isNull() | (p < 0), "bad position: ").otherwise("position out of range: ")
        fine = F.col(f"first{k}").isNotNull() & (p >= 0) & (here < F.col(f"number{k}"))
        return F.when(fine, F.col(f"first{k}") + here).otherwise(F.raise_error(F.concat(what, said)).cast("long"))

    joined = pairs.join(side(1), "chrom1", "left").join(side(2), "chrom2", "left")
    both = joined.select(bin_of(1).alias("a"), bin_of(2).alias("b"))
    return both.select(F.least("a", "b").alias("bin1_id"), F.greatest("a", "b").alias("bin2_id"))
