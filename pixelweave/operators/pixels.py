"""Counting pairs into pixels, merging, coarsening, marginals and indexes.

Each is one aggregation with partial sums before its shuffle. Keys are bin pairs, which spread well; tables with one
row per bin are joined by broadcast only up to BROADCAST_BINS, and by a shuffle beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.functions.columns import MOST, coarse, saturated
from pixelweave.functions.genome import Layout

#: A table of this many bins takes some 100 MB as a broadcast.
BROADCAST_BINS = 4_000_000
#: Chromosomes up to which an expression names them all.
FEW_CHROMOSOMES = 40


def small(table: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast a table whose number of rows is known to be small enough."""
    return F.broadcast(table) if rows <= BROADCAST_BINS else table


def chrom_table(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.createDataFrame([(k, c, n) for k, (c, n) in enumerate(layout.sizes)], "chrom_id int, name string, length int")


def layout_table(spark: SparkSession, layout: Layout, coarser: Layout | None = None) -> DataFrame:
    """One row per chromosome: its id, name, length, first bin, bins, and its first bin in a coarser layout."""
    rows = [(k, c, n, layout.offsets[k], layout.counts[k], (coarser or layout).offsets[k]) for k, (c, n) in enumerate(layout.sizes)]
    return spark.createDataFrame(rows, "chrom_id int, chrom string, length int, first long, number long, coarse_first long")


def bin_table(spark: SparkSession, layout: Layout) -> DataFrame:
    """bin_id, chrom_id, chrom, start, end of every bin."""
    rows = layout_table(spark, layout).where("number > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)))
    start = F.col("k") * layout.binsize
    return rows.select((F.col("first") + F.col("k")).alias("bin_id"), "chrom_id", "chrom", start.cast("int").alias("start"), F.least(start + layout.binsize, F.col("length").cast("long")).cast("int").alias("end"))


def count_pairs(bins: DataFrame) -> DataFrame:
    """(bin1_id, bin2_id) of pairs -> pixels."""
    return bins.groupBy("bin1_id", "bin2_id").agg(saturated(F.count("*")).alias("count"))


def merge(tables: list[DataFrame]) -> DataFrame:
    """Sums of counts over tables with one layout."""
    rows = reduce(DataFrame.unionByName, [t.select("bin1_id", "bin2_id", "count") for t in tables])
    return rows.groupBy("bin1_id", "bin2_id").agg(saturated(F.sum(F.col("count").cast("long"))).alias("count"))


def keys(pixels: DataFrame, nbins: int) -> DataFrame:
    """bin1_id, bin2_id as one number, in the order of pixels."""
    return pixels.select((F.col("bin1_id") * nbins + F.col("bin2_id")).alias("key"))


def from_keys(rows: DataFrame, nbins: int) -> DataFrame:
    """bin1_id, bin2_id, key of keys."""
    return rows.select(F.expr(f"key div {nbins}").cast("long").alias("bin1_id"), F.expr(f"key % {nbins}").cast("long").alias("bin2_id"), "key")


def clamped(tables: list[DataFrame]) -> int:
    """How many merged pixels exceed the largest count."""
    rows = reduce(DataFrame.unionByName, [t.select("bin1_id", "bin2_id", "count") for t in tables])
    return rows.groupBy("bin1_id", "bin2_id").agg(F.sum(F.col("count").cast("long")).alias("n")).where(F.col("n") > MOST).count()


def coarse_bins(spark: SparkSession, layout: Layout, factor: int) -> DataFrame:
    """bin_id, coarse_id of every bin."""
    coarser = Layout(layout.sizes, layout.binsize * factor)
    rows = layout_table(spark, layout, coarser).where("number > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)))
    return rows.select((F.col("first") + F.col("k")).alias("bin_id"), coarse(F.col("first") + F.col("k"), F.col("first"), F.col("coarse_first"), factor).alias("coarse_id"))


def coarsen(pixels: DataFrame, layout: Layout, factor: int) -> DataFrame:
    """Sums of counts over factor x factor cells; no cell passes the end of a chromosome.

    Of few chromosomes, a bin's is found by comparing with their first bins; of many, by joining the bins.
    """
    if factor < 1:
        raise ValueError("the factor must be at least 1")
    if sum(map(bool, layout.counts)) <= FEW_CHROMOSOMES:
        coarser = Layout(layout.sizes, layout.binsize * factor)

        def to(b: str) -> Column:
            out = F.lit(None)
            for first, n, to_first in zip(layout.offsets, layout.counts, coarser.offsets):
                if n:
                    here = coarse(F.col(b), F.lit(first), F.lit(to_first), factor)
                    out = F.when(F.col(b) >= first, here).otherwise(out) if first else here
            return out

        mapped = pixels.select(to("bin1_id").alias("bin1_id"), to("bin2_id").alias("bin2_id"), "count")
    else:
        bins = coarse_bins(pixels.sparkSession, layout, factor)
        side = lambda k: small(bins.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("coarse_id").alias(f"to{k}")), layout.nbins)
        mapped = pixels.join(side(1), "bin1_id").join(side(2), "bin2_id").select(F.col("to1").alias("bin1_id"), F.col("to2").alias("bin2_id"), "count")
    return mapped.groupBy("bin1_id", "bin2_id").agg(saturated(F.sum(F.col("count").cast("long"))).alias("count"))


def marginals(pixels: DataFrame, ignore_diags: int = 0) -> DataFrame:
    """bin_id, marg, nnz: counts and pixels that touch each bin, the diagonal once, near diagonals left out.

    Both ends come from one scan: each pixel is expanded in place into its one or two bins.
    """
    kept = pixels.where(F.col("bin2_id") - F.col("bin1_id") >= ignore_diags)
    ends = F.when(F.col("bin1_id") == F.col("bin2_id"), F.array("bin1_id")).otherwise(F.array("bin1_id", "bin2_id"))
    return kept.select(F.explode(ends).alias("bin_id"), F.col("count").cast("long").alias("c")).groupBy("bin_id").agg(F.sum("c").alias("marg"), F.count("*").alias("nnz"))


def bin1_offsets(pixels: DataFrame, layout: Layout) -> DataFrame:
    """bin_id 0..nbins with the number of pixels whose bin1 lies before it, by prefix sums in two levels.

    Bins are summed within blocks, blocks among themselves, so no task holds all bins.
    """
    spark, block = pixels.sparkSession, 1 << 16
    counts = pixels.groupBy(F.col("bin1_id").alias("bin_id")).agg(F.count("*").alias("n"))
    every = spark.range(0, layout.nbins + 1).withColumnRenamed("id", "bin_id").join(counts, "bin_id", "left").select("bin_id", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("bin_id") / block).alias("k"))
    blocks = every.groupBy("k").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    before = Window.partitionBy("one").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # nbins / block rows
    heads = blocks.select("k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("k").orderBy("bin_id").rowsBetween(Window.unboundedPreceding, -1)
    return every.join(heads, "k").select("bin_id", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).cast("long").alias("bin1_offset"))


def with_coordinates(pixels: DataFrame, bins: DataFrame, nbins: int) -> DataFrame:
    """chrom1, start1, end1, chrom2, start2, end2, count."""
    side = lambda k: small(bins.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("chrom").alias(f"chrom{k}"), F.col("start").alias(f"start{k}"), F.col("end").alias(f"end{k}")), nbins)
    joined = pixels.join(side(1), "bin1_id").join(side(2), "bin2_id")
    return joined.select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "count")
