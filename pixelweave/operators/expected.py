"""Distance-decay curves by region: sums, valid pairs, averages and their smoothed forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.genome import Layout, Region
from pixelweave.functions.kernels import separations, smoothed
from pixelweave.operators.pixels import small

COLUMNS = ("n_total", "n_valid", "count_sum", "count_avg", "balanced_sum", "balanced_avg", "balanced_avg_smoothed", "balanced_avg_smoothed_agg")
SCHEMA = "region_id int, dist long, " + ", ".join(f"{c} double" for c in COLUMNS)
DEFAULT = "balanced_avg_smoothed_agg"


def region_table(spark: SparkSession, layout: Layout, regions: list[Region]) -> DataFrame:
    rows = [(k, r.name, r.chrom, r.start, r.end, *layout.span(r)) for k, r in enumerate(regions)]
    return spark.createDataFrame(rows, "region_id int, name string, chrom string, start long, end long, first long, stop long")


def region_bins(spark: SparkSession, layout: Layout, regions: list[Region]) -> DataFrame:
    """region_id, bin_id: a bin on a boundary belongs to both regions; to more than two is an error."""
    edges = sorted(x for r in regions for a, b in [layout.span(r)] for x in ((a, 1), (b, -1)) if a < b)
    depth = 0
    for _, step in sorted(edges, key=lambda e: (e[0], e[1])):
        depth += step
        if depth > 2:
            raise ValueError("a bin lies in more than two regions")
    return region_table(spark, layout, regions).where("stop > first").select("region_id", F.explode(F.sequence("first", F.col("stop") - 1)).alias("bin_id"))


def sums(pixels: DataFrame, weights: DataFrame, members: DataFrame, nbins: int, ignore_diags: int) -> DataFrame:
    """region_id, dist, count_sum, balanced_sum over pixels between unmasked bins of one region.

    Bins carry their regions as a short array, so a pixel meets its regions by intersecting two of them.
    """
    regions = members.groupBy("bin_id").agg(F.array_sort(F.collect_set("region_id")).alias("r"))  # at most two
    sides = weights.where("weight is not null").join(regions, "bin_id").select("bin_id", "weight", "r")
    side = lambda k: small(sides.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("weight").alias(f"w{k}"), F.col("r").alias(f"r{k}")), nbins)
    joined = pixels.where(F.col("bin2_id") - F.col("bin1_id") >= ignore_diags).join(side(1), "bin1_id").join(side(2), "bin2_id")
    rows = joined.select(F.explode(F.array_intersect("r1", "r2")).alias("region_id"), (F.col("bin2_id") - F.col("bin1_id")).alias("dist"), "count", (F.col("count") * F.col("w1") * F.col("w2")).alias("b"))
    return rows.groupBy("region_id", "dist").agg(F.sum(F.col("count").cast("long")).cast("double").alias("count_sum"), F.sum("b").alias("balanced_sum"))


def by_region(sums: DataFrame, bins: DataFrame, ignore_diags: int) -> DataFrame:
    """region_id, dist, the columns but the last, and whole_sum: a region's curve in a task of its own.

    bins: region_id, bin_id, good, for all bins of the regions. A region has at most as many rows as bins.
    """

    def curve(found: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        n = len(mine)
        count, balanced = np.zeros(n), np.zeros(n)
        count[found["dist"].to_numpy(int)], balanced[found["dist"].to_numpy(int)] = found["count_sum"].to_numpy(), found["balanced_sum"].to_numpy()
        valid, xs = separations(mine.sort_values("bin_id")["good"].to_numpy(bool)), np.arange(n, dtype=float)
        near = xs < ignore_diags
        with np.errstate(all="ignore"):
            s, v = smoothed(xs, balanced, valid)
            parts = {"n_total": n - xs, "n_valid": valid, "count_sum": np.where(near, np.nan, count), "count_avg": np.where(near, np.nan, count / (n - xs)), "balanced_sum": np.where(near, np.nan, balanced), "balanced_avg": np.where(near | (valid == 0), np.nan, balanced / valid), "balanced_avg_smoothed": np.where(xs == 0, np.nan, s / v)}
        return pd.DataFrame({"region_id": mine["region_id"].iloc[0] if n else 0, "dist": np.arange(n), **parts, "whole_sum": balanced})

    kinds = "region_id int, dist long, " + ", ".join(f"{c} double" for c in (*COLUMNS[:-1], "whole_sum"))
    # regions without sums still have bins: the left side may be empty, the right one never
    return sums.groupBy("region_id").cogroup(bins.groupBy("region_id")).applyInPandas(curve, kinds)


def expected(pixels: DataFrame, weights: DataFrame, layout: Layout, regions: list[Region], ignore_diags: int = 2) -> DataFrame:
    """region_id, dist and COLUMNS; what is not defined is null."""
    spark = pixels.sparkSession
    members = region_bins(spark, layout, regions)
    good = weights.select("bin_id", F.col("weight").isNotNull().alias("good"))
    found = sums(pixels, weights, members, layout.nbins, ignore_diags)
    table = by_region(found, members.join(small(good, layout.nbins), "bin_id"), ignore_diags).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # the aggregate curve: one row by separation, at most as many as a region has bins
        whole = table.groupBy("dist").agg(F.sum("whole_sum").alias("s"), F.sum("n_valid").alias("v")).toPandas().sort_values("dist")
        with np.errstate(all="ignore"):
            s, v = smoothed(whole["dist"].to_numpy(float), whole["s"].to_numpy(float), whole["v"].to_numpy(float))
            value = s / v
        value[:1] = np.nan
        agg = spark.createDataFrame(pa.table({"dist": pa.array(whole["dist"].to_numpy(np.int64)), COLUMNS[-1]: pa.array(value, pa.float64(), mask=~np.isfinite(value))}))
        out = table.join(small(agg, layout.nbins), "dist").select("region_id", "dist", *[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in COLUMNS])
        kept = out.toArrow()  # two rows per bin at most: they outlive the cached table
        return spark.createDataFrame(kept)
    finally:
        table.unpersist()
