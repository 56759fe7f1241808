"""Blocks of the symmetric matrix as long tables (i, j, value), absent cells left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.pixels import small

Span = tuple[int, int]


def raw(pixels: DataFrame, rows: Span, columns: Span) -> DataFrame:
    """bin1_id, bin2_id, count for every stored cell of the block, and for the mirror of the lower triangle.

    Ranges are plain comparisons, so they reach the Parquet scan and skip what lies outside.
    """
    (a0, a1), (b0, b1) = rows, columns
    inside = lambda i, j: (F.col(i) >= a0) & (F.col(i) < a1) & (F.col(j) >= b0) & (F.col(j) < b1)
    upper = pixels.where(inside("bin1_id", "bin2_id")).select("bin1_id", "bin2_id", "count")
    lower = pixels.where(inside("bin2_id", "bin1_id") & (F.col("bin1_id") != F.col("bin2_id"))).select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "count")
    return upper.unionByName(lower)


def balanced(cells: DataFrame, bins: DataFrame, nbins: int) -> DataFrame:
    """bin1_id, bin2_id, count, value = count x both weights; null where a bin is masked."""
    side = lambda k: small(bins.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("weight").alias(f"w{k}")), nbins)
    return cells.join(side(1), "bin1_id").join(side(2), "bin2_id").select("bin1_id", "bin2_id", "count", (F.col("count") * F.col("w1") * F.col("w2")).alias("value"))


def over_expected(cells: DataFrame, curve: DataFrame) -> DataFrame:
    """Balanced cells over the curve (dist, expected) at their separation; null beyond it or where it is 0."""
    d = F.abs(F.col("bin2_id") - F.col("bin1_id"))
    joined = cells.withColumn("dist", d).join(curve.select("dist", "expected"), "dist", "left")
    return joined.select("bin1_id", "bin2_id", "value", F.try_divide("value", "expected").alias("ooe"))
