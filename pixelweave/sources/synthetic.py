"""Synthetic pairs: cis contacts that fall off with distance, and uniform trans contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.columns import lookup
from pixelweave.functions.genome import Sizes

CIS_SHARE, NEAREST = 0.7, 500


def generate(spark: SparkSession, n: int, sizes: Sizes, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """n pairs; every draw is a hash of the row number and seed, so the rows do not depend on partitioning."""
    u = lambda k: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11).cast("double") / float(1 << 53)
    total, edges, at = sum(x for _, x in sizes), [], 0
    for c, x in sizes:
        at += x
        edges.append((c, at / total))
    lengths = dict(sizes)

    def chrom(draw: Column) -> Column:
        out = F.lit(edges[-1][0])
        for c, edge in reversed(edges[:-1]):
            out = F.when(draw < edge, F.lit(c)).otherwise(out)
        return out

    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rows = rows.withColumn("chrom1", chrom(u(1))).withColumn("cis", u(2) < CIS_SHARE).withColumn("chrom2", F.when(F.col("cis"), F.col("chrom1")).otherwise(chrom(u(3))))
    rows = rows.withColumn("l1", lookup(lengths, F.col("chrom1"), "long")).withColumn("l2", lookup(lengths, F.col("chrom2"), "long"))
    rows = rows.withColumn("pos1", F.least(F.floor(u(4) * F.col("l1")) + 1, F.col("l1")))
    far = F.greatest(F.col("l1").cast("double") / NEAREST, F.lit(1.0))
    distance = F.floor(F.lit(float(NEAREST)) * F.pow(far, u(5)))  # inverse of a distribution in proportion to 1/s
    there = F.col("pos1") + F.when(u(6) < 0.5, distance).otherwise(-distance)
    cis = F.least(F.greatest(there, F.lit(1).cast("long")), F.col("l1"))
    return rows.select("chrom1", F.col("pos1").cast("long").alias("pos1"), "chrom2", F.when(F.col("cis"), cis).otherwise(F.least(F.floor(u(7) * F.col("l2")) + 1, F.col("l2"))).cast("long").alias("pos2"))
