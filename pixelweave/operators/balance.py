"""Balancing: coverage masks and iterative correction.

One aggregation gives each bin's coverage; masks are medians over one row per bin, which the driver holds anyway: the
correction keeps one number per bin there, which is what balancing needs at any depth of sequencing. Pixels stay
distributed; they are cached once, dealt by tiles of TILE x TILE bins, and each round ships the vector out and sums
partial products of tiles back as binary stripes. Matrices of few pixels are multiplied on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.kernels import symmetric_product
from pixelweave.operators.pixels import marginals

#: Pixels up to which the product is computed on the driver (16 bytes each).
FEW_PIXELS = 2_000_000
#: Bins of a tile's side, and entries of a partial product that are summed under one key.
TILE = 1 << 16


@dataclass(frozen=True)
class Settings:
    ignore_diags: int = 2
    mad_max: float = 5.0
    min_nnz: int = 10
    min_count: int = 0
    tol: float = 1e-4
    max_iters: int = 200


def coverage(pixels: DataFrame, bins: DataFrame, ignore_diags: int) -> DataFrame:
    """bin_id, chrom_id, marg, nnz for every bin."""
    found = bins.select("bin_id", "chrom_id").join(marginals(pixels, ignore_diags), "bin_id", "left")
    return found.select("bin_id", "chrom_id", F.coalesce("marg", F.lit(0)).alias("marg"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def judged(chrom: np.ndarray, marg: np.ndarray, nnz: np.ndarray, how: Settings) -> np.ndarray:
    """Which bins are good, from the coverage of all."""
    good = nnz >= how.min_nnz
    if how.min_count > 0:
        good &= marg >= how.min_count
    if how.mad_max <= 0:
        return good
    scaled = marg.astype(float)
    for c in np.unique(chrom):
        mine = chrom == c
        some = marg[mine & (marg > 0)]
        scaled[mine] /= np.median(some) if len(some) else 1.0
    logs = np.log(scaled[scaled > 0])
    if len(logs):  # without any positive bin, nothing is rejected
        centre = np.median(logs)
        good &= ~(scaled < np.exp(centre - how.mad_max * np.median(np.abs(logs - centre))))
    return good


def masked(pixels: DataFrame, bins: DataFrame, how: Settings = Settings()) -> pa.Table:
    """bin_id, chrom_id, marg, nnz, good for every bin, in order, on the driver."""
    t = coverage(pixels, bins, how.ignore_diags).toArrow().sort_by("bin_id")
    chrom, marg, nnz = (t.column(c).to_numpy() for c in ("chrom_id", "marg", "nnz"))
    return t.append_column("good", pa.array(judged(chrom, marg, nnz, how)))


def good_bins(pixels: DataFrame, bins: DataFrame, how: Settings = Settings()) -> DataFrame:
    """bin_id, chrom_id, marg, nnz, good for every bin."""
    return pixels.sparkSession.createDataFrame(masked(pixels, bins, how))


def product(pixels: DataFrame, n: int, few: int = FEW_PIXELS) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[], None]]:
    """v -> A v, and a call that frees what it keeps."""
    spark = pixels.sparkSession
    slim = pixels.select("bin1_id", "bin2_id", F.col("count").cast("double").alias("count"))
    tile = lambda c: F.floor(F.col(c) / TILE)
    dealt = slim.repartition(tile("bin1_id"), tile("bin2_id")).sortWithinPartitions("bin1_id", "bin2_id") if n > TILE else slim
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    if dealt.count() <= few:
        t = dealt.toArrow()
        dealt.unpersist()
        i, j, c = (t.column(k).to_numpy() for k in ("bin1_id", "bin2_id", "count"))
        return (lambda v: symmetric_product(i, j, c, v)), (lambda: None)

    def times(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, parts = shared.value, {}
            add = lambda at, x: np.add(parts.setdefault(at, np.zeros(TILE)), x, out=parts[at])
            for b in batches:
                i, j, c = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                off = np.where(i != j, c, 0.0)
                for at, to, value in ((i, j, c), (j, i, off)):
                    product = value * v[to]
                    tiles = at // TILE
                    for t in np.unique(tiles).tolist():  # rows are dealt by tiles: one or two
                        mine = tiles == t
                        add(t, np.bincount(at[mine] - t * TILE, product[mine], TILE))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([y.tobytes() for y in parts.values()], pa.binary())], names=["k", "y"])

        def total(t: pa.Table) -> pa.Table:
            y = np.zeros(TILE)
            for x in t.column("y").to_pylist():
                y += np.frombuffer(x)
            return pa.table({"k": t.column("k")[:1], "y": pa.array([y.tobytes()], pa.binary())})

        # stripes are summed where they meet; one number per bin reaches the driver
        sums = dealt.mapInArrow(run, "k long, y binary").groupBy("k").applyInArrow(total, "k long, y binary").collect()
        out = np.zeros(-(-n // TILE) * TILE)
        for r in sums:
            out[r["k"] * TILE : (r["k"] + 1) * TILE] = np.frombuffer(r["y"])
        shared.unpersist()
        return out[:n]

    return times, dealt.unpersist


def correct(times: Callable[[np.ndarray], np.ndarray], good: np.ndarray, tol: float = 1e-4, max_iters: int = 200) -> tuple[np.ndarray, dict]:
    """Weights (NaN where masked) and scale, var, converged, iterations."""
    bias = good.astype(float)
    mean, cv, converged, rounds = 1.0, 0.0, False, 0
    while rounds < max_iters and not converged:
        marg = bias * times(bias)
        some = marg != 0
        if not some.any():
            break
        rounds += 1
        mean = float(marg[some].mean())
        cv = float(marg[some].std() / mean)
        bias[some] /= marg[some] / mean
        converged = cv < tol
    return np.where(good, bias / np.sqrt(mean), np.nan), {"scale": mean, "var": cv * cv, "converged": converged, "iterations": rounds}


def balance(pixels: DataFrame, bins: DataFrame, how: Settings = Settings(), few: int = FEW_PIXELS) -> tuple[DataFrame, dict]:
    """(bin_id, weight) with null for masked bins, and the attributes of the result."""
    spark = pixels.sparkSession
    kept = pixels.where(F.col("bin2_id") - F.col("bin1_id") >= how.ignore_diags).select("bin1_id", "bin2_id", "count").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mask = masked(kept, bins, how)
        good = mask.column("good").to_numpy()
        times, free = product(kept, len(good), few)
        try:
            weight, said = correct(times, good, how.tol, how.max_iters)
        finally:
            free()
    finally:
        kept.unpersist()
    table = pa.table({"bin_id": mask.column("bin_id"), "weight": pa.array(weight, mask=np.isnan(weight))})
    attributes = said | {"ignore_diags": how.ignore_diags, "mad_max": how.mad_max, "min_nnz": how.min_nnz, "min_count": how.min_count, "tol": how.tol, "cis_only": False, "divisive_weights": False}
    return spark.createDataFrame(table), attributes
