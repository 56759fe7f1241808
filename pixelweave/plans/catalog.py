"""Queries over the contact-matrix operators, on pairs made from lineitem, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.columns import saturated
from pixelweave.functions.genome import Layout, Region, arms, whole_chromosomes
from pixelweave.operators import balance as balancing
from pixelweave.operators import blocks, expected as curves
from pixelweave.operators import pixels as counting
from pixelweave.plans import oracle as o
from pixelweave.plans.fixture import ASSEMBLY, BINSIZE, CENTROMERES, LAYOUT, SIZES, pairs
from pixelweave.plans.matrix import ContactMatrix, numbered
from pixelweave.plans.store import workspace
from pixelweave.sources.pairs import binned

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
#: Decimals that are compared: sums of doubles differ in the last bits by their order.
PLACES = 8


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_pairs(binned(pairs(spark, sf_dir), LAYOUT))


def pixels_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels in files, for queries with several jobs or conditions on bins: pairs are binned and counted once."""
    at = f"{workspace(spark)}/pixels"
    pixels(spark, sf_dir).write.parquet(at)
    return spark.read.parquet(at)


def matrix(spark: SparkSession, sf_dir: str) -> ContactMatrix:
    return ContactMatrix(spark, LAYOUT, ASSEMBLY, pixels_once(spark, sf_dir))


def weights(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return balancing.balance(rows, counting.bin_table(spark, LAYOUT))[0]


def rounded(name: str) -> F.Column:
    return F.round(name, PLACES).alias(name)


ARMS, CHROMS = arms(SIZES, CENTROMERES), whole_chromosomes(SIZES)
KEY = "bin1_id, bin2_id, count"
LONG = "CAST({0} AS BIGINT) AS {0}"


@query(o.with_(o.PAIRS, o.ENDS) + " SELECT CAST(least(a, b) AS BIGINT) AS bin1_id, CAST(greatest(a, b) AS BIGINT) AS bin2_id FROM ends")
def bin_pairs(spark, sf_dir):
    return binned(pairs(spark, sf_dir), LAYOUT)


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px")
def cload_pixels(spark, sf_dir):
    return pixels(spark, sf_dir)


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px")
def cload_pixels_zero_based(spark, sf_dir):
    shifted = pairs(spark, sf_dir).select("chrom1", (F.col("pos1") - 1).alias("pos1"), "chrom2", (F.col("pos2") - 1).alias("pos2"))
    return counting.count_pairs(binned(shifted, LAYOUT, zero_based=True))


@query(o.with_(o.PIXELS) + " SELECT CAST(count(*) AS BIGINT) AS nnz, CAST(sum(count) AS BIGINT) AS total, CAST(max(count) AS BIGINT) AS largest FROM px")
def cload_total(spark, sf_dir):
    return pixels(spark, sf_dir).agg(F.count("*").alias("nnz"), F.sum(F.col("count").cast("long")).alias("total"), F.max(F.col("count").cast("long")).alias("largest"))


@query(o.with_(o.PIXELS) + f" SELECT CAST({LAYOUT.nbins} AS BIGINT) AS nbins, CAST({len(SIZES)} AS BIGINT) AS nchroms, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(count) AS BIGINT) AS sum, CAST({BINSIZE} AS BIGINT) AS bin_size FROM px")
def info(spark, sf_dir):
    rows = pixels(spark, sf_dir).agg(F.count("*").alias("nnz"), F.sum(F.col("count").cast("long")).alias("sum"))
    return rows.select(F.lit(LAYOUT.nbins).cast("long").alias("nbins"), F.lit(len(SIZES)).cast("long").alias("nchroms"), "nnz", "sum", F.lit(BINSIZE).cast("long").alias("bin_size"))


@query(o.with_(o.chroms()) + " SELECT CAST(chrom_id AS INTEGER) AS chrom_id, name, CAST(length AS INTEGER) AS length FROM chroms")
def chrom_table(spark, sf_dir):
    return counting.chrom_table(spark, LAYOUT)


@query(o.with_(o.chroms(), o.bins()) + ' SELECT bin_id, chrom_id, chrom, "start", "end" FROM bins')
def bin_table(spark, sf_dir):
    return counting.bin_table(spark, LAYOUT)


@query(o.with_(o.PIXELS, f"ids AS (SELECT CAST(b AS BIGINT) AS bin_id FROM generate_series(0, {LAYOUT.nbins}) AS g(b))") + " SELECT bin_id, CAST((SELECT count(*) FROM px WHERE bin1_id < bin_id) AS BIGINT) AS bin1_offset FROM ids")
def bin1_offset(spark, sf_dir):
    return counting.bin1_offsets(pixels(spark, sf_dir), LAYOUT)


@query(o.with_(o.chroms()) + " SELECT CAST(chrom_id AS INTEGER) AS chrom_id, CAST(coalesce(sum(number) OVER (ORDER BY chrom_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chrom_offset FROM chroms")
def chrom_offset(spark, sf_dir):
    return counting.layout_table(spark, LAYOUT).select("chrom_id", F.col("first").alias("chrom_offset"))


@query(o.with_(o.PIXELS) + " SELECT bin1_id, bin2_id, CAST(sum(count) AS INTEGER) AS count FROM (SELECT * FROM px UNION ALL SELECT * FROM px) GROUP BY 1, 2")
def merge_self_doubles(spark, sf_dir):
    rows = pixels(spark, sf_dir)
    return counting.merge([rows, rows])


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px")
def merge_halves(spark, sf_dir):
    both = pairs(spark, sf_dir)
    half = F.pmod(F.xxhash64("pos1", "pos2"), F.lit(2)) == 0
    return counting.merge([counting.count_pairs(binned(both.where(x), LAYOUT)) for x in (half, ~half)])


@query(o.with_(o.PIXELS) + " SELECT bin1_id, bin2_id, CAST(least(2 * CAST(count AS BIGINT) * 1000000000, 2147483647) AS INTEGER) AS count FROM px")
def merge_saturates(spark, sf_dir):
    large = pixels(spark, sf_dir).withColumn("count", saturated(F.col("count").cast("long") * 1_000_000_000))
    return counting.merge([large, large])


@query(o.with_(o.PIXELS, o.coarse(2)) + f" SELECT {KEY} FROM cx")
def coarsen_2x(spark, sf_dir):
    return counting.coarsen(pixels(spark, sf_dir), LAYOUT, 2)


@query(o.with_(o.PIXELS, o.coarse(3)) + f" SELECT {KEY} FROM cx")
def coarsen_3x(spark, sf_dir):
    return counting.coarsen(pixels(spark, sf_dir), LAYOUT, 3)


@query(o.with_(o.PIXELS, o.coarse(4)) + f" SELECT {KEY} FROM cx")
def coarsen_4x(spark, sf_dir):
    return counting.coarsen(counting.coarsen(pixels(spark, sf_dir), LAYOUT, 2), Layout(SIZES, 2 * BINSIZE), 2)


@query(o.with_(o.PIXELS, o.coarse(2, name="c2"), o.coarse(3, name="c3"), o.coarse(4, name="c4")) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({BINSIZE * k} AS INTEGER) AS resolution, {KEY} FROM {t}" for k, t in ((1, "px"), (2, "c2"), (3, "c3"), (4, "c4"))) + ")")
def zoomify_pyramid(spark, sf_dir):
    base = pixels(spark, sf_dir)
    twice = counting.coarsen(base, LAYOUT, 2)
    levels = {1: base, 2: twice, 3: counting.coarsen(base, LAYOUT, 3), 4: counting.coarsen(twice, Layout(SIZES, 2 * BINSIZE), 2)}
    out = None
    for k, rows in levels.items():
        rows = rows.select(F.lit(BINSIZE * k).alias("resolution"), "bin1_id", "bin2_id", "count")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(o.with_(o.PIXELS, o.chroms(), o.bins()) + ' SELECT a.chrom AS chrom1, a."start" AS start1, a."end" AS end1, b.chrom AS chrom2, b."start" AS start2, b."end" AS end2, count FROM px JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id')
def pixels_join_coords(spark, sf_dir):
    return counting.with_coordinates(pixels(spark, sf_dir), counting.bin_table(spark, LAYOUT), LAYOUT.nbins)


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px WHERE bin1_id >= 110 AND bin1_id < 130")
def pixels_fetch_row_block(spark, sf_dir):
    return matrix(spark, sf_dir).pixels().fetch("chrB:100,000-300,000")


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px WHERE bin1_id >= 0 AND bin1_id < 100 AND bin2_id >= 100 AND bin2_id < 181")
def pixels_fetch_two_regions(spark, sf_dir):
    return matrix(spark, sf_dir).pixels().fetch("chrA", "chrB")


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM (SELECT *, row_number() OVER (ORDER BY bin1_id, bin2_id) - 1 AS r FROM px) WHERE r >= 1000 AND r < 1500")
def pixels_range(spark, sf_dir):
    return matrix(spark, sf_dir).pixels()[1000:1500]


@query(o.with_(o.PIXELS) + f" SELECT {KEY}, CAST(row_number() OVER (ORDER BY bin1_id, bin2_id) - 1 AS BIGINT) AS position FROM px")
def pixels_numbered(spark, sf_dir):
    return numbered(pixels_once(spark, sf_dir), ["bin1_id", "bin2_id"])


@query(o.with_(o.PIXELS) + " SELECT bin1_id, bin2_id, CAST(bin1_id * 267 + bin2_id AS BIGINT) AS key FROM px")
def pixel_keys(spark, sf_dir):
    return pixels(spark, sf_dir).select("bin1_id", "bin2_id", (F.col("bin1_id") * LAYOUT.nbins + F.col("bin2_id")).alias("key"))


@query(o.with_(o.PIXELS, o.block((10, 60), (10, 60))) + f" SELECT {KEY} FROM blk")
def matrix_raw_cis(spark, sf_dir):
    return matrix(spark, sf_dir).raw("chrA:100,000-600,000")


@query(o.with_(o.PIXELS, o.block((100, 181), (0, 100))) + f" SELECT {KEY} FROM blk")
def matrix_raw_trans(spark, sf_dir):
    return matrix(spark, sf_dir).raw("chrB", "chrA")


@query(o.with_(o.PIXELS, o.block((0, 60), (30, 100))) + f" SELECT {KEY} FROM blk")
def matrix_raw_overlap(spark, sf_dir):
    return matrix(spark, sf_dir).raw()[0:60, 30:100]


@query(o.with_(o.PIXELS, o.ends_of("px", 0), o.MARG) + " SELECT bin_id, marg FROM marg")
def marginal_raw(spark, sf_dir):
    return counting.marginals(pixels(spark, sf_dir)).select("bin_id", "marg")


@query(o.with_(o.PIXELS, o.ends_of("px", 2), o.MARG) + " SELECT bin_id, nnz FROM marg")
def marginal_nnz(spark, sf_dir):
    return counting.marginals(pixels(spark, sf_dir), 2).select("bin_id", "nnz")


def masked(spark, sf_dir, **how) -> DataFrame:
    found = balancing.good_bins(pixels(spark, sf_dir), counting.bin_table(spark, LAYOUT), balancing.Settings(**how))
    return found.select("bin_id", "marg", "nnz", "good")


MASK = "SELECT bin_id, CAST(marg AS BIGINT) AS marg, CAST(nnz AS BIGINT) AS nnz, good FROM mask"


@query(o.with_(o.PIXELS, o.mask(40, 0, 0)) + " " + MASK)
def bin_mask_nnz(spark, sf_dir):
    return masked(spark, sf_dir, min_nnz=40, mad_max=0)


@query(o.with_(o.PIXELS, o.mask(10, 250, 0)) + " " + MASK)
def bin_mask_min_count(spark, sf_dir):
    return masked(spark, sf_dir, min_count=250, mad_max=0)


@query(o.with_(o.PIXELS, o.mask()) + " " + MASK)
def bin_mask_mad(spark, sf_dir):
    return masked(spark, sf_dir)


@query(o.with_(o.PIXELS, o.chroms(), o.bins(), o.ends_of("px", 2), o.MARG) + " SELECT b.bin_id, CAST(coalesce(marg, 0) AS DOUBLE) AS y FROM bins b LEFT JOIN marg USING (bin_id)")
def spmv_ones(spark, sf_dir):
    far = pixels(spark, sf_dir).where("bin2_id - bin1_id >= 2")
    times, free = balancing.product(far, LAYOUT.nbins, few=0)
    y = times(np.ones(LAYOUT.nbins))
    free()
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "bin_id long, y double")


@query(o.with_(o.PIXELS, o.mask(), o.corrected(10)) + f" SELECT bin_id, round(b, {PLACES}) AS bias FROM w10")
def ic_10_iterations(spark, sf_dir):
    rows = pixels_once(spark, sf_dir).where("bin2_id - bin1_id >= 2")
    good = balancing.masked(rows, counting.bin_table(spark, LAYOUT)).column("good").to_numpy()
    times, free = balancing.product(rows, LAYOUT.nbins)
    weight, said = balancing.correct(times, good, 0.0, 10)
    free()
    bias = np.where(good, weight * np.sqrt(said["scale"]), 0.0)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(bias)], "bin_id long, bias double").select("bin_id", rounded("bias"))


@query(o.with_(o.WEIGHTS) + f" SELECT bin_id, round(weight, {PLACES}) AS weight FROM wt")
def balance_weights(spark, sf_dir):
    return weights(spark, pixels(spark, sf_dir)).select("bin_id", rounded("weight"))


@query(o.with_(o.WEIGHTS, o.block((0, 100), (0, 100))) + f" SELECT bin1_id, bin2_id, count, round(count * a.weight * b.weight, {PLACES}) AS value FROM blk JOIN wt a ON a.bin_id = bin1_id JOIN wt b ON b.bin_id = bin2_id")
def matrix_balanced(spark, sf_dir):
    rows = pixels_once(spark, sf_dir)
    cells = blocks.balanced(blocks.raw(rows, (0, 100), (0, 100)), weights(spark, rows), LAYOUT.nbins)
    return cells.select("bin1_id", "bin2_id", "count", rounded("value"))


def region_rows(kind: str) -> str:
    return o.with_(o.regions(kind)) + ' SELECT CAST(region_id AS INTEGER) AS region_id, name, chrom, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", CAST(first AS BIGINT) AS first, CAST(stop AS BIGINT) AS stop FROM regions'


@query(region_rows("arms"))
def regions_arms(spark, sf_dir):
    return curves.region_table(spark, LAYOUT, ARMS)


@query(region_rows("chroms"))
def regions_chroms(spark, sf_dir):
    return curves.region_table(spark, LAYOUT, CHROMS)


@query(o.with_(o.regions(), o.MEMBERS) + " SELECT CAST(region_id AS INTEGER) AS region_id, bin_id FROM members")
def region_bin_map(spark, sf_dir):
    return curves.region_bins(spark, LAYOUT, ARMS)


@query(o.with_(o.EXPECTED) + f" SELECT CAST(region_id AS INTEGER) AS region_id, CAST(dist AS BIGINT) AS dist, count_sum, round(balanced_sum, {PLACES}) AS balanced_sum FROM sums")
def expected_sums(spark, sf_dir):
    rows = pixels_once(spark, sf_dir)
    found = curves.sums(rows, weights(spark, rows), curves.region_bins(spark, LAYOUT, ARMS), LAYOUT.nbins, 2)
    return found.select("region_id", "dist", "count_sum", rounded("balanced_sum"))


def table(spark, sf_dir, regions: list[Region] = ARMS) -> DataFrame:
    rows = pixels_once(spark, sf_dir)
    return curves.expected(rows, weights(spark, rows), LAYOUT, regions)


@query(o.with_(o.EXPECTED) + " SELECT CAST(region_id AS INTEGER) AS region_id, dist, CAST(len - dist AS DOUBLE) AS n_total, CAST(n_valid AS DOUBLE) AS n_valid FROM curve")
def expected_n_valid(spark, sf_dir):
    return table(spark, sf_dir).select("region_id", "dist", "n_total", "n_valid")


@query(o.with_(o.EXPECTED) + f" SELECT CAST(region_id AS INTEGER) AS region_id, dist, CASE WHEN dist >= 2 THEN round(coalesce(count_sum, 0) / (len - dist), {PLACES}) END AS count_avg, CASE WHEN dist >= 2 AND n_valid > 0 THEN round(coalesce(balanced_sum, 0) / n_valid, {PLACES}) END AS balanced_avg FROM curve")
def expected_avgs(spark, sf_dir):
    return table(spark, sf_dir).select("region_id", "dist", rounded("count_avg"), rounded("balanced_avg"))


AGG = "SELECT 0 AS g, dist AS x, sum(coalesce(balanced_sum, 0)) AS s, CAST(sum(n_valid) AS DOUBLE) AS v FROM curve GROUP BY dist"


@query(o.with_(o.EXPECTED, o.smoothing(AGG)).replace("WITH ", "WITH RECURSIVE ", 1) + f" SELECT CAST(region_id AS INTEGER) AS region_id, dist, CASE WHEN smooth.v > 0 THEN round(smooth.s / smooth.v, {PLACES}) END AS agg FROM curve LEFT JOIN smooth ON smooth.x = dist")
def expected_agg(spark, sf_dir):
    return table(spark, sf_dir).select("region_id", "dist", F.round("balanced_avg_smoothed_agg", PLACES).alias("agg"))


BY_REGION = "SELECT region_id AS g, dist AS x, coalesce(balanced_sum, 0) AS s, CAST(n_valid AS DOUBLE) AS v FROM curve"


@query(o.with_(o.EXPECTED.replace(o.regions(), o.regions("chroms")), o.smoothing(BY_REGION)).replace("WITH ", "WITH RECURSIVE ", 1) + f" SELECT CAST(region_id AS INTEGER) AS region_id, dist, CASE WHEN smooth.v > 0 THEN round(smooth.s / smooth.v, {PLACES}) END AS smoothed FROM curve LEFT JOIN smooth ON smooth.g = region_id AND smooth.x = dist")
def expected_smoothed(spark, sf_dir):
    return table(spark, sf_dir, CHROMS).select("region_id", "dist", F.round("balanced_avg_smoothed", PLACES).alias("smoothed"))


@query(o.with_(o.EXPECTED.replace(o.regions(), o.regions("chroms")), o.block((100, 180), (100, 180))) + f" SELECT bin1_id, bin2_id, round(count * a.weight * b.weight, {PLACES}) AS value, CASE WHEN abs(bin2_id - bin1_id) >= 2 AND c.balanced_sum > 0 THEN round(count * a.weight * b.weight / (c.balanced_sum / n_valid), {PLACES}) END AS ooe FROM blk JOIN wt a ON a.bin_id = bin1_id JOIN wt b ON b.bin_id = bin2_id LEFT JOIN curve c ON c.region_id = 1 AND c.dist = abs(bin2_id - bin1_id)")
def ooe_region(spark, sf_dir):
    m = matrix(spark, sf_dir)
    m = ContactMatrix(spark, LAYOUT, ASSEMBLY, m.pixel_rows, m.bin_rows.join(weights(spark, m.pixel_rows), "bin_id", "left"))
    m._curves["chroms"] = curves.expected(m.pixel_rows, m.weights, LAYOUT, CHROMS), CHROMS
    return m.ooe("chrB", column="balanced_avg").select("bin1_id", "bin2_id", rounded("value"), rounded("ooe"))


@query(o.with_(o.chroms(), o.bins()) + ' SELECT bin_id, chrom, "start", "end", CAST(bin_id * 2 AS BIGINT) AS gc FROM bins')
def repack_extra_bin_column(spark, sf_dir):
    from pixelweave.plans.matrix import repack

    folder = workspace(spark)
    extra = counting.bin_table(spark, LAYOUT).withColumn("gc", F.col("bin_id") * 2).withColumn("weight", F.lit(1.0))
    ContactMatrix(spark, LAYOUT, ASSEMBLY, pixels(spark, sf_dir), extra).save(folder + "/m")
    return repack(spark, folder + "/m", with_expected=False)[BINSIZE].bin_rows.select("bin_id", "chrom", "start", "end", "gc")
