"""Queries that go the way of a user: pairs as text, files that are written and read back, the read API; with their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions import genome
from pixelweave.functions.columns import MOST, saturated
from pixelweave.operators import balance as balancing
from pixelweave.operators import pixels as counting
from pixelweave.plans import matrix as m
from pixelweave.plans import oracle as o
from pixelweave.plans import store
from pixelweave.plans.catalog import KEY, MASK, PLACES, matrix, pixels, pixels_once, query, rounded
from pixelweave.plans.fixture import ASSEMBLY, BINSIZE, CENTROMERES, LAYOUT, SIZES, pairs
from pixelweave.plans.store import workspace
from pixelweave.streaming import incremental


def pairs_text(spark: SparkSession, sf_dir: str, path: str, headed: bool = True, least: int = 1) -> str:
    """The fixture's pairs as text: a header, data lines, and lines that a reader must skip; or data lines alone.

    Each task writes the lines that it scans to a file of its own; only where the scan has fewer parts than `least` are
    they dealt out.
    """
    lines = pairs(spark, sf_dir).select(F.concat_ws("\t", F.lit("r"), "chrom1", "pos1", "chrom2", "pos2", F.lit("+"), F.lit("-")).alias("value"))
    if lines.rdd.getNumPartitions() < least:
        lines = lines.repartition(least)
    if headed:
        head = ["## pairs format v1.0", *(f"#chromsize: {c} {n}" for c, n in SIZES), "#columns: readID chrom1 pos1 chrom2 pos2"]
        odd = ["", "# a comment among the data", "short\tchrA\t1"]
        said = lambda rows: spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1)
        lines = said(head).unionAll(lines).unionAll(said(odd))  # files are named in the order of parts
    lines.write.text(path)
    return path


def loaded(spark: SparkSession, sf_dir: str) -> tuple[str, m.ContactMatrix]:
    """The fixture's matrix, by cload from text, in files."""
    at = workspace(spark)
    return at, m.cload(spark, pairs_text(spark, sf_dir, f"{at}/pairs"), BINSIZE, f"{at}/m", assembly=ASSEMBLY)


def values(*rows: tuple) -> str:
    said = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px")
def api_cload_text(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir)[1].pixels().table.select("bin1_id", "bin2_id", "count")


@query(o.with_(o.PIXELS) + f" SELECT CAST({LAYOUT.nbins} AS BIGINT) AS nbins, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(count) AS BIGINT) AS total, '{ASSEMBLY}' AS assembly, CAST({BINSIZE} AS INTEGER) AS bin_size, FALSE AS balanced, CAST(count(*) AS BIGINT) AS stored_nnz FROM px")
def api_info(spark, sf_dir) -> DataFrame:
    at, x = loaded(spark, sf_dir)
    i, meta = x.info, store.read_meta(spark, f"{at}/m/resolutions/{BINSIZE}")
    return spark.createDataFrame([(i["nbins"], i["nnz"], i["sum"], i["assembly"], i["bin_size"], i["balanced"], meta["nnz"])], "nbins long, nnz long, total long, assembly string, bin_size int, balanced boolean, stored_nnz long")


@query(o.with_(o.chroms(), o.bins()) + ' SELECT bin_id, chrom, "start", "end" FROM bins WHERE bin_id >= 150 AND bin_id < 200')
def api_bins_slice(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir)[1].bins()[150:200].select("bin_id", "chrom", "start", "end")


@query(o.with_(o.chroms()) + " SELECT name, CAST(length AS INTEGER) AS length FROM chroms WHERE name = 'chrC'")
def api_chroms_fetch(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir)[1].chroms().fetch("chrC").select("name", "length")


@query(o.with_(o.PIXELS, o.chroms(), o.bins()) + ' SELECT a.chrom AS chrom1, a."start" AS start1, b.chrom AS chrom2, b."start" AS start2, count FROM px JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE bin1_id >= 100 AND bin1_id < 181')
def api_pixels_joined(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir)[1].pixels(join=True).fetch("chrB").select("chrom1", "start1", "chrom2", "start2", "count")


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px WHERE bin1_id >= 110 AND bin1_id < 130")
def api_saved_row_range(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir)[1].pixels().fetch("chrB:100,000-300,000").select("bin1_id", "bin2_id", "count")


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM (SELECT *, row_number() OVER (ORDER BY bin1_id, bin2_id) - 1 AS r FROM px) WHERE r >= 777 AND r < 2345")
def api_saved_positions(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir)[1].pixels()[777:2345].select("bin1_id", "bin2_id", "count")


@query(o.with_(o.PIXELS, o.block((100, 181), (0, 100))) + f" SELECT {KEY} FROM blk")
def api_matrix_fetch(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir)[1].matrix(balance=False).fetch("chrB", "chrA").select("bin1_id", "bin2_id", "count")


@query(o.with_(o.PIXELS) + " SELECT bin1_id, bin2_id, CAST(sum(count) AS INTEGER) AS count FROM (SELECT * FROM px UNION ALL SELECT * FROM px) GROUP BY 1, 2")
def api_merge_files(spark, sf_dir) -> DataFrame:
    at, x = loaded(spark, sf_dir)
    return m.merge(spark, [x, m.ContactMatrix.open(spark, f"{at}/m::resolutions/{BINSIZE}")]).save(f"{at}/two").pixel_rows.select("bin1_id", "bin2_id", "count")


@query(o.with_(o.PIXELS, o.coarse(2, name="c2"), o.coarse(3, name="c3"), o.coarse(4, name="c4")) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({BINSIZE * k} AS INTEGER) AS resolution, {KEY} FROM {t}" for k, t in ((1, "px"), (2, "c2"), (3, "c3"), (4, "c4"))) + ")")
def api_zoomify_files(spark, sf_dir) -> DataFrame:
    at, x = loaded(spark, sf_dir)
    made = m.zoomify(spark, x, f"{at}/z", [4 * BINSIZE, BINSIZE, 3 * BINSIZE, 2 * BINSIZE])
    assert m.resolutions(spark, f"{at}/z") == sorted(made) == [BINSIZE * k for k in (1, 2, 3, 4)]
    out = None
    for r, level in made.items():
        rows = level.pixel_rows.select(F.lit(r).alias("resolution"), "bin1_id", "bin2_id", "count")
        out = rows if out is None else out.unionByName(rows)
    return out


def balanced(spark: SparkSession, sf_dir: str) -> m.ContactMatrix:
    return m.balance(loaded(spark, sf_dir)[1], with_expected=False)


@query(o.with_(o.WEIGHTS) + f" SELECT bin_id, round(weight, {PLACES}) AS weight FROM wt")
def api_balance_files(spark, sf_dir) -> DataFrame:
    return balanced(spark, sf_dir).weights.select("bin_id", rounded("weight"))


@query(o.with_(o.PIXELS, o.mask(), o.corrected(10)) + f" SELECT bin_id, round(b, {PLACES}) AS bias FROM w10")
def ic_10_iterations_by_tiles(spark, sf_dir) -> DataFrame:
    import numpy as np

    rows = pixels_once(spark, sf_dir).where("bin2_id - bin1_id >= 2")
    good = balancing.masked(rows, counting.bin_table(spark, LAYOUT)).column("good").to_numpy()
    times, free = balancing.product(rows, LAYOUT.nbins, few=0)
    weight, said = balancing.correct(times, good, 0.0, 10)
    free()
    bias = np.where(good, weight * np.sqrt(said["scale"]), 0.0)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(bias)], "bin_id long, bias double").select("bin_id", rounded("bias"))


@query(o.with_(o.EXPECTED) + f" SELECT name AS region1, name AS region2, dist, CAST(dist * {BINSIZE} AS BIGINT) AS dist_bp, CASE WHEN dist >= 2 AND n_valid > 0 THEN round(coalesce(balanced_sum, 0) / n_valid, {PLACES}) END AS contact_frequency FROM curve JOIN regions USING (region_id)")
def api_expected_files(spark, sf_dir) -> DataFrame:
    x = m.expected(balanced(spark, sf_dir), "arms", CENTROMERES)
    return x.expected("arms", "balanced.avg").select("region1", "region2", "dist", "dist_bp", rounded("contact_frequency"))


@query("SELECT * FROM (VALUES ('arms'), ('chroms'), ('halves')) AS t(view)")
def api_expected_views(spark, sf_dir) -> DataFrame:
    x = m.expected(m.expected(balanced(spark, sf_dir), "chroms"), "arms", CENTROMERES)
    with tempfile.TemporaryDirectory() as folder:  # a view is a small file that the driver alone reads
        with open(f"{folder}/halves.bed", "w", encoding="utf-8") as f:
            f.write("chrA\t0\t500000\tleft\nchrA\t500000\t1000000\tright\n")
        x = m.expected(x, f"custom:{folder}/halves.bed")
    return spark.createDataFrame([(v,) for v in x.expected_views()], "view string")


@query(o.with_(o.WEIGHTS, o.block((0, 40), (20, 60))) + f", cells AS (SELECT CAST(i AS BIGINT) AS bin1_id, CAST(j AS BIGINT) AS bin2_id FROM generate_series(0, 39) AS a(i), generate_series(20, 59) AS b(j)) SELECT c.bin1_id, c.bin2_id, (a.weight IS NULL OR b.weight IS NULL) AS masked, round(count * a.weight * b.weight, {PLACES}) AS value FROM cells c JOIN wt a ON a.bin_id = c.bin1_id JOIN wt b ON b.bin_id = c.bin2_id LEFT JOIN blk USING (bin1_id, bin2_id) WHERE a.weight IS NULL OR b.weight IS NULL OR count IS NOT NULL")
def api_sparse_balanced(spark, sf_dir) -> DataFrame:
    cells = balanced(spark, sf_dir).sparse("chrA:0-400,000", "chrA:200,000-600,000", balanced=True)
    return cells.select("bin1_id", "bin2_id", F.isnan("value").alias("masked"), F.round(F.when(~F.isnan("value"), F.col("value")), PLACES).alias("value"))


@query(o.with_(o.WEIGHTS) + f" SELECT bin_id, round(weight, {PLACES}) AS weight, CAST(bin_id * 2 AS BIGINT) AS gc FROM wt")
def api_repack_files(spark, sf_dir) -> DataFrame:
    at, x = loaded(spark, sf_dir)
    extra = x.bin_rows.withColumn("gc", F.col("bin_id") * 2)
    m.ContactMatrix(spark, LAYOUT, ASSEMBLY, x.pixel_rows, extra).save(f"{at}/r")
    return m.repack(spark, f"{at}/r", backup=True, preset="blosc:zstd:1", with_expected=False)[BINSIZE].bin_rows.select("bin_id", rounded("weight"), "gc")


@query(o.with_(o.PIXELS) + f" SELECT {KEY} FROM px")
def stream_counts(spark, sf_dir) -> DataFrame:
    at = workspace(spark)
    incremental.count_stream(spark, pairs_text(spark, sf_dir, f"{at}/pairs", headed=False, least=3), LAYOUT, f"{at}/out", f"{at}/state").awaitTermination()
    return incremental.counted(spark, f"{at}/out")


@query(o.with_(o.PIXELS) + f" SELECT CAST(key // {LAYOUT.nbins} AS BIGINT) AS bin1_id, CAST(key % {LAYOUT.nbins} AS BIGINT) AS bin2_id, key FROM (SELECT CAST(bin1_id * {LAYOUT.nbins} + bin2_id AS BIGINT) AS key FROM px)")
def pixel_keys_decoded(spark, sf_dir) -> DataFrame:
    return counting.from_keys(counting.keys(pixels(spark, sf_dir), LAYOUT.nbins), LAYOUT.nbins)


@query(f"{o.with_(o.PIXELS)} SELECT CAST(count(*) AS BIGINT) AS saturated, CAST(count(*) AS BIGINT) AS clamped FROM px WHERE 2 * CAST(count AS BIGINT) * 900000000 > {MOST}")
def saturated_tally(spark, sf_dir) -> DataFrame:
    at = workspace(spark)
    large = pixels_once(spark, sf_dir).withColumn("count", saturated(F.col("count").cast("long") * 900_000_000))
    x = m.ContactMatrix(spark, LAYOUT, ASSEMBLY, large)
    with m.warnings.catch_warnings():
        m.warnings.simplefilter("ignore")
        stored = m.merge(spark, [x, x]).save(f"{at}/m").attributes["saturated"]
    return spark.createDataFrame([(stored, counting.clamped([large, large]))], "saturated long, clamped long")


@query(o.with_(o.PIXELS) + " SELECT CAST(count(*) AS BIGINT) AS pixels, TRUE AS timed FROM px")
def read_probe(spark, sf_dir) -> DataFrame:
    found = loaded(spark, sf_dir)[1].read_probe()
    return spark.createDataFrame([(found["pixels"], found["pixels_per_second"] > 0)], "pixels long, timed boolean")


@query(o.with_(o.PIXELS, o.mask(10, 250, 0)) + " " + MASK)
def bin_mask_driver(spark, sf_dir) -> DataFrame:
    return balancing.good_bins(matrix(spark, sf_dir).pixel_rows, counting.bin_table(spark, LAYOUT), balancing.Settings(min_count=250, mad_max=0)).select("bin_id", "marg", "nnz", "good")


ASSEMBLIES = [("hg38", "", "hg38"), ("GRCh38", "", "hg38"), ("mm10", "", "mm10"), ("", "chr1 248956422", "hg38"), ("", "chr1 195471971", "mm10"), ("nothing known", "", None)]


@query(f"SELECT * FROM (VALUES {values(*ASSEMBLIES)}) AS t(name, first, assembly)")
def assembly_detection(spark, sf_dir) -> DataFrame:
    sizes = lambda x: [(c, int(n)) for c, n in [x.split()]] if x else []
    return spark.createDataFrame([(a, f, genome.detect(a, sizes(f))) for a, f, _ in ASSEMBLIES], "name string, first string, assembly string")


PRESETS = [("gzip", "gzip"), ("gzip4", "gzip"), ("blosc:zstd:1", "zstd"), ("blosc:lz4:5", "lz4_raw"), ("none", "none")]


@query(f"SELECT * FROM (VALUES {values(*PRESETS)}) AS t(preset, codec)")
def preset_codecs(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(p, store.codec(p)) for p, _ in PRESETS], "preset string, codec string")


MEMORY = [("default", None, None, 8, 4.0), ("mem", 2.5, None, 8, 2.5), ("chunks", None, 50_000_000, 8, 16.0), ("least", None, 1000, 8, 0.25)]


@query("SELECT hint, CAST(gb AS DOUBLE) AS gb FROM (VALUES " + values(*[(k, gb) for k, _, _, _, gb in MEMORY]) + ") AS t(hint, gb)")
def memory_hints(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(k, store.memory_gb(a, c, t)) for k, a, c, t, _ in MEMORY], "hint string, gb double")


@query("SELECT CAST(place AS INTEGER) AS place, CAST(resolution AS INTEGER) AS resolution FROM (VALUES " + values(*[(k, BINSIZE * 2**k) for k in range(6)]) + ") AS t(place, resolution) WHERE place = 0 OR " + " + ".join(f"ceil({n} / (resolution / 2.0))" for _, n in SIZES) + f" > {4 * len(SIZES)}")
def resolution_schedule(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame(list(enumerate(genome.schedule(LAYOUT))), "place int, resolution int")


@query("SELECT name, CAST(\"start\" AS BIGINT) AS \"start\", CAST(\"end\" AS BIGINT) AS \"end\", CAST(first AS BIGINT) AS first, CAST(stop AS BIGINT) AS stop FROM (VALUES ('left', 0, 455000, 0, 46), ('chrB:10000-20000', 10000, 20000, 101, 102)) AS t(name, \"start\", \"end\", first, stop)")
def regions_bed(spark, sf_dir) -> DataFrame:
    found = genome.parse_bed(["# comment", "track x", "chrA\t0\t455000\tleft", "", "chrB 10000 20000"], SIZES)
    return spark.createDataFrame([(r.name, r.start, r.end, *LAYOUT.span(r)) for r in found], "name string, start long, end long, first long, stop long")


@query("SELECT 'arms' AS view, CAST(48 AS BIGINT) AS regions, CAST(123400000 AS BIGINT) AS first_end")
def default_view(spark, sf_dir) -> DataFrame:
    sizes = [(f"chr{k}", 248_956_422 if k == "1" else 200_000_000) for k in [*map(str, range(1, 23)), "X", "Y"]]
    name, found = genome.resolve_view("hg38", sizes)
    return spark.createDataFrame([(name, len(found), found[0].end)], "view string, regions long, first_end long")


def refused(what) -> bool:
    try:
        what()
    except ValueError:
        return True
    return False


REFUSALS = {
    "unknown chromosome": lambda: genome.parse_region("chrZ", dict(SIZES)),
    "past the end": lambda: genome.parse_region("chrD:0-250,001", dict(SIZES)),
    "overlapping bed": lambda: genome.parse_bed(["chrA 0 10", "chrA 5 20"], SIZES),
    "contradicting assembly": lambda: genome.verify_assembly("mm10", [("chr1", 248_956_422)]),
    "no assembly": lambda: genome.resolve_assembly(None, "unknown", SIZES),
    "bad preset": lambda: store.codec("snappy9"),
    "both memory hints": lambda: store.memory_gb(1.0, 10),
    "not a multiple": lambda: genome.schedule(LAYOUT, [15_000]),
}


@query(f"SELECT * FROM (VALUES {values(*[(k,) for k in REFUSALS])}) AS t(refused)")
def refusals(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(k,) for k, what in REFUSALS.items() if refused(what)], "refused string")
