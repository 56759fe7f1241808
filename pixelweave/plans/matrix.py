"""Contact matrices: reading and writing, the pipeline operations, and the read API."""

from __future__ import annotations

import time
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.functions.columns import lookup
from pixelweave.functions.genome import Layout, Region, parse_region, resolve_assembly, resolve_view, schedule, verify_assembly
from pixelweave.operators import balance as balancing
from pixelweave.operators import blocks, pixels as counting
from pixelweave.operators import expected as curves
from pixelweave.plans import store
from pixelweave.sources import pairs as reading


class Selector:
    """Rows of a table by position, name or region."""

    def __init__(self, matrix: ContactMatrix, table: DataFrame, order: Sequence[str], kind: str):
        self.matrix, self.table, self.order, self.kind = matrix, table, list(order), kind

    @property
    def columns(self) -> list[str]:
        return self.table.columns

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def __len__(self) -> int:
        return self.table.count()

    def keys(self) -> list[str]:
        return self.columns

    def __getitem__(self, key) -> DataFrame:
        """[:], [a:b], [i], ['column'] or [['columns']]; slices are clamped as Python's are."""
        if isinstance(key, str):
            return self.table.orderBy(*self.order).select(key)
        if isinstance(key, list):
            return self.table.orderBy(*self.order).select(*key)
        if isinstance(key, int):
            key = slice(key, key + 1) if key != -1 else slice(-1, None)
        if key == slice(None):
            return self.table.orderBy(*self.order)
        if self.kind == "bins" and (key.step or 1) == 1:  # numbered already: a range filter that prunes
            a, b, _ = key.indices(self.matrix.layout.nbins)
            return self.table.where((F.col("bin_id") >= a) & (F.col("bin_id") < b)).orderBy("bin_id")
        a, b, step = key.indices(len(self))
        if step != 1:
            raise ValueError("only steps of 1 are supported")
        if self.kind == "pixels" and a < b:
            return self.matrix.pixel_range(a, b)
        return self.table.orderBy(*self.order).offset(a).limit(max(0, b - a))

    def fetch(self, region, region2=None) -> DataFrame:
        """Chromosomes by name, bins in a region, or pixels whose bin1 lies in it (and bin2 in the second)."""
        if self.kind == "chroms":
            return self.table.where(F.col("name") == region)
        a, b = self.matrix.extent(region)
        if self.kind == "bins":
            return self.table.where((F.col("bin_id") >= a) & (F.col("bin_id") < b)).orderBy("bin_id")
        rows = self.matrix.pixel_rows.where((F.col("bin1_id") >= a) & (F.col("bin1_id") < b))
        if region2 is not None:
            if self.kind == "joined":
                raise ValueError("a second region needs join=False")
            c, d = self.matrix.extent(region2)
            rows = rows.where((F.col("bin2_id") >= c) & (F.col("bin2_id") < d))
        return self.matrix.joined(rows) if self.kind == "joined" else rows.orderBy("bin1_id", "bin2_id")


class Blocks:
    """matrix.raw(), .balanced() without a region, and matrix(): blocks by fetch() or [a:b, c:d]."""

    def __init__(self, matrix: ContactMatrix, balanced: bool):
        self.matrix, self.balanced = matrix, balanced

    def fetch(self, region, region2=None) -> DataFrame:
        return self.matrix._block(self.matrix.extent(region), self.matrix.extent(region2 if region2 is not None else region), self.balanced)

    def __getitem__(self, key) -> DataFrame:
        a, b = key if isinstance(key, tuple) else (key, key)
        span = lambda s: s.indices(self.matrix.layout.nbins)[:2] if isinstance(s, slice) else (s, s + 1)
        return self.matrix._block(span(a), span(b), self.balanced)


class ContactMatrix:
    """A matrix at one resolution. Tables are lazy DataFrames; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, layout: Layout, assembly: str, pixels: DataFrame, bins: DataFrame | None = None, attributes: dict | None = None, path: str | None = None):
        store.check_counts(pixels)
        self.spark, self.layout, self.assembly, self.path = spark, layout, assembly, path
        self.pixel_rows, self.attributes = pixels, attributes or {}
        self.bin_rows = bins if bins is not None else counting.bin_table(spark, layout)
        self._curves: dict[str, tuple[DataFrame, list[Region]]] = {}

    # reading and writing

    @classmethod
    def open(cls, spark: SparkSession, path: str, resolution: int | None = None) -> ContactMatrix:
        """path, or path::resolutions/R; the only resolution if none is named."""
        path, _, group = path.partition("::")
        path = path.rstrip("/")
        if group:
            resolution = int(group.strip("/").rpartition("/")[2])
        have = resolutions(spark, path)
        if resolution is None:
            if len(have) != 1:
                raise ValueError(f"name one of the resolutions {have}")
            resolution = have[0]
        if resolution not in have:
            raise ValueError(f"no resolution {resolution} (have: {have})")
        level = f"{path}/resolutions/{resolution}"
        meta = store.read_meta(spark, level)
        sizes = [(r["name"], r["length"]) for r in spark.read.parquet(f"{level}/chroms").orderBy("chrom_id").collect()]
        out = cls(spark, Layout(sizes, meta["bin_size"]), meta["assembly"], spark.read.parquet(f"{level}/pixels"), spark.read.parquet(f"{level}/bins"), meta["attributes"], path)
        for view in store.Files(spark, level).names(f"{level}/views"):
            if view.startswith("view="):
                name = view.removeprefix("view=")
                rows = spark.read.parquet(f"{level}/views/{view}").orderBy("region_id").collect()
                out._curves[name] = spark.read.parquet(f"{level}/expected/{view}"), [Region(r["name"], r["chrom"], r["start"], r["end"]) for r in rows]
        return out

    def save(self, path: str, preset: str = "gzip4") -> ContactMatrix:
        return save_levels(self.spark, path, [self], preset)[self.layout.binsize]

    def __enter__(self) -> ContactMatrix:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is kept open: tables are lazy and not cached."""

    def create_views(self, prefix: str = "") -> None:
        """Temporary views for SQL: chroms, bins, pixels."""
        for name, table in (("chroms", self.chroms().table), ("bins", self.bin_rows), ("pixels", self.pixel_rows)):
            table.createOrReplaceTempView(prefix + name)

    # tables

    @property
    def binsize(self) -> int:
        return self.layout.binsize

    @property
    def chromsizes(self) -> dict[str, int]:
        return dict(self.layout.sizes)

    @property
    def chromnames(self) -> list[str]:
        return [c for c, _ in self.layout.sizes]

    @property
    def shape(self) -> tuple[int, int]:
        return self.layout.nbins, self.layout.nbins

    @property
    def is_balanced(self) -> bool:
        return "weight" in self.bin_rows.columns

    @property
    def info(self) -> dict:
        t = self.pixel_rows.agg(F.count("*").alias("nnz"), F.coalesce(F.sum(F.col("count").cast("long")), F.lit(0)).alias("sum")).first()
        return {"nbins": self.layout.nbins, "nchroms": len(self.layout.sizes), "nnz": t["nnz"], "sum": t["sum"], "bin_size": self.binsize, "assembly": self.assembly, "balanced": self.is_balanced}

    def pixel_range(self, a: int, b: int) -> DataFrame:
        """Pixels a..b-1 in order. The index tells which bin1 they have, so that only these are read and sorted."""
        at = counting.bin1_offsets(self.pixel_rows, self.layout)
        ends = at.agg(F.max(F.when(F.col("bin1_offset") <= a, F.struct("bin_id", "bin1_offset"))).alias("lo"), F.min(F.when(F.col("bin1_offset") >= b, F.col("bin_id"))).alias("hi")).first()
        rows = self.pixel_rows.where((F.col("bin1_id") >= ends["lo"]["bin_id"]) & (F.col("bin1_id") < (ends["hi"] if ends["hi"] is not None else self.layout.nbins)))
        return rows.orderBy("bin1_id", "bin2_id").offset(a - ends["lo"]["bin1_offset"]).limit(b - a)

    def read_probe(self) -> dict:
        """Reads all pixels once and tells how many they are, and at what rate."""
        began = time.perf_counter()
        t = self.pixel_rows.agg(F.count("*").alias("n"), F.sum(F.hash("bin1_id", "bin2_id", "count").cast("long")).alias("h")).first()
        took = max(time.perf_counter() - began, 1e-9)
        return {"pixels": t["n"], "seconds": took, "pixels_per_second": t["n"] / took}

    def to_pandas(self, rows: DataFrame):
        """rows on the driver, chromosomes as ordered categories in the matrix's order."""
        import pandas as pd

        out = rows.toPandas()
        for c in ("chrom", "chrom1", "chrom2", "name"):
            if c in out and (c != "name" or set(out[c]) <= set(self.chromnames)):
                out[c] = pd.Categorical(out[c], categories=self.chromnames, ordered=True)
        return out

    def chroms(self) -> Selector:
        return Selector(self, counting.chrom_table(self.spark, self.layout), ["chrom_id"], "chroms")

    def bins(self) -> Selector:
        return Selector(self, self.bin_rows, ["bin_id"], "bins")

    def pixels(self, join: bool = False) -> Selector:
        if join:
            place = lambda c: lookup(self.layout.index, F.col(c), "int")
            return Selector(self, self.joined(self.pixel_rows), [place("chrom1"), "start1", place("chrom2"), "start2"], "joined")
        return Selector(self, self.pixel_rows, ["bin1_id", "bin2_id"], "pixels")

    def joined(self, rows: DataFrame) -> DataFrame:
        return counting.with_coordinates(rows, self.bin_rows, self.layout.nbins)

    @property
    def weights(self) -> DataFrame:
        if not self.is_balanced:
            raise ValueError("the matrix has no weights; balance it first")
        return self.bin_rows.select("bin_id", "weight")

    def extent(self, region) -> tuple[int, int]:
        if isinstance(region, Region):
            return self.layout.span(region)
        return self.layout.span(parse_region(region, self.layout.lengths))

    def offset(self, region) -> int:
        return self.extent(region)[0]

    # blocks

    def _block(self, rows, columns, balanced: bool) -> DataFrame:
        if balanced:
            weights = self.weights
        cells = blocks.raw(self.pixel_rows, rows, columns)
        return blocks.balanced(cells, weights, self.layout.nbins) if balanced else cells

    def raw(self, region=None, region2=None):
        return Blocks(self, False) if region is None else Blocks(self, False).fetch(region, region2)

    def balanced(self, region=None, region2=None):
        return Blocks(self, True) if region is None else Blocks(self, True).fetch(region, region2)

    balance = balanced

    def sparse(self, region, region2=None, balanced: bool = False) -> DataFrame:
        """bin1_id, bin2_id, value of a block; with balanced, each cell of a masked bin is listed as NaN."""
        rows, columns = self.extent(region), self.extent(region2 if region2 is not None else region)
        if not balanced:
            return self._block(rows, columns, False).select("bin1_id", "bin2_id", F.col("count").cast("double").alias("value"))
        cells = self._block(rows, columns, True).where("value is not null").select("bin1_id", "bin2_id", "value")
        masked = self.weights.where("weight is null")
        every = lambda span: F.explode(F.sequence(F.lit(span[0]).cast("long"), F.lit(span[1] - 1).cast("long")))
        if rows[0] >= rows[1] or columns[0] >= columns[1]:
            return cells
        inside = lambda span: masked.where((F.col("bin_id") >= span[0]) & (F.col("bin_id") < span[1]))
        across = inside(rows).select(F.col("bin_id").alias("bin1_id"), every(columns).alias("bin2_id"))
        down = inside(columns).select(every(rows).alias("bin1_id"), F.col("bin_id").alias("bin2_id"))
        return cells.unionByName(across.unionAll(down).distinct().withColumn("value", F.lit(float("nan"))))

    def matrix(self, balance: bool = False) -> Blocks:
        return Blocks(self, balance)

    def dense(self, region, region2=None, balanced: bool = False):
        """A block as a numpy array (absent cells 0, masked rows and columns NaN); its size must fit the driver."""
        import numpy as np

        (a0, a1), (b0, b1) = self.extent(region), self.extent(region2 if region2 is not None else region)
        cells = self._block((a0, a1), (b0, b1), balanced).toPandas()
        out = np.zeros((a1 - a0, b1 - b0))
        out[cells["bin1_id"].to_numpy() - a0, cells["bin2_id"].to_numpy() - b0] = cells["value" if balanced else "count"].to_numpy(float)
        if balanced:
            w = self.weights.where(F.col("weight").isNull()).where(((F.col("bin_id") >= a0) & (F.col("bin_id") < a1)) | ((F.col("bin_id") >= b0) & (F.col("bin_id") < b1))).toPandas()["bin_id"].to_numpy()
            out[w[(w >= a0) & (w < a1)] - a0, :] = np.nan
            out[:, w[(w >= b0) & (w < b1)] - b0] = np.nan
        return out

    # expected

    def expected_views(self) -> list[str]:
        return sorted(self._curves)

    def _view(self, view: str | None) -> str:
        have = self.expected_views()
        if not have:
            raise ValueError("no expected curves are stored")
        if view is None:
            if len(have) != 1:
                raise ValueError(f"name one of the views {have}")
            view = have[0]
        if view not in have:
            raise ValueError(f"no expected view {view!r} (have: {have})")
        return view

    def expected(self, view: str | None = None, column: str | None = None) -> DataFrame:
        """region1, region2, dist, dist_bp, contact_frequency and the stored columns, by region name and separation."""
        view, column = self._view(view), column or curves.DEFAULT
        table, regions = self._curves[view]
        column = column.replace(".", "_")
        if column not in curves.COLUMNS:
            raise ValueError(f"no column {column!r} (have: {curves.COLUMNS})")
        names = F.element_at(F.array(*[F.lit(r.name) for r in regions]), F.col("region_id") + 1)
        rest = ["n_total", "n_valid", "count_sum", "balanced_sum", "count_avg", "balanced_avg", "balanced_avg_smoothed", "balanced_avg_smoothed_agg"]
        return table.select(names.alias("region1"), names.alias("region2"), "dist", (F.col("dist") * self.binsize).alias("dist_bp"), F.col(column).alias("contact_frequency"), *rest).orderBy("region1", "dist")

    def ooe(self, region, region2=None, view: str | None = None, column: str | None = None) -> DataFrame:
        """bin1_id, bin2_id, value, ooe of a block inside one region of a view."""
        view, column = self._view(view), (column or curves.DEFAULT).replace(".", "_")
        table, regions = self._curves[view]
        named = {r.name: r for r in regions}
        spans = [self.layout.middle_span(r) for r in regions]
        place = lambda r: self.layout.middle_span(named[r]) if r in named else self.extent(r)
        rows, columns = place(region), place(region2 if region2 is not None else region)

        def only(span, what: str) -> int:
            if span[0] >= span[1]:
                raise ValueError(f"{what} is empty")
            touched = [k for k, (a, b) in enumerate(spans) if a < span[1] and span[0] < b]
            if sum(min(spans[k][1], span[1]) - max(spans[k][0], span[0]) for k in touched) < span[1] - span[0]:
                raise ValueError(f"{what} has bins outside view {view!r}")
            if len(touched) != 1:
                raise ValueError(f"{what} spans the regions {[regions[k].name for k in touched]}; fetch each by itself")
            return touched[0]

        a, b = only(rows, "the row region"), only(columns, "the column region")
        if a != b:
            raise ValueError(f"rows lie in {regions[a].name} and columns in {regions[b].name}; expected is defined within a region")
        curve = table.where(F.col("region_id") == a).select("dist", F.col(column).alias("expected"))
        return blocks.over_expected(self._block(rows, columns, True), counting.small(curve, self.layout.nbins))


def resolutions(spark: SparkSession, path: str) -> list[int]:
    """Resolutions in numeric order."""
    return sorted(int(n) for n in store.Files(spark, path).names(f"{path}/resolutions") if n.isdigit())


def save_levels(spark: SparkSession, path: str, levels: Sequence[ContactMatrix], preset: str = "gzip4", backup: bool = False) -> dict[int, ContactMatrix]:
    def write(to: str) -> None:
        for m in levels:
            level = f"{to}/resolutions/{m.binsize}"
            store.write_level(level, m.layout, m.assembly, m.pixel_rows, m.bin_rows, m.attributes, preset)
            for view, (table, regions) in m._curves.items():
                store.write_view(level, view, curves.region_table(spark, m.layout, regions), table)

    store.replaced(spark, path, write, backup)
    return {m.binsize: ContactMatrix.open(spark, path, m.binsize) for m in levels}


def from_pairs(spark: SparkSession, pairs: DataFrame, sizes, binsize: int, assembly: str | None = None, zero_based: bool = False) -> ContactMatrix:
    """Pairs (chrom1, pos1, chrom2, pos2) -> matrix."""
    layout = Layout(sizes, binsize)
    return ContactMatrix(spark, layout, resolve_assembly(assembly, None, sizes), counting.count_pairs(reading.binned(pairs, layout, zero_based)))


def cload(spark: SparkSession, source: str, binsize: int, out: str, assembly: str | None = None, zero_based: bool = False, preset: str = "gzip4") -> ContactMatrix:
    lines, sizes = reading.read_lines(spark, source)
    if not sizes:
        raise ValueError(f"{source} has no #chromsize lines")
    return from_pairs(spark, reading.parse(lines), sizes, binsize, assembly, zero_based).save(out, preset)


def merge(spark: SparkSession, inputs: Sequence[ContactMatrix], assembly: str | None = None) -> ContactMatrix:
    """Sums over matrices with equal bins; the same chromosomes in the same order."""
    first = inputs[0]
    for m in inputs[1:]:
        if m.binsize != first.binsize or m.layout.sizes != first.layout.sizes:
            raise ValueError("the matrices have different bins or chromosomes")
    stored = next((m.assembly for m in inputs if m.assembly and m.assembly != "unknown"), None)
    return ContactMatrix(spark, first.layout, resolve_assembly(assembly, stored, first.layout.sizes), counting.merge([m.pixel_rows for m in inputs]))


def zoomify(spark: SparkSession, base: ContactMatrix, out: str, wanted: Sequence[int] | None = None, balance_levels: bool = False, with_expected: bool = True, assembly: str | None = None, preset: str = "gzip4", how: balancing.Settings = balancing.Settings()) -> dict[int, ContactMatrix]:
    """A pyramid; each level is built from the coarsest finished level that divides it."""
    assembly = resolve_assembly(assembly, base.assembly, base.layout.sizes)
    levels = schedule(base.layout, wanted)

    def write(to: str) -> None:
        built = {base.binsize: (base.layout, base.pixel_rows)}
        for r in levels:
            if r != base.binsize:
                size = max(k for k in built if r % k == 0)
                layout, rows = built[size]
                made = counting.coarsen(rows, layout, r // size)
            else:
                made = base.pixel_rows
            layout = Layout(base.layout.sizes, r)
            level = f"{to}/resolutions/{r}"
            store.write_level(level, layout, assembly, made, counting.bin_table(spark, layout), {}, preset)
            built[r] = layout, spark.read.parquet(f"{level}/pixels")

    store.replaced(spark, out, write)
    if balance_levels:
        for r in levels:
            balance(ContactMatrix.open(spark, out, r), how, with_expected)
    return {r: ContactMatrix.open(spark, out, r) for r in levels}


def balance(matrix: ContactMatrix, how: balancing.Settings = balancing.Settings(), with_expected: bool = True, few: int = balancing.FEW_PIXELS) -> ContactMatrix:
    """The matrix with weights, also in its files if it has any; expected curves follow, or a warning if they cannot."""
    table, said = balancing.balance(matrix.pixel_rows, matrix.bin_rows, how, few)
    kept = [c for c in matrix.bin_rows.columns if c != "weight"]
    bins = matrix.bin_rows.select(*kept).join(counting.small(table, matrix.layout.nbins), "bin_id", "left")
    out = ContactMatrix(matrix.spark, matrix.layout, matrix.assembly, matrix.pixel_rows, bins, matrix.attributes | said, matrix.path)
    if matrix.path:
        level = f"{matrix.path}/resolutions/{matrix.binsize}"
        store.replaced(matrix.spark, f"{level}/bins", lambda to: bins.repartitionByRange("bin_id").sortWithinPartitions("bin_id").write.parquet(to))
        store.write_meta(matrix.spark, level, matrix.layout, matrix.assembly, store.read_meta(matrix.spark, level)["nnz"], out.attributes)
        out = ContactMatrix.open(matrix.spark, matrix.path, matrix.binsize)
    if with_expected:
        try:
            out = expected(out)
        except Exception as problem:  # curves never fail the balancing that they follow
            warnings.warn(f"no expected curves: {problem}", stacklevel=2)
    return out


def expected(matrix: ContactMatrix, view: str | None = None, centromeres: dict[str, int] | None = None) -> ContactMatrix:
    """Add (or replace) the curves of a view."""
    name, regions = resolve_view(matrix.assembly, matrix.layout.sizes, view, centromeres)
    table = curves.expected(matrix.pixel_rows, matrix.weights, matrix.layout, regions, int(matrix.attributes.get("ignore_diags", 2)))
    matrix._curves[name] = table, regions
    if matrix.path:
        store.write_view(f"{matrix.path}/resolutions/{matrix.binsize}", name, curves.region_table(matrix.spark, matrix.layout, regions), table)
        return ContactMatrix.open(matrix.spark, matrix.path, matrix.binsize)
    return matrix


def repack(spark: SparkSession, source: str, out: str | None = None, backup: bool = False, assembly: str | None = None, preset: str = "gzip4", with_expected: bool = True) -> dict[int, ContactMatrix]:
    """Rewrite all levels, with weights, attributes and further bin columns; levels without weights are balanced."""
    have = resolutions(spark, source)
    if not have:
        raise ValueError(f"{source} has no resolutions")
    levels = [ContactMatrix.open(spark, source, r) for r in have]
    name = resolve_assembly(assembly, levels[0].assembly, levels[0].layout.sizes)
    verify_assembly(name, levels[0].layout.sizes)
    for m in levels:
        m.assembly, m._curves = name, {}
    save_levels(spark, out or source, levels, preset, backup)
    made = {}
    for r in have:
        m = ContactMatrix.open(spark, out or source, r)
        if not m.is_balanced:
            m = balance(m, with_expected=with_expected)
        elif with_expected:
            try:
                m = expected(m)
            except Exception as problem:
                warnings.warn(f"no expected curves: {problem}", stacklevel=2)
        made[r] = m
    return made


def numbered(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """table with position = 0, 1, ... in the order of columns, by ranges; only counts by range reach the driver."""
    dealt = table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist()
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row by range
    bases = table.sparkSession.createDataFrame(counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")).toArrow())
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(bases), "_range").withColumn("position", F.col("_base") + local).drop("_range", "_base")
