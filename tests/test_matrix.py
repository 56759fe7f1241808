import gzip
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pixelweave.functions.columns import MOST, saturated
from pixelweave.functions.genome import Layout
from pixelweave.operators import balance as balancing
from pixelweave.operators import pixels as counting
from pixelweave.plans import matrix as m
from pixelweave.plans import store
from pixelweave.sources import pairs as reading
from pixelweave.sources.synthetic import generate
from pixelweave.streaming.incremental import count_stream, counted

SIZES = [("chr1", 248956422), ("chr2", 242193529)]
BINSIZE = 10_000
TOY = [("chr1", 1000), ("chr2", 1000)]


def made(n=20000, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        u = rng.random()
        a, b = ("chr1", "chr1") if u < 0.5 else ("chr2", "chr2") if u < 0.7 else ("chr1", "chr2")
        p = rng.randrange(1, 3_000_000)
        q = min(3_000_000, p + int(500 * 1.01 ** rng.randrange(800))) if a == b else rng.randrange(1, 3_000_000)
        rows.append((a, p, b, q))
    return rows


def text_of(rows, sizes=SIZES, end="\n"):
    head = "## pairs format v1.0\n#columns: readID chr1 pos1 chr2 pos2 strand1 strand2\n" + "".join(f"#chromsize: {c} {n}\n" for c, n in sizes)
    return head + "\n".join(f"r{k}\t{a}\t{p}\t{b}\t{q}\t+\t-" for k, (a, p, b, q) in enumerate(rows)) + end


def brute(rows, sizes, binsize, base=1):
    layout = Layout(sizes, binsize)
    at = lambda c, p: layout.offsets[layout.index[c]] + max(p - base, 0) // binsize
    return Counter(tuple(sorted((at(a, p), at(b, q)))) for a, p, b, q in rows)


def table(rows):
    return {(r["bin1_id"], r["bin2_id"]): r["count"] for r in rows.collect()}


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def loaded(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("m")
    (folder / "x.pairs").write_text(text_of(rows))
    return m.cload(spark, str(folder / "x.pairs"), BINSIZE, str(folder / "out"))


def test_cload_matches_counting(loaded, rows):
    assert table(loaded.pixel_rows) == brute(rows, SIZES, BINSIZE) and loaded.assembly == "hg38"
    assert loaded.info["sum"] == len(rows) and loaded.info["nnz"] == len(brute(rows, SIZES, BINSIZE))


@pytest.mark.parametrize("kind", ["plain", "gz", "members", "unterminated", "odd lines"])
def test_text_forms(spark, tmp_path, kind):
    rows = made(300)
    text, path = text_of(rows), tmp_path / ("x.pairs" + ".gz" * (kind in ("gz", "members")))
    if kind == "gz":
        path.write_bytes(gzip.compress(text.encode()))
    elif kind == "members":
        half = len(text) // 2
        path.write_bytes(gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()))
    else:
        path.write_text(text.rstrip("\n") if kind == "unterminated" else text + "#comment\n\nshort\tline\n" * (kind == "odd lines"))
    lines, sizes = reading.read_lines(spark, str(path))
    assert sizes == SIZES
    layout = Layout(sizes, BINSIZE)
    assert table(counting.count_pairs(reading.binned(reading.parse(lines), layout))) == brute(rows, SIZES, BINSIZE)


@pytest.mark.parametrize("base, pos, want", [(1, 1, 0), (1, 100, 0), (1, 101, 1), (1, 200, 1), (1, 1000, 9), (0, 100, 1), (0, 0, 0), (1, 0, 0)])
def test_positions(spark, base, pos, want):
    pair = spark.createDataFrame([("chr1", pos, "chr2", 1000 if base else 999)], "chrom1 string, pos1 long, chrom2 string, pos2 long")
    got = reading.binned(pair, Layout(TOY, 100), zero_based=not base).first()
    assert (got["bin1_id"], got["bin2_id"]) == (want, 19)


def test_last_bin_is_the_limit(spark):
    layout = Layout([("a", 950)], 100)
    pair = lambda p: spark.createDataFrame([("a", p, "a", 1)], "chrom1 string, pos1 long, chrom2 string, pos2 long")
    assert reading.binned(pair(1000), layout).first()["bin2_id"] == 9
    for bad in (1001, -5, None):
        with pytest.raises(PySparkException):
            reading.binned(pair(bad), layout).collect()
    with pytest.raises(PySparkException, match="chrZ"):
        reading.binned(spark.createDataFrame([("chrZ", 1, "a", 1)], "chrom1 string, pos1 long, chrom2 string, pos2 long"), layout).collect()


def test_toy_merge_and_saturation(spark):
    t = lambda rows: spark.createDataFrame(rows, "bin1_id long, bin2_id long, count int")
    parts = [t([(0, 1, 1), (0, 3, 1), (0, 5, 1)]), t([(0, 3, 10), (0, 4, 10)]), t([(0, 1, 2), (0, 5, 2), (0, 9, 2)])]
    assert table(counting.merge(parts)) == {(0, 1): 3, (0, 3): 11, (0, 4): 10, (0, 5): 3, (0, 9): 2}
    large = [t([(0, 0, MOST), (1, 1, MOST - 1)]), t([(0, 0, 5), (1, 1, 1)])]
    assert table(counting.merge(large)) == {(0, 0): MOST, (1, 1): MOST} and counting.clamped(large) == 1
    assert [r[0] for r in spark.createDataFrame([(5,), (MOST,), (2**31,), (9 * 10**9,)], "n long").select(saturated(F.col("n"))).collect()] == [5, MOST, MOST, MOST]


def test_merge_doubles_and_refuses(spark, loaded):
    assert table(m.merge(spark, [loaded, loaded]).pixel_rows) == {k: 2 * v for k, v in table(loaded.pixel_rows).items()}
    other = m.from_pairs(spark, spark.createDataFrame([("chr1", 1, "chr1", 1)], "chrom1 string, pos1 long, chrom2 string, pos2 long"), [("chr1", 248956422)], BINSIZE)
    with pytest.raises(ValueError):
        m.merge(spark, [loaded, other])


@pytest.mark.parametrize("factor", [2, 3, 4])
def test_coarsen(loaded, rows, factor):
    assert table(counting.coarsen(loaded.pixel_rows, loaded.layout, factor)) == brute(rows, SIZES, BINSIZE * factor)


def test_coarse_map_edges(spark):
    layout = Layout([("a", 250), ("b", 130)], 10)
    t = spark.createDataFrame([(24, 25, 1), (0, 37, 1)], "bin1_id long, bin2_id long, count int")
    assert table(counting.coarsen(t, layout, 2)) == {(12, 13): 1, (0, 19): 1}


def test_offsets_of_the_toy(spark):
    layout = Layout([("chrA", 35), ("chrB", 20)], 10)
    t = spark.createDataFrame([(0, 0, 5), (0, 3, 2), (1, 1, 7), (4, 5, 3)], "bin1_id long, bin2_id long, count int")
    assert layout.offsets == [0, 4] and layout.nbins == 6
    assert [r["bin1_offset"] for r in counting.bin1_offsets(t, layout).orderBy("bin_id").collect()] == [0, 2, 3, 3, 3, 4, 4]
    assert [(r["start"], r["end"]) for r in counting.bin_table(spark, layout).orderBy("bin_id").collect()] == [(0, 10), (10, 20), (20, 30), (30, 35), (0, 10), (10, 20)]


def dense(t, n):
    a = np.zeros((n, n))
    for (i, j), c in t.items():
        a[i, j] += c
        if i != j:
            a[j, i] += c
    return a


@pytest.fixture(scope="module")
def small(spark, rows):
    sizes = [("chr1", 3_100_000), ("chr2", 3_000_100)]
    pairs = spark.createDataFrame(rows, "chrom1 string, pos1 long, chrom2 string, pos2 long")
    out = m.from_pairs(spark, pairs, sizes, 100_000, assembly="test")
    out.pixel_rows.persist()
    return out


def test_balance_flattens_and_paths_agree(small):
    weights, said = balancing.balance(small.pixel_rows, small.bin_rows, balancing.Settings(min_nnz=3))
    w = np.array([np.nan if r["weight"] is None else r["weight"] for r in weights.orderBy("bin_id").collect()])
    a = dense({k: v for k, v in table(small.pixel_rows).items() if k[1] - k[0] >= 2}, len(w))
    b = np.nan_to_num(w)
    g = (b[:, None] * a * b).sum(1)
    assert said["converged"] and np.isclose(g[g > 0].mean(), 1, atol=1e-3) and g[g > 0].std() / g[g > 0].mean() < 1e-3
    far, _ = balancing.balance(small.pixel_rows, small.bin_rows, balancing.Settings(min_nnz=3), few=0)
    v = np.array([np.nan if r["weight"] is None else r["weight"] for r in far.orderBy("bin_id").collect()])
    assert np.allclose(w, v, rtol=1e-9, equal_nan=True)


def test_expected_against_counting(spark, small, tmp_path):
    done = m.balance(m.ContactMatrix(spark, small.layout, "test", small.pixel_rows), balancing.Settings(min_nnz=3), with_expected=False)
    bed = tmp_path / "halves.bed"
    bed.write_text("chr1 0 1550000 left\nchr1 1550000 3100000 right\nchr2 0 3000100\n")
    done = m.expected(done, f"custom:{bed}")
    w = np.array([np.nan if r["weight"] is None else r["weight"] for r in done.weights.orderBy("bin_id").collect()])
    a = dense(table(small.pixel_rows), len(w))
    got = {(r["region1"], r["dist"]): r for r in done.expected().collect()}
    for name, (lo, hi) in {"left": (0, 16), "right": (15, 31), "chr2:0-3000100": (31, 62)}.items():
        for d in range(hi - lo):
            i = [k for k in range(lo, hi - d) if w[k] == w[k] and w[k + d] == w[k + d]]
            r = got[name, d]
            assert r["n_valid"] == len(i) and r["n_total"] == hi - lo - d
            if d >= 2:
                assert np.isclose(r["balanced_sum"], sum(a[k, k + d] * w[k] * w[k + d] for k in i)) and r["count_sum"] == sum(a[k, k + d] for k in i)
            else:
                assert r["balanced_sum"] is None and r["count_avg"] is None
    ooe = done.ooe("left", column="balanced_avg").collect()
    assert all(np.isclose(r["ooe"], r["value"] / got["left", abs(r["bin1_id"] - r["bin2_id"])]["balanced_avg"]) for r in ooe if r["ooe"] is not None)
    for bad in (("chr1",), ("left", "right"), ("chr1:0-0",)):
        with pytest.raises(ValueError):
            done.ooe(*bad)


def test_blocks(spark, small):
    a = dense(table(small.pixel_rows), small.layout.nbins)
    assert (small.dense("chr1") == a[:31, :31]).all() and (small.dense("chr2", "chr1") == a[31:, :31]).all()
    assert (small.dense("chr1:0-1000000", "chr1:500000-3000000") == a[:10, 5:30]).all()
    assert table(small.raw()[3:9, 40:50]) == {(i, j): c for i in range(3, 9) for j in range(40, 50) if (c := a[i, j])}
    with pytest.raises(ValueError):
        small.balanced("chr1")
    assert small.pixels().fetch("chr1", "chr2").where("bin2_id < 31").count() == 0
    with pytest.raises(ValueError):
        small.pixels(join=True).fetch("chr1", "chr2")
    assert small.bins()[2:4].count() == 2 and small.chroms().fetch("chr2").first()["length"] == 3_000_100
    assert [r["bin1_id"] for r in small.pixels()[:5].collect()] == [0] * 5 and len(small.pixels()) == small.info["nnz"]


def test_rows_prune_the_scan(loaded):
    plan = loaded.pixels().fetch("chr2:0-1000000")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(bin1_id" in plan


def test_round_trip_and_repack(spark, loaded, tmp_path):
    path = str(tmp_path / "z")
    levels = m.zoomify(spark, loaded, path, [BINSIZE, 2 * BINSIZE, 4 * BINSIZE, 3 * BINSIZE])
    assert m.resolutions(spark, path) == [10000, 20000, 30000, 40000]
    assert all(x.info["sum"] == loaded.info["sum"] for x in levels.values())
    again = m.ContactMatrix.open(spark, path + "::resolutions/20000")
    assert table(again.pixel_rows) == table(counting.coarsen(loaded.pixel_rows, loaded.layout, 2))
    with pytest.raises(ValueError):
        m.ContactMatrix.open(spark, path)
    extra = again.bin_rows.withColumn("gc", F.col("bin_id") * 0.5).withColumn("weight", F.lit(1.0))
    m.ContactMatrix(spark, again.layout, again.assembly, again.pixel_rows, extra, {"tol": 1e-4}).save(path + "1")
    done = m.repack(spark, path + "1", backup=True)[20000]
    assert {"gc", "weight"} <= set(done.bin_rows.columns) and done.attributes["tol"] == 1e-4 and done.expected_views() == ["arms"]
    assert store.Files(spark, path).exists(path + "1.bak")
    with pytest.raises(ValueError):
        m.repack(spark, path + "1", assembly="hg19")


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "x")

    def fail(to):
        spark.range(3).write.parquet(to)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.replaced(spark, path, fail)
    assert list(tmp_path.iterdir()) == []


def test_guards(spark, small):
    with pytest.raises(ValueError):
        m.ContactMatrix(spark, small.layout, "t", small.pixel_rows.withColumn("count", F.col("count").cast("double")))
    assert [store.codec(p) for p in ("gzip", "gzip9", "blosc:zstd:3", "blosc:lz4", "none")] == ["gzip", "gzip", "zstd", "lz4_raw", "none"]
    for bad in ("gzip10", "zip", "blosc", "blosc:snappy"):
        with pytest.raises(ValueError):
            store.codec(bad)
    assert store.memory_gb() == 4 and store.memory_gb(chunksize=10**6) == 0.32 and store.memory_gb(mem=2) == 2
    with pytest.raises(ValueError):
        store.memory_gb(1, 2)


def test_stream_adds_up(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    layout = Layout(SIZES, BINSIZE)
    for k in (0, 1):
        (tmp_path / "in" / f"{k}.pairs").write_text(text_of(rows[k * 500 : (k + 1) * 500]))
        count_stream(spark, str(tmp_path / "in"), layout, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert table(counted(spark, str(tmp_path / "out"))) == brute(rows[:1000], SIZES, BINSIZE)


def test_synthetic_pairs(spark):
    t = generate(spark, 4000, TOY, 5)
    assert t.where("pos1 < 1 or pos2 < 1 or pos1 > 1000 or pos2 > 1000").count() == 0
    assert sorted(t.collect()) == sorted(generate(spark, 4000, TOY, 5, partitions=7).collect())
    assert 0.75 < t.where("chrom1 = chrom2").count() / 4000 < 0.95


def test_command_line(spark, tmp_path, capsys):
    from pixelweave import __main__ as cli

    lines = ["#chromsize: c1 1000", "#chromsize: c2 500", *[f"r\tc1\t{1 + k * 37 % 1000}\tc2\t{1 + k * 91 % 500}" for k in range(400)]]
    (tmp_path / "x.pairs").write_text("\n".join(lines) + "\n")
    x, two, z = (str(tmp_path / k) for k in ("x", "two", "z"))
    cli.main(["cload", "-o", x, "--assembly", "toy", str(tmp_path / "x.pairs"), "50"])
    cli.main(["merge", "-o", two, x, x])
    cli.main(["zoomify", "-o", z, "-r", "50,100", two])
    cli.main(["balance", "--min-nnz", "1", "--mad-max", "0", "--no-expected", z])
    cli.main(["expected", "--view", "chroms", z + "::resolutions/100"])
    cli.main(["repack", "--no-expected", "--backup", z])
    cli.main(["info", z])
    said = [json.loads(t) for t in capsys.readouterr().out.splitlines() if t.startswith("{")]
    assert [i["sum"] for i in said] == [400, 800, 800, 800, 800, 800, 800, 800, 800, 800, 800] and [i["balanced"] for i in said[-2:]] == [True, True]
    with pytest.raises(SystemExit):
        cli.main(["cload", x])


def test_ordered_chromosomes_and_replacement(spark, tmp_path):
    sizes = [("z", 100), ("a", 50)]
    pairs = spark.createDataFrame([("a", 1, "z", 5), ("z", 80, "z", 99)], "chrom1 string, pos1 long, chrom2 string, pos2 long")
    x = m.from_pairs(spark, pairs, sizes, 10, "toy").save(str(tmp_path / "m"))
    t = x.to_pandas(x.pixels(join=True)[:])
    assert list(t["chrom1"].cat.categories) == ["z", "a"] and t["chrom1"].cat.ordered
    path = str(tmp_path / "d")
    write = lambda text: lambda to: spark.createDataFrame([(text,)], "x string").write.parquet(to)
    for text, backup in (("one", False), ("two", True), ("three", False)):
        store.replaced(spark, path, write(text), backup)
    assert spark.read.parquet(path).first()["x"] == "three" and spark.read.parquet(path + ".bak").first()["x"] == "one"


def test_coarsen_of_many_chromosomes(spark, monkeypatch):
    from pixelweave.operators import pixels as counting

    layout = Layout([(f"c{k}", 37 + k) for k in range(60)], 5)
    rows = spark.createDataFrame([(i, i + i * i % 7, 1 + i % 3) for i in range(layout.nbins - 7)], "bin1_id long, bin2_id long, count int")
    many = sorted(map(tuple, counting.coarsen(rows, layout, 3).collect()))
    monkeypatch.setattr(counting, "FEW_CHROMOSOMES", 100)
    assert many == sorted(map(tuple, counting.coarsen(rows, layout, 3).collect()))
