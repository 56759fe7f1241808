"""Work that grows with the input is split into tasks that do not."""

import pytest
from pyspark.sql import functions as F

from pixelweave.plans import api_catalog, catalog
from pixelweave.plans import matrix as m
from pixelweave.sources import pairs as reading

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_files(spark, tmp_path):
    """lineitem in six files, each of them a part of the scan."""
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(6).write.parquet(f"{tmp_path}/lineitem.parquet")
    had = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    yield str(tmp_path)
    for k, v in had.items():
        spark.conf.set(k, v)


def of(rows, columns="bin1_id, bin2_id, count"):
    return sorted(map(tuple, rows.select(*columns.split(", ")).collect()))


def test_text_is_written_by_all_parts_of_the_scan(spark, many_files, tmp_path):
    api_catalog.pairs_text(spark, many_files, f"{tmp_path}/text")
    files = list((tmp_path / "text").glob("part-*.txt"))
    assert len(files) >= 6 + 2  # a header, lines that are skipped
    assert max(f.stat().st_size for f in files) < sum(f.stat().st_size for f in files) / 3
    read = m.cload(spark, f"{tmp_path}/text", catalog.BINSIZE, f"{tmp_path}/out", assembly=catalog.ASSEMBLY)
    assert read.layout.sizes == catalog.SIZES and of(read.pixel_rows) == of(catalog.pixels(spark, SF))


def test_header_of_several_files(spark, tmp_path):
    folder = tmp_path / "a b[1]"
    folder.mkdir()
    (folder / "0.pairs").write_text("")
    (folder / "1.pairs").write_text("## pairs format v1.0\n#chromsize: c 950\n")
    (folder / "2.pairs").write_text("#chromsize: d 1\n" + "r\tc\t1\tc\t2\n" * 500)
    (folder / "3.pairs").write_text("r\tc\t1\tc\t2\n" * 2000)
    lines, sizes = reading.read_lines(spark, str(tmp_path / "a b*"))
    assert sizes == [("c", 950)] and reading.parse(lines).count() == 2500


def test_stream_is_fed_by_all_parts_of_the_scan(spark, many_files, monkeypatch):
    started, real = [], api_catalog.incremental.count_stream

    def start(spark, folder, *rest):
        started.append(len(spark.read.text(folder).inputFiles()))
        return real(spark, folder, *rest)

    monkeypatch.setattr(api_catalog.incremental, "count_stream", start)
    assert of(api_catalog.stream_counts(spark, many_files)) == of(catalog.pixels(spark, SF))
    assert started[0] >= 6  # as many files as the scan has parts


@pytest.mark.parametrize("name", ["ooe_region", "matrix_balanced", "expected_sums", "ic_10_iterations", "matrix_raw_cis", "pixels_range"])
def test_pairs_are_counted_once(spark, monkeypatch, name):
    asked, real = [], catalog.pairs

    def pairs(spark, sf_dir):
        asked.append(spark.sparkContext.accumulator(0))
        seen = F.udf(lambda x, n=asked[-1]: n.add(1) or x, "long").asNondeterministic()
        return real(spark, sf_dir).withColumn("pos1", seen("pos1"))

    want = of(catalog.queries()[name](spark, SF), "*")
    monkeypatch.setattr(catalog, "pairs", pairs)
    assert of(catalog.queries()[name](spark, SF), "*") == want
    assert [n.value for n in asked] == [6000]  # lines of lineitem, each of them binned once


def test_rules_alone_ask_no_vocabulary(spark, monkeypatch):
    from pixelweave.llm import fertility, queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang").unionAll(spark.createDataFrame([(-1, None, None), (-2, "", "x"), (-3, "a b c d e f g h " * 9 + "\n\n#\n#", "x")], "doc_id long, text string, lang string"))
    want = of(fertility.judge(docs), ", ".join(("doc_id", *fertility.COUNTS, "base_failed")))
    assert of(fertility.ruled(docs), "*") == want and len(want) == 63

    def never(*_):
        raise AssertionError("measures are not asked for")

    monkeypatch.setattr(fertility, "measured", never)
    assert queries.fertility_base(spark, SF).count() == 200
