import numpy as np
import pytest

from pixelweave.functions import kernels
from pixelweave.functions.genome import ALIASES, CENTROMERES, Layout, Region, arms, detect, parse_bed, parse_region, resolve_assembly, resolve_view, schedule, verify_assembly

SIZES = [("chr1", 1000), ("chr2", 1000)]


def test_names_and_fingerprints():
    assert detect("GRCh38_analysis_set") == "hg38" and detect("hg19_EBV") == "hg19"
    assert detect("unknown", [("1", 195471971)]) == "mm10" and detect("x", SIZES) is None
    assert all(detect(a) == g for a, g in ALIASES.items())
    assert [len(CENTROMERES[g]) for g in ("hg38", "hg19", "saccer3")] == [24, 24, 16]


def test_assembly_precedence():
    assert resolve_assembly(" mine ", "hg38", SIZES) == "mine"
    assert resolve_assembly(None, "hg38", SIZES) == "hg38"
    assert resolve_assembly("", "unknown", [("chr1", 248956422)]) == "hg38"
    with pytest.raises(ValueError):
        resolve_assembly(None, "", SIZES)
    with pytest.raises(ValueError):
        verify_assembly("hg19", [("chr1", 248956422)])
    verify_assembly("mine", [("chr1", 248956422)])


def test_views(tmp_path):
    assert [r.name for r in arms([("a", 10), ("b", 20)], {"b": 50})] == ["a", "b_p", "b_q"]
    assert arms([("b", 20)], {"b": 50})[1] == Region("b_q", "b", 20, 20)
    assert resolve_view("hg38", [("chr1", 248956422)])[0] == "arms" and resolve_view("mm10", SIZES)[0] == "chroms"
    with pytest.raises(ValueError):
        resolve_view("nobody", SIZES)
    with pytest.raises(ValueError):
        resolve_view("mm10", SIZES, "arms")
    with pytest.raises(ValueError):
        resolve_view("mm10", SIZES, "halves")
    bed = tmp_path / "parts.bed"
    bed.write_text("track x\n# c\nchr1 0 500 left\nchr1\t500\t1000\n")
    assert resolve_view("", SIZES, f"custom:{bed}") == ("parts", [Region("left", "chr1", 0, 500), Region("chr1:500-1000", "chr1", 500, 1000)])


@pytest.mark.parametrize("line", ["chr9 0 10", "chr1 5 5", "chr1 9 3", "chr1 0 1001", "chr1 0", "chr1 a 10", "", "chr1 0 10\nchr1 5 20"])
def test_bad_bed(line):
    with pytest.raises(ValueError):
        parse_bed(line.split("\n"), SIZES)


def test_regions_and_bins():
    layout = Layout(SIZES, 100)
    assert parse_region("chr1", layout.lengths) == ("chr1", 0, 1000) and parse_region("chr1:1,00-200", layout.lengths) == ("chr1", 100, 200)
    for bad in ("chr3", "chr1:5", "chr1:10-2000", "chr1:20-10", "chr1:1k-2k"):
        with pytest.raises(ValueError):
            parse_region(bad, layout.lengths)
    assert layout.span(("chr2", 150, 250)) == (11, 13)
    assert layout.middle_span(Region("r", "chr1", 0, 455)) == (0, 5) and layout.middle_span(Region("r", "chr1", 449, 1000)) == (4, 10)
    with pytest.raises(ValueError):
        Layout([("a", 1), ("a", 2)], 10)
    with pytest.raises(ValueError):
        Layout([("a", 2**31)], 10)


def test_schedule():
    layout = Layout([("a", 250), ("b", 130)], 10)
    assert schedule(layout) == [10, 20, 40, 80] and schedule(layout, [30, 10, 30]) == [10, 30]
    for bad in ([5], [15], []):
        with pytest.raises(ValueError):
            schedule(layout, bad)


def test_smoothing_vector():
    # fixed values: the expected curve of 1..12 over 0..11
    want = [0.0, 2.0106780713396764, 3.1815689640695157, 4.256973276759025, 5.329797111975757, 6.411757698746538, 7.4695854241760085, 8.442141916493815, 9.254735954755823, 9.880058265634439, 10.340225151643418, 10.674910402595378]
    s, v = kernels.smoothed(np.arange(12.0), np.arange(1, 13.0), np.full(12, 10.0))
    assert np.allclose(s, want, atol=1e-9) and v[0] == 0 and np.allclose(v[1:], 10)
    assert np.isclose(kernels.interpolated(np.array([4.0]), np.array([0.0, 1, 2, 8]), np.array([0.0, 2, 4, 16]))[0], 8)


def test_separations_match_counting():
    v = np.random.default_rng(0).random(37) < 0.6
    assert kernels.separations(v).tolist() == [int((v[: 37 - d] & v[d:]).sum()) for d in range(37)]
