"""Assemblies, chromosome sizes, regions and views; plain Python over small metadata."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass

Sizes = Sequence[tuple[str, int]]

# fixed values: names under which an assembly is known (lower case)
ALIASES = {
    "grch38": "hg38", "hg38": "hg38", "grch37": "hg19", "hg19": "hg19", "grcm38": "mm10", "mm10": "mm10", "grcm39": "mm39", "mm39": "mm39",
    "dm6": "dm6", "bdgp6": "dm6", "saccer3": "saccer3", "r64": "saccer3", "ce11": "ce11", "wbcel235": "ce11", "ce10": "ce11",
    "danrer11": "danrer11", "grcz11": "danrer11", "rn6": "rn6", "rn7": "rn7", "mratbn7.2": "rn7", "galgal6": "galgal6", "grcg6a": "galgal6",
    "bostau9": "bostau9", "ars-ucd1.2": "bostau9", "susscr11": "susscr11", "canfam4": "canfam4", "tair10": "tair10",
    "irgsp-1.0": "irgsp1", "os-nipponbare-reference-irgsp-1.0": "irgsp1",
}
# fixed values: suffixes of assembly names that do not matter
SUFFIXES = ("_ebv", "_analysis_set")
# fixed values: assemblies by the length of their first chromosome
FINGERPRINTS = {248956422: "hg38", 249250621: "hg19", 195471971: "mm10", 195154279: "mm39"}
# fixed values: assemblies whose default view is by arms
BY_ARMS = ("hg38", "hg19", "saccer3")
HUMAN = [f"chr{k}" for k in (*range(1, 23), "X", "Y")]
# fixed values: centromeres in bp, in the order of HUMAN, and of chrI to chrXVI
CENTROMERES = {
    "hg38": dict(zip(HUMAN, [123400000, 93900000, 90900000, 50000000, 48800000, 59800000, 60100000, 45200000, 43000000, 39800000, 53400000, 35500000, 17700000, 17200000, 19000000, 36800000, 25100000, 18500000, 26200000, 28100000, 12000000, 15000000, 61000000, 10400000])),
    "hg19": dict(zip(HUMAN, [125000000, 93300000, 91000000, 50400000, 48400000, 61000000, 59900000, 45600000, 49000000, 40200000, 53700000, 35800000, 17900000, 17600000, 19000000, 36600000, 24000000, 17200000, 26500000, 27500000, 13200000, 14700000, 60600000, 12500000])),
    "saccer3": dict(zip([f"chr{r}" for r in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI")], [151465, 238207, 114385, 449711, 151987, 148510, 496920, 105586, 355629, 436307, 440129, 150828, 268031, 628758, 326584, 555957])),
}


@dataclass(frozen=True)
class Region:
    name: str
    chrom: str
    start: int
    end: int


def strip_suffixes(name: str) -> str:
    for suffix in SUFFIXES:
        while name.endswith(suffix):
            name = name[: -len(suffix)]
    return name


def detect(assembly: str, sizes: Sizes = ()) -> str | None:
    """The assembly's canonical id, by name or else by the length of chr1."""
    known = ALIASES.get(strip_suffixes((assembly or "").lower()))
    first = next((n for c, n in sizes if c in ("chr1", "1")), None)
    return known or FINGERPRINTS.get(first)


def resolve_assembly(explicit: str | None, stored: str | None, sizes: Sizes) -> str:
    """Explicit, else stored, else by fingerprint; a matrix without an assembly is refused."""
    if explicit and explicit.strip():
        return explicit.strip()
    if stored and stored != "unknown":
        return stored
    found = detect("", sizes)
    if found is None:
        raise ValueError("no assembly is named and the chromosome sizes are not recognised; pass assembly=")
    return found


def verify_assembly(assembly: str, sizes: Sizes) -> None:
    """Refuse a known name that contradicts known chromosome sizes."""
    named, found = detect(assembly), detect("", sizes)
    if named and found and named != found:
        raise ValueError(f"assembly {assembly!r} contradicts the chromosome sizes, which are those of {found}")


def parse_region(text: str, sizes: dict[str, int]) -> tuple[str, int, int]:
    """'chrom' or 'chrom:start-end' (commas allowed) -> chrom, start, end, inside the chromosome."""
    chrom, colon, span = text.partition(":")
    if chrom not in sizes:
        raise ValueError(f"unknown chromosome {chrom!r}")
    if not colon:
        return chrom, 0, sizes[chrom]
    found = re.fullmatch(r"(\d+)-(\d+)", span.replace(",", "").strip())
    if not found:
        raise ValueError(f"not a region: {text!r}")
    start, end = int(found[1]), int(found[2])
    if not 0 <= start <= end <= sizes[chrom]:
        raise ValueError(f"region {text!r} is not inside {chrom}, which has {sizes[chrom]} bp")
    return chrom, start, end


def parse_bed(lines: Sequence[str], sizes: Sizes) -> list[Region]:
    """Regions of a BED file: known chromosomes, start < end <= length, no overlaps."""
    known, found = dict(sizes), []
    for number, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith(("#", "track", "browser")):
            continue
        parts = line.split()
        if len(parts) < 3:
            raise ValueError(f"BED line {number} has fewer than three fields")
        chrom, at, to = parts[:3]
        if chrom not in known:
            raise ValueError(f"BED line {number}: unknown chromosome {chrom!r}")
        try:
            start, end = int(at), int(to)
        except ValueError:
            raise ValueError(f"BED line {number}: {at!r} and {to!r} are not both numbers") from None
        if not 0 <= start < end <= known[chrom]:
            raise ValueError(f"BED line {number}: {start}-{end} is empty or not inside {chrom}")
        found.append(Region(parts[3] if len(parts) > 3 else f"{chrom}:{start}-{end}", chrom, start, end))
    if not found:
        raise ValueError("the BED file has no regions")
    placed = sorted(found, key=lambda r: (r.chrom, r.start))
    for a, b in zip(placed, placed[1:]):
        if a.chrom == b.chrom and b.start < a.end:
            raise ValueError(f"regions {a.name} and {b.name} overlap")
    return found


def whole_chromosomes(sizes: Sizes) -> list[Region]:
    return [Region(c, c, 0, n) for c, n in sizes]


def arms(sizes: Sizes, centromeres: dict[str, int]) -> list[Region]:
    """Two arms of each chromosome with a centromere (no further than its end), others whole."""
    out = []
    for c, n in sizes:
        if c in centromeres:
            mid = min(centromeres[c], n)
            out += [Region(f"{c}_p", c, 0, mid), Region(f"{c}_q", c, mid, n)]
        else:
            out.append(Region(c, c, 0, n))
    return out


def resolve_view(assembly: str, sizes: Sizes, requested: str | None = None, centromeres: dict[str, int] | None = None) -> tuple[str, list[Region]]:
    """(view name, regions) of 'chroms', 'arms', 'custom:<bed path>', or of the assembly's default."""
    if requested and requested.startswith("custom:"):
        path = requested.removeprefix("custom:")
        with open(path, encoding="utf-8") as f:
            regions = parse_bed(f.read().splitlines(), sizes)
        return os.path.splitext(os.path.basename(path))[0] or "custom", regions
    known = detect(assembly, sizes)
    if requested is None:
        if known is None:
            raise ValueError(f"unknown assembly {assembly!r}: name a view (chroms, arms or custom:<bed>)")
        requested = "arms" if known in BY_ARMS else "chroms"
    if requested == "chroms":
        return "chroms", whole_chromosomes(sizes)
    if requested == "arms":
        table = centromeres or CENTROMERES.get(known or "")
        if table is None:
            raise ValueError(f"no centromeres are known for assembly {assembly!r}; use chroms or custom:<bed>")
        return "arms", arms(sizes, table)
    raise ValueError(f"unknown view {requested!r}: use chroms, arms or custom:<bed>")


class Layout:
    """Fixed-width bins over chromosomes, numbered in their order."""

    #: No more bins than this: bin pairs must stay countable in 63 bits.
    MOST_BINS = 3_037_000_499

    def __init__(self, sizes: Sizes, binsize: int):
        if binsize <= 0:
            raise ValueError("the bin size must be positive")
        names = [c for c, _ in sizes]
        if len(set(names)) != len(names):
            raise ValueError("a chromosome is listed twice")
        for c, n in sizes:
            if not 0 <= n <= 2**31 - 1:
                raise ValueError(f"the length of {c} is negative or over 2^31-1")
            if not c.isascii() or len(c) > 64:
                raise ValueError(f"chromosome name {c!r} is not ASCII or too long")
        self.sizes, self.binsize = [(c, int(n)) for c, n in sizes], binsize
        self.lengths = dict(self.sizes)
        self.counts = [-(-n // binsize) for _, n in self.sizes]
        self.offsets, total = [], 0
        for n in self.counts:
            self.offsets.append(total)
            total += n
        self.nbins = total
        if total > self.MOST_BINS:
            raise ValueError(f"{total} bins are too many")
        self.index = {c: k for k, c in enumerate(names)}

    def span(self, region: Region | tuple[str, int, int]) -> tuple[int, int]:
        """Bins that a region touches: start rounded down, end rounded up."""
        chrom, start, end = (region.chrom, region.start, region.end) if isinstance(region, Region) else region
        base = self.offsets[self.index[chrom]]
        return base + start // self.binsize, base + -(-end // self.binsize)

    def middle_span(self, region: Region) -> tuple[int, int]:
        """Bins whose middle lies in a region, so that neighbouring regions share none."""
        k = self.index[region.chrom]
        at = lambda x: min(max(-(-(2 * x - self.binsize) // (2 * self.binsize)), 0), self.counts[k])
        return self.offsets[k] + at(region.start), self.offsets[k] + at(region.end)


def schedule(layout: Layout, resolutions: Sequence[int] | None = None) -> list[int]:
    """Resolutions of a pyramid: those asked for, or doubled while there are over four bins per chromosome."""
    base = layout.binsize
    if resolutions is None:
        out, size = [base], base
        while Layout(layout.sizes, size).nbins > 4 * len(layout.sizes):
            size *= 2
            out.append(size)
        return out
    wanted = sorted(set(resolutions))
    if not wanted:
        raise ValueError("no resolutions are listed")
    for r in wanted:
        if r < base or r % base:
            raise ValueError(f"resolution {r} is no multiple of the base resolution {base}")
    return wanted
