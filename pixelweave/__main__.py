"""python -m pixelweave cload | merge | zoomify | balance | expected | repack | info"""

from __future__ import annotations

import argparse
import json

from pixelweave.operators.balance import Settings
from pixelweave.plans import matrix as m
from pixelweave.plans import store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pixelweave", description="Contact matrices on Spark")
    top.add_argument("--threads", type=int, default=8, help="cores, where no master is configured")
    top.add_argument("--mem", type=float, help="memory of the driver in GB, where no master is configured")
    top.add_argument("--chunksize", type=int, help="instead of --mem: pairs held at once by a core")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, out: bool, preset: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--assembly")
        if out:
            p.add_argument("-o", "--out", required=name not in ("repack",))
        if preset:
            p.add_argument("--compression", default="gzip4")
        return p

    def settings(p: argparse.ArgumentParser) -> None:
        for f, kind in (("ignore_diags", int), ("mad_max", float), ("min_nnz", int), ("min_count", int), ("tol", float), ("max_iters", int)):
            p.add_argument("--" + f.replace("_", "-"), type=kind, default=getattr(Settings(), f))
        p.add_argument("--no-expected", action="store_true")

    p = command("cload", out=True)
    p.add_argument("pairs", help="a pairs file, plain or .gz, or - for standard input")
    p.add_argument("binsize", type=int)
    p.add_argument("--zero-based", action="store_true")
    command("merge", out=True).add_argument("inputs", nargs="+")
    p = command("zoomify", out=True)
    p.add_argument("input")
    p.add_argument("-r", "--resolutions", help="separated by commas; doubled by default")
    p.add_argument("--balance", action="store_true")
    settings(p)
    p = command("balance", out=False, preset=False)
    p.add_argument("input")
    settings(p)
    p = command("expected", out=False, preset=False)
    p.add_argument("input")
    p.add_argument("--view", help="chroms, arms or custom:<bed>; the assembly's own by default")
    p = command("repack", out=True)
    p.add_argument("input")
    p.add_argument("--backup", action="store_true")
    p.add_argument("--no-expected", action="store_true")
    command("info", out=False, preset=False).add_argument("input")
    return top


def run(a: argparse.Namespace, spark) -> list[dict]:
    """What was made: the info of each level."""
    how = Settings(**{k: getattr(a, k) for k in Settings.__dataclass_fields__}) if hasattr(a, "mad_max") else Settings()
    opened = lambda path: m.ContactMatrix.open(spark, path)
    if a.command == "cload":
        made = [m.cload(spark, a.pairs, a.binsize, a.out, a.assembly, a.zero_based, a.compression)]
    elif a.command == "merge":
        made = [m.merge(spark, [opened(x) for x in a.inputs], a.assembly).save(a.out, a.compression)]
    elif a.command == "zoomify":
        wanted = [int(x) for x in a.resolutions.split(",")] if a.resolutions else None
        made = list(m.zoomify(spark, opened(a.input), a.out, wanted, a.balance, not a.no_expected, a.assembly, a.compression, how).values())
    elif a.command == "balance":
        levels = [opened(a.input)] if "::" in a.input else [m.ContactMatrix.open(spark, a.input, r) for r in m.resolutions(spark, a.input)]
        made = [m.balance(x, how, not a.no_expected) for x in levels]
    elif a.command == "expected":
        levels = [opened(a.input)] if "::" in a.input else [m.ContactMatrix.open(spark, a.input, r) for r in m.resolutions(spark, a.input)]
        made = [m.expected(x, a.view) for x in levels]
    elif a.command == "repack":
        made = list(m.repack(spark, a.input, a.out, a.backup, a.assembly, a.compression, not a.no_expected).values())
    else:
        made = [m.ContactMatrix.open(spark, a.input, r) for r in m.resolutions(spark, a.input)]
    return [x.info for x in made]


def main(args: list[str] | None = None) -> None:
    from pyspark import SparkConf
    from pyspark.sql import SparkSession

    a = parser().parse_args(args)
    builder = SparkSession.builder.appName("pixelweave")
    if not SparkConf().contains("spark.master"):
        builder = builder.master(f"local[{a.threads}]").config("spark.driver.memory", f"{max(1, round(store.memory_gb(a.mem, a.chunksize, a.threads)))}g")
    for x in run(a, builder.getOrCreate()):
        print(json.dumps(x))


if __name__ == "__main__":
    main()
