"""Read pairs made from the lineitem table, and the small assembly that they map to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.functions.genome import Layout

SIZES = [("chrA", 1_000_000), ("chrB", 805_000), ("chrC", 603_500), ("chrD", 250_000)]
CENTROMERES = {"chrA": 455_000, "chrB": 400_000}
ASSEMBLY, BINSIZE = "fixture", 10_000
LAYOUT = Layout(SIZES, BINSIZE)


def pairs_sql(div: str = "div") -> str:
    """Chromosome numbers c1, c2 and 1-based positions pos1, pos2, in integer arithmetic only."""
    length = lambda c: "CASE " + c + " " + " ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(SIZES[:-1])) + f" ELSE {SIZES[-1][1]} END"
    return f"""
SELECT c1, c2, 1 + (p*7919 + o*104729) % l1 AS pos1,
       CASE WHEN c1 = c2 THEN 1 + ((p*7919 + o*104729) % l1 + (q*q*q) * (l1 {div} 250000)) % l1
            ELSE 1 + (s*15485863 + o*32452843 + p*7919) % l2 END AS pos2
FROM (SELECT *, {length("c1")} AS l1, {length("c2")} AS l2
      FROM (SELECT *, CASE WHEN c1 = 3 OR n > 5 THEN (s+n) % 3 ELSE c1 END AS c2
            FROM (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p, l_suppkey AS s,
                         CAST(l_quantity AS BIGINT) AS q,
                         CASE WHEN l_orderkey % 211 = 0 THEN 3 ELSE (l_partkey*31 + l_orderkey) % 3 END AS c1
                  FROM {{lineitem}}) a) b) c"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom1, pos1, chrom2, pos2."""
    names = "array(" + ", ".join(f"'{c}'" for c, _ in SIZES) + ")"
    sql = pairs_sql().replace("{lineitem}", f"parquet.`{sf_dir}/lineitem.parquet`")
    return spark.sql(f"SELECT element_at({names}, CAST(c1 + 1 AS INT)) AS chrom1, pos1, element_at({names}, CAST(c2 + 1 AS INT)) AS chrom2, pos2 FROM ({sql})")
