"""Connected components of an edge table, by star contraction; all state stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (id, component) for every id with an edge: the smallest id that it reaches.

    Alternates large-star and small-star steps: each links ids to the smallest of their neighbours, until every id
    links to its component's smallest. Minima are aggregated with partial sums and joined back by id: one row meets the
    links of an id, so that Spark may split those of an id with very many. Raises if ROUNDS are not enough.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    last = None
    for _ in range(ROUNDS):
        # large star: the larger neighbours of each id go to the smallest of its neighbours and itself
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        now = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of each id, and itself, go to the smallest of them
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        now = now.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(now, "star-edges")
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if last == (mark["n"], mark["h"]):
            break
        last = (mark["n"], mark["h"])
    else:
        raise RuntimeError(f"components have not settled in {ROUNDS} rounds")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
