"""Embedding near-duplicates by collision counting over many one-dimensional projections.

Vectors are compared only within a label. PROJECTIONS random projections are sorted, and a vector collides in a
projection with those in the window centred on it. A pair's collisions are counted, and pairs that reach a count are
verified by cosine in double precision. The count is calibrated: at cosine THRESHOLD, where collisions are rarest among
the pairs wanted, a pair reaches it with a probability of (1 + RECALL) / 2 at least. It is the same at all sizes.

So that windows stay short as the corpus grows, projections sort the vectors of one cell at a time, a cell being the
signs of a few further projections; their number follows the size of the largest label, and there are as many tables of
cells as a pair at THRESHOLD needs to share a cell with the other half of what RECALL allows. A pair is met in every
table in which it shares a cell; the first of them owns it, so links are counted once and no pair needs to be shuffled:
tasks return links by vector, and each vector's smallest link partner for the components. A pair that reaches the count
collides in one of the first few projections; only their windows are walked, and the first of them owns it.

Equal vectors of a label are one class with a multiplicity, and classes have numbers of their own. A cell of more than
BLOCK vectors is cut by hash, and each pair of its blocks is a group of its own.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null
label or a null id, have no links and are their own component; labels of any type are told apart by their text; equal
rows are vectors of their own; so are rows of one id with different vectors; vectors of different lengths never link; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, erf, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import tidy, written
from pixelweave.llm.components import components

THRESHOLD, RECALL = 0.93, 0.9995
#: Projections that are sorted; half a window in deviations of the projected difference of two vectors at THRESHOLD;
#: vectors of a cell on average, at most.
PROJECTIONS, WINDOW, CELL = 12, 2.25, 1024
MOST_SIGNS, MOST_TABLES, BLOCK, PAIRS = 20, 400, 2048, 400_000


def calibrate(largest: int, threshold: float = THRESHOLD) -> tuple[int, int, int, float]:
    """(signs of a cell, tables of cells, count to reach, half a window) for labels of up to `largest` vectors."""
    missed = (1 - RECALL) / 2
    signs = min(MOST_SIGNS, max(0, ceil(log2(max(1, largest) / CELL))))
    share = (1 - acos(threshold) / pi) ** signs
    tables = next((t for t in range(1, MOST_TABLES + 1) if (1 - share) ** t <= missed), None)
    if tables is None:
        raise ValueError(f"a threshold of {threshold} needs more than {MOST_TABLES} tables")
    p = erf(WINDOW / sqrt(2))
    below = [sum(comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k) for k in range(least)) for least in range(PROJECTIONS + 1)]
    least = max(k for k, x in enumerate(below) if x <= missed)
    return signs, tables, least, WINDOW * sqrt(2 - 2 * threshold)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def signed(classes: DataFrame, signs: int, tables: int, seed: int = 11) -> DataFrame:
    """label, width, c, copies, vector (bytes), codes (the cell in each table), places (in the projections, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            vectors = [np.array(v, np.float64) for v in b.column(2).to_pylist()]
            codes, places = [b""] * len(vectors), [b""] * len(vectors)
            held: list[bytes] = [b""] * len(vectors)
            widths = np.array([len(v) for v in vectors], np.int64)
            for w in np.unique(widths).tolist():
                if w not in planes:
                    rng = np.random.default_rng([seed, w])
                    planes[w] = rng.standard_normal((w, PROJECTIONS)), rng.standard_normal((w, tables * signs))
                which = np.flatnonzero(widths == w).tolist()
                raw = np.stack([vectors[k] for k in which])
                short = raw.astype(np.float32)
                exact = (short == raw).all(1)  # then four bytes each say all
                x = unit(raw)
                at = (x @ planes[w][0]).astype(np.float32)
                bits = ((x @ planes[w][1]).reshape(len(x), tables, signs) > 0) @ (1 << np.arange(signs)) if signs else np.zeros((len(x), tables), np.int64)
                for n, k in enumerate(which):
                    codes[k], places[k] = bits[n].astype("<i4").tobytes(), at[n].tobytes()
                    held[k] = short[n].tobytes() if exact[n] else vectors[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(widths.astype(np.int32)), b.column(1), b.column(3), pa.array(held, pa.binary()), pa.array(codes, pa.binary()), pa.array(places, pa.binary())], names=["label", "width", "c", "copies", "vector", "codes", "places"])

    return classes.select("label", "c", "v", "copies").mapInArrow(tidy(run), "label string, width int, c long, copies long, vector binary, codes binary, places binary")


def windows(left: np.ndarray, right: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of places in left and (sorted) right that are within reach, some at a time."""
    lo, hi = np.searchsorted(right, left - reach, "left"), np.searchsorted(right, left + reach, "right")
    number = hi - lo
    ends = np.cumsum(number)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = number[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)
        yield i, j
        at = stop


def collide(cells: DataFrame, least: int, reach: float, threshold: float) -> DataFrame:
    """Groups of a cell's blocks -> c, links (copies of partners included), root (the smallest class connected here)."""

    def run(t: pa.Table) -> pa.Table:
        table, p, q, width = (t.column(k)[0].as_py() for k in ("table", "_p", "_q", "width"))
        ids, copies, block = (t.column(c).to_numpy() for c in ("c", "copies", "_k"))
        x = unit(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * width else np.float64).astype(np.float64) for v in t.column("vector").to_pylist()]))
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), "<i4").reshape(len(ids), -1)
        at = np.frombuffer(b"".join(t.column("places").to_pylist()), np.float32).reshape(len(ids), -1)
        found_a, found_b = [], []
        walked = at.shape[1] - least + 1
        for k in range(walked):
            right = np.flatnonzero(block == q)
            right = right[np.argsort(at[right, k], kind="stable")]
            left = right if p == q else np.flatnonzero(block == p)
            for i, j in windows(at[left, k], at[right, k], np.float32(reach)):
                if p == q:
                    i, j = i[i < j], j[i < j]
                a, b = left[i], right[j]
                for e in range(table):  # pairs that an earlier table owns
                    mine = codes[a, e] != codes[b, e]
                    a, b = a[mine], b[mine]
                for s in range(0, len(a), 100_000):
                    u, v = a[s : s + 100_000], b[s : s + 100_000]
                    near = np.abs(at[u] - at[v]) <= np.float32(reach)
                    good = (near.sum(1) >= least) & ~near[:, :k].any(1)  # that no earlier projection has met
                    u, v = u[good], v[good]
                    good = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                    found_a.append(u[good])
                    found_b.append(v[good])
        a, b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_a, found_b))
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = ids.copy()
        while True:
            low = np.minimum(root[a], root[b])
            old = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (root == old).all():
                break
        some = np.flatnonzero(links)
        return pa.table({"c": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})

    return cells.groupBy("label", "width", "table", "code", "_p", "_q").applyInArrow(run, "c long, links long, root long")


def join(vectors: DataFrame, threshold: float = THRESHOLD, ident="vec_id", vector="embedding", label="label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda e: e != 0)
    # -0.0 and 0.0 are one: equal arrays must have equal hashes
    good = rows.where(sound).withColumn("v", F.transform("v", lambda e: e + F.lit(0.0))).withColumn("_h", F.xxhash64("v"))
    classes = good.groupBy("label", "_h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "embed-classes")
    largest = (classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first() or [0])[0] or 0
    signs, tables, least, reach = calibrate(largest, threshold)
    points = written(signed(classes, signs, tables), "embed-points", rows=2000)
    code = lambda k: F.conv(F.hex(F.reverse(F.substring("codes", 4 * k + 1, 4))), 16, 10).cast("int")
    every = F.posexplode(F.array(*[code(k) for k in range(tables)])).alias("table", "code")
    crowded = points.select("label", "width", every).groupBy("label", "width", "table", "code").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    spread = points.select("*", every).join(crowded, ["label", "width", "table", "code"], "left")
    spread = spread.withColumn("_of", F.coalesce(F.ceil(F.col("_n") / BLOCK).cast("int"), F.lit(1))).withColumn("_k", F.pmod(F.xxhash64("c"), F.col("_of")).cast("int"))
    spread = spread.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).withColumn("_p", F.least("_k", "_o")).withColumn("_q", F.greatest("_k", "_o")).drop("_n", "_of", "_o")
    found = written(collide(spread, least, reach, threshold), "embed-links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("c"), F.col("component").alias("_c"))
    heads = classes.join(links, "c", "left").join(parts, "c", "left").withColumn("_c", F.coalesce("_c", "c"))
    heads = heads.join(heads.groupBy("_c").agg(F.min("id").alias("component_id")), "_c")
    heads = heads.select("label", "_h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = good.join(heads, ["label", "_h", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
