"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document d of source s gets a rate r_d, the expected number of its copies. Among all rates that meet the
source's token constraint sum(size_d * r_d) = target_s, entropy balancing takes those nearest to 1 in relative
entropy. The convex dual has one multiplier per source and gives exponentially tilted rates

    r_d = min(cap, exp(lambda_s * size_d / scale_s)).

Rates depend on (source, size) alone, so the Newton steps run over the histogram of sizes: each step is one
partial-and-final aggregation, whatever the number of documents, and a source with a third of all rows is spread
like any other. Steps that leave the bracket found so far are replaced by bisection.

Rounding: a document gets floor(r_d) copies, and one more if u_d - frac(r_d) lies below its source's threshold, u_d
being a hash of the document. The threshold is read from a fixed-size histogram, so that the source's words reach
its target to within a document; up to four single documents per source then take or lose a copy to close the rest.

Defined results: a null text has size 0; null is a source of its own, ordered last; a source without words has
target 0; documents of size 0 are taken with 0 words; equal rows (same id, source and size) are treated alike; an
empty table gives an empty result. Input columns of any other name pass through `mixed` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.llm.common import WORD, partitions, ranked, unit_hash, written

WEIGHTS = (5.0, 2.0, 1.0)
#: No document and no source is taken more often than this.
CAP = 3
#: Bins of the rounding histogram, by source.
BINS = 1 << 14
#: Single documents that may change by one copy to close a source's residual.
FIXES = 4
NEWTON_STEPS, TOLERANCE = 60, 1e-7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> with target: share * all words by weight, none above cap times its own words."""
    order = [F.col("source").asc_nulls_last()]
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    known = written(
        ranked(sources, order, "mix-order", "_i").select("source", "source_size", F.element_at(pattern, (F.col("_i") % len(weights) + 1).cast("int")).alias("_w")),
        "mix-sources",
    )
    limit = F.col("source_size") * F.lit(float(cap))
    whole = known.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level = 0.0
    while True:  # each round caps at least one more source
        x = known.agg(
            F.sum(F.when(F.col("_w") * level > limit, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(F.col("_w") * level > limit, 0.0).otherwise(F.col("_w"))).alias("open"),
        ).first()
        if not x["open"] or (new := (whole * share - x["held"]) / x["open"]) <= level:
            break
        level = new
    return known.select("source", "source_size", F.least(F.col("_w") * F.lit(level), limit).alias("target"))


def _rate(size: Column, lam: Column, scale: Column, cap: int) -> Column:
    return F.when(lam * size / scale >= F.lit(math.log(cap)), F.lit(float(cap))).otherwise(F.exp(F.greatest(F.least(lam * size / scale, F.lit(2.0)), F.lit(-700.0))))


def solve(groups: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Newton's method on the dual: (source, size, n) and targets -> targets with _lam and _scale."""
    hist = written(groups.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    # sums of doubles depend on their order, and a last bit may decide whether a step is taken: sum decimals instead
    exact = lambda x: F.sum(x.cast("decimal(38,12)")).cast("double")
    scales = hist.groupBy("source").agg((exact(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("_scale"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    full = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))
    state = (
        targets.join(scales.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("source", "source_size", "target", F.coalesce("_scale", F.lit(1.0)).alias("_scale"), F.when(full & (F.col("source_size") > 0), 1e12).otherwise(0.0).alias("_lam"), (full | (F.col("source_size") == 0)).alias("_done"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"))
    )
    state = written(state, "mix-dual")
    for _ in range(NEWTON_STEPS):
        joined = hist.join(state.where("not _done").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        rate = _rate(F.col("size"), F.col("_lam"), F.col("_scale"), cap)
        words = F.col("size") * F.col("n") * rate
        sums = joined.groupBy("source").agg(exact(words).alias("_g"), exact(F.when(rate < cap, words * F.col("size") / F.col("_scale")).otherwise(0.0)).alias("_h")).withColumnRenamed("source", "_s")
        short = F.col("_g") < F.col("target")
        lo, hi = F.when(short, F.col("_lam")).otherwise(F.col("_lo")), F.when(short, F.col("_hi")).otherwise(F.col("_lam"))
        step = F.col("_lam") + (F.col("target") - F.col("_g")) / F.when(F.col("_h") > 0, F.col("_h"))
        wide = F.when(short, F.greatest(F.col("_lam") * 2, F.lit(1.0))).otherwise(F.least(F.col("_lam") * 2, F.lit(-1.0)))
        inside = step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi)) & (F.abs(step - F.col("_lam")) < 4 + F.abs(F.col("_lam")))
        half = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(wide)
        met = F.abs(F.col("_g") - F.col("target")) <= F.col("target") * TOLERANCE
        new = F.when(F.col("_done") | F.col("_g").isNull() | met, F.col("_lam")).otherwise(F.when(inside, step).otherwise(half))
        state = written(
            state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "_scale", new.alias("_lam"), (F.col("_done") | F.coalesce(met, F.lit(True))).alias("_done"), F.when(F.col("_done"), F.col("_lo")).otherwise(lo).alias("_lo"), F.when(F.col("_done"), F.col("_hi")).otherwise(hi).alias("_hi")),
            "mix-dual",
        )
        if state.where("not _done").isEmpty():
            break
    else:
        raise RuntimeError(f"rates have not met their targets in {NEWTON_STEPS} steps")
    return state.select("source", "source_size", "target", "_lam", "_scale")


def _base(size: Column, ident: Column, cap: int) -> tuple[Column, Column]:
    """Sure copies, and the bin of u - frac(rate) among BINS (null if no copy may be added)."""
    rate = _rate(size, F.col("_lam"), F.col("_scale"), cap)
    sure = F.floor(rate).cast("long")
    place = F.floor((unit_hash(ident, size) - (rate - sure) + 1) / 2 * BINS).cast("int")
    return sure, F.when((sure < cap) & (size > 0), place)


def plan(docs: DataFrame, ident="doc_id", text="text", source="source", weights=WEIGHTS, share: float = 1.0, cap: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, settings by source, fixes): all that rounding a row needs.

    groups: (doc_id, source, size, n) for each kind of row. settings: (source, source_size, target, _lam, _scale,
    _edge). fixes: (source, doc_id, size, delta), at most FIXES per source.
    """
    groups = written(docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-groups")
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = solve(groups, source_targets(sources, weights, share, cap), cap)
    sure, place = _base(F.col("size"), F.col("doc_id"), cap)
    rated = groups.join(solved.select(F.col("source").alias("_s"), "target", "_lam", "_scale"), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "n", sure.alias("sure"), place.alias("place"))
    rated = written(rated, "mix-rated")
    words = F.col("size") * F.col("n")
    binned = rated.groupBy("source", "place").agg(F.sum(words).alias("w"), F.sum(words * F.col("sure")).alias("sure_w"))
    totals = binned.groupBy("source").agg(F.sum("sure_w").alias("_sure")).select(F.col("source").alias("_s"), "_sure")
    running = F.sum("w").over(Window.partitionBy("source").orderBy("place"))  # at most BINS rows by source
    edges = (
        binned.where("place is not null").withColumn("_run", running)
        .join(solved.select(F.col("source").alias("_t"), "target"), F.col("source").eqNullSafe(F.col("_t")))
        .join(totals, F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("_run") + F.col("_sure") <= F.col("target"))
        .groupBy("source").agg(F.max("place").alias("_edge"), F.max(F.col("_run")).alias("_add"))
        .select(F.col("source").alias("_e"), "_edge", "_add")
    )
    settings = written(
        solved.join(totals, F.col("source").eqNullSafe(F.col("_s")), "left").join(edges, F.col("source").eqNullSafe(F.col("_e")), "left")
        .select("source", "source_size", "target", "_lam", "_scale", F.coalesce("_edge", F.lit(-1)).alias("_edge"), (F.col("target") - F.coalesce("_sure", F.lit(0)) - F.coalesce("_add", F.lit(0))).alias("_rest")),
        "mix-settings",
    )
    fixes = groups.limit(0).select("source", "doc_id", "size", F.lit(0).cast("long").alias("delta"))
    rest = settings.select(F.col("source").alias("_s"), "_edge", "_rest")
    for _ in range(FIXES):
        done = fixes.select(F.col("source").alias("_fs"), F.col("doc_id").alias("_fd"), F.col("size").alias("_fz"))
        taken = F.col("sure") + F.when(F.col("place") <= F.col("_edge"), 1).otherwise(0)
        delta = F.when(F.col("_rest") > 0, 1).otherwise(-1)
        left = F.abs(F.col("_rest") - delta * words)
        moves = (
            rated.where("size > 0").join(rest, F.col("source").eqNullSafe(F.col("_s")))
            .where((taken + delta >= 0) & (taken + delta <= cap) & (left < F.abs("_rest")))
            .join(done, F.col("source").eqNullSafe(F.col("_fs")) & F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("size") == F.col("_fz")), "left_anti")
            .groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col("doc_id"), F.col("size"), F.col("n"), delta.cast("long").alias("delta"))).alias("m"))
        )
        moves = written(moves.select("source", "m.*"), "mix-moves")
        fixes = fixes.unionByName(moves.select("source", "doc_id", "size", "delta"))
        moved = moves.select(F.col("source").alias("_ms"), (F.col("delta") * F.col("size") * F.col("n")).alias("_moved"))
        rest = rest.join(moved, F.col("_s").eqNullSafe(F.col("_ms")), "left").select("_s", "_edge", (F.col("_rest") - F.coalesce("_moved", F.lit(0))).alias("_rest"))
    return groups, settings, written(fixes, "mix-fixes")


def _copies(rows: DataFrame, settings: DataFrame, fixes: DataFrame, cap: int) -> DataFrame:
    """rows (with doc_id, source, size) -> with source_size, target and copies."""
    sure, place = _base(F.col("size"), F.col("doc_id"), cap)
    changed = fixes.select(F.col("source").alias("_fs"), F.col("doc_id").alias("_fd"), F.col("size").alias("_fz"), "delta")
    return (
        rows.join(settings.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .join(changed, F.col("source").eqNullSafe(F.col("_fs")) & F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("size") == F.col("_fz")), "left")
        .withColumn("copies", sure + F.when(place <= F.col("_edge"), 1).otherwise(0) + F.coalesce("delta", F.lit(0)))
    )


def mix_plan(docs: DataFrame, cap: int = CAP, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    groups, settings, fixes = plan(docs, cap=cap, **how)
    out = _copies(groups, settings, fixes, cap).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


def mixed(docs: DataFrame, ident="doc_id", text="text", source="source", cap: int = CAP, **how) -> DataFrame:
    """The mix itself: docs with each row repeated as often as the plan takes it, and docs' own columns."""
    _, settings, fixes = plan(docs, ident, text, source, cap=cap, **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(ident).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    out = _copies(rows, settings, fixes, cap).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_k")).select("_row.*")
