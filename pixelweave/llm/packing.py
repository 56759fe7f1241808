"""Best-fit packing by the linear grouping scheme.

A document's ids, an end id included, are cut into pieces of at most `capacity`. How pieces are packed depends on
their lengths alone, so the plan is made from the histogram of lengths (one number per length, however large the
corpus) and says where the r-th piece of each length goes:

1. large pieces, in order of length, form groups of equal cardinality; each counts as its group's longest;
2. few sizes remain: column generation finds the best mix of configurations of these sizes (a linear programme whose
   columns are priced by a knapsack), rounded down;
3. actual pieces take the places of their groups in the configurations, so gaps get their true widths;
4. what rounding left over, and all small pieces, go best-fit into the gaps, longest first, new sequences being opened
   as the remaining words ask for them.

Ranks within a length come from counts by task, never from one task that sees them all.

Defined results: a null or empty text is one piece with the end id only; equal rows are pieces of their own; an empty
table gives no pieces. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.llm.common import tidy, written
from pixelweave.llm.tokens import ids_crc32, tokenizer, vocabulary_path

CAPACITY, END_ID = 2048, 0
#: Groups of large pieces; pieces up to capacity / SMALL_PART are small.
GROUPS, SMALL_PART = 96, 3
#: Relative gain of a configuration below which the search for better ones ends.
GAP = 3e-4
#: Segments (40 bytes each) up to which a plan is broadcast.
BROADCAST_SEGMENTS = 500_000

Segment = tuple[int, int, int, int, int]  # length, first rank, pieces, first sequence, place in each sequence


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Column generation for the cutting-stock relaxation: (configuration, how often)."""
    m = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    deepest, every = int(capacity // s.min()), np.arange(capacity + 1)
    for _ in range(8 * m):
        duals = np.linalg.solve(basis.T, np.ones(m))
        best, takes = np.zeros(capacity + 1), []
        for _ in range(deepest):  # knapsack: one more piece in each round
            value = np.full((m, capacity + 1), -1.0)
            for i in range(m):
                value[i, s[i] :] = best[: capacity + 1 - s[i]] + duals[i]
            take = value.argmax(0)
            more = value[take, every]
            gain = more > best + 1e-12
            takes.append(np.where(gain, take, -1))
            best = np.where(gain, more, best)
        if best[capacity] <= 1 + GAP:
            break
        column, w = np.zeros(m), capacity
        for take in reversed(takes):
            if take[w] >= 0:
                column[take[w]] += 1
                w -= s[take[w]]
        x, step = np.linalg.solve(basis, d), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, d)
    return [([int(round(v)) for v in basis[:, j]], float(x[j])) for j in range(m)]


class _Items:
    """Pieces of a group in order, as runs of (length, first rank, number)."""

    def __init__(self, runs: list[list[int]]):
        self.runs, self.k = runs, 0

    def take(self, n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            run = self.runs[self.k]
            now = min(n, run[2])
            if now:
                got.append((run[0], run[1], now))
            run[1] += now
            run[2] -= now
            n -= now
            self.k += not run[2]
        return got


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Segment], int]:
    """counts: pieces by length -> segments that place every piece, and the number of sequences."""
    plan: list[Segment] = []
    gaps: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by gap: [first sequence, sequences]
    after = counts.get(capacity, 0)
    if after:
        plan.append((capacity, 0, after, 0, 0))
    left = {n: [[0, c]] for n, c in counts.items() if 0 < n < capacity and c}
    large = sorted(n for n in left if n > capacity // SMALL_PART)
    total = sum(counts[n] for n in large)
    m = min(GROUPS, total)
    if m:
        runs, groups, at, g = [[n, 0, counts[n]] for n in large], [], 0, 0
        for g in range(m):
            need, mine = total * (g + 1) // m - at, []
            at += need
            while need:
                run = runs[0]
                now = min(need, run[2])
                mine.append([run[0], run[1], now])
                run[1] += now
                run[2] -= now
                need -= now
                if not run[2]:
                    runs.pop(0)
            groups.append(mine)
        merged: dict[int, list[list[int]]] = {}
        for mine in groups:
            merged.setdefault(mine[-1][0], []).extend(mine)
        sizes = sorted(merged)
        items = [_Items(merged[s]) for s in sizes]
        for config, often in configurations(sizes, [sum(r[2] for r in merged[s]) for s in sizes], capacity):
            bins = int(often + 1e-9)
            bins = min([bins, *(sum(r[2] for r in items[g].runs) // a for g, a in enumerate(config) if a)])
            if bins <= 0:
                continue
            slots = [items[g].take(bins) for g, a in enumerate(config) for _ in range(a)]
            cuts = {0, bins}
            for slot in slots:
                place = 0
                for _, _, n in slot:
                    place += n
                    cuts.add(place)
            cuts = sorted(cuts)
            heads = [[0, 0] for _ in slots]  # run, pieces of it already placed
            for a, b in zip(cuts, cuts[1:]):
                used = 0
                for slot, head in zip(slots, heads):
                    n, rank, number = slot[head[0]]
                    plan.append((n, rank + head[1], b - a, after + a, used))
                    used += n
                    head[1] += b - a
                    if head[1] == number:
                        head[:] = [head[0] + 1, 0]
                gaps[capacity - used].append([after + a, b - a])
            after += bins
        for n in large:
            left[n] = []
        for it in items:
            for n, rank, number in it.runs:
                if number:
                    left[n].append([rank, number])
    open_words = sum(n * c for n, rs in left.items() for _, c in rs)
    for n in sorted(left, reverse=True):
        for rank, number in left[n]:
            gap = n
            while number:
                while gap <= capacity and not gaps[gap]:
                    gap += 1
                if gap > capacity:
                    new = max(1, -(-min(open_words, n * number) // capacity))
                    gaps[capacity].append([after, new])
                    after += new
                    gap = n
                    continue
                each = gap // n
                first, bins = gaps[gap].pop()
                full = min(bins, number // each)
                rest = 0 if full else number  # fewer than fill one sequence
                done = full or 1
                for j in range(each if full else rest):
                    plan.append((n, rank, done, first, capacity - gap + j * n))
                    rank += done
                    number -= done
                    open_words -= n * done
                gaps[gap - n * (each if full else rest)].append([first, done])
                if bins > done:
                    gaps[gap].append([first + done, bins - done])
                gap = n
    return plan, after


def pieces(docs: DataFrame, capacity: int, path: str, end: int, ident="doc_id", text="text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _task, _rank (of its length within the task), and ids if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            every, number = tok.ended([t or "" for t in b.column(1).to_pylist()], end)
            for name, n, until in zip(b.column(0).to_pylist(), number.tolist(), np.cumsum(number).tolist()):
                ids = every[until - n : until]
                at, piece = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if not at else capacity
                    part = ids[at : at + length]
                    rows.append((name, piece, at, length, ids_crc32(part), int(seen[length]), part.astype(np.int32) if with_ids else None))
                    seen[length] += 1
                    at += length
                    piece += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            out = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array([task] * len(rows), pa.int32())]
            if with_ids:
                out.append(pa.array(cols[6], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_task", "ids"][: len(out)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _rank long, _task int" + ", ids array<int>" * with_ids
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END_ID, ident="doc_id", text="text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, vocabulary or vocabulary_path(), end, ident, text, with_ids), "pack-pieces", rows=500)
    by_task = cut.groupBy("_task", "length").agg(F.count("*").alias("n"))
    # one row by task and length, summed up by length: at most as many rows as tasks
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(by_task.select("_task", "length", "n", F.coalesce(before, F.lit(0)).alias("_base")), "pack-ranks")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # up to capacity rows
    plan, _ = plan_sequences(counts, capacity)
    schema = "_length long, _first long, _n long, _sequence long, _at long"
    placed = spark.createDataFrame(plan, schema).coalesce(1) if plan else spark.createDataFrame([], schema)
    if len(plan) <= BROADCAST_SEGMENTS:  # the plan's size follows capacity and GROUPS, and hardly the corpus
        placed = F.broadcast(placed)
    rank = F.col("_rank") + F.col("_base")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return (
        cut.join(bases.drop("n").hint("merge"), ["_task", "length"])  # bases grow with the tasks: not to be broadcast
        .withColumn("_r", rank)
        .join(placed, (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_first") + F.col("_n")))
        .select(*keep, (F.col("_sequence") + F.col("_r") - F.col("_first")).alias("sequence_id"), F.col("_at").alias("offset"), *["ids"] * with_ids)
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(..., with_ids=True): sequence_id, tokens (at most capacity of them)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("tokens"))
