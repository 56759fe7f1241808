"""Token-ID / binary output: corpora as files of ids under a static range asymmetric numeral system.

write_token_files tokenises every whole text, adds an end id, counts all ids of the corpus into one shared frequency
table, and writes frames (see rans.py) in ascending doc_id order: documents are dealt by range of doc_id, and a file's
rows are frames of about FRAME ids, each with whole documents. Parquet carries the frames, so any store that Spark
reaches will do. read_token_files decodes frames independently of one another. Rows of one doc_id, or without any, lie
in one range, in the order of their ids.

Defined results: a null text is encoded as empty (its end id alone); null doc_ids come first; equal doc_ids stay
adjacent, each row on its own; an empty table gives files without frames. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import batches_of, partitions, tidy, written
from pixelweave.llm.rans import Coder, frequency_table
from pixelweave.llm.tokens import ids_crc32, tokenizer, vocabulary_path

END_ID = 2
#: Ids gathered before a frame is closed; a frame ends with a document, so a longer one makes a longer frame.
FRAME = 1 << 20


def encoded(docs: DataFrame, path: str, end: int, ident="doc_id", text="text") -> DataFrame:
    """(doc_id, n, ids, counts): ids as bytes of the vocabulary's width, the end id included; and in one row by task,
    which has no ids, how often each id occurs in the task's rows, as pairs of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        total = np.zeros(max(tok.size, end + 1), np.int64)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        row = lambda *columns: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "n", "ids", "counts"])
        for b in batches:
            ids, number = tok.ended([t or "" for t in b.column(1).to_pylist()], end)
            total += np.bincount(ids, minlength=len(total))
            offsets = np.concatenate([[0], np.cumsum(number) * tok.dtype.itemsize]).astype(np.int32)
            yield row(b.column(0), number, pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]), [None] * len(number))
        some = np.flatnonzero(total)
        yield row([None], [None], [None], [np.stack([some, total[some]]).astype("<i8").tobytes()])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, n long, ids binary, counts binary")


def id_counts(counts: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the whole corpus: sums of the tasks' counts; one number per id reaches the driver."""

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                ids, number = np.frombuffer(x, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(number)], names=["id", "n"])

    rows = counts.mapInArrow(tidy(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return total


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END_ID, ident="doc_id", text="text") -> None:
    """Write path/frames and path/table."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    tok = tokenizer(vocabulary)
    size, width = max(tok.size, end + 1), tok.dtype.str
    ids = written(encoded(docs, vocabulary, end, ident, text), "token-ids", "zstd", rows=500)
    freq, bits = frequency_table(id_counts(ids.where("counts is not null").select("counts"), size))
    ids = ids.where("counts is null").select("doc_id", "n", "ids")
    spark.createDataFrame(list(enumerate(freq.astype(np.int64).tolist())), "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)  # one number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, first = Coder(shared.value, bits), TaskContext.get().partitionId(), 0
        names, lengths, held, number = [], [], [], 0

        def close() -> pa.RecordBatch:
            directory = np.array([x is None for x in names], np.uint8).tobytes() + np.array([x or 0 for x in names], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
            raw = coder.frame(directory, len(names), first, np.frombuffer(b"".join(held), width).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([first], pa.int64()), pa.array([number], pa.int64()), pa.array([raw], pa.binary())], names=["file", "first", "n", "frame"])

        for b in batches:
            for name, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                names.append(name)
                lengths.append(n)
                held.append(x)
                number += n
                if number >= FRAME:
                    yield close()
                    first += number
                    names, lengths, held, number = [], [], [], 0
        if names:
            yield close()

    dealt = ids.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "n", F.xxhash64("ids"))
    with batches_of(spark, 500):
        dealt.mapInArrow(tidy(run), "file int, first long, n long, frame binary").write.option("compression", "none").parquet(f"{path}/frames")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files at path."""
    rows = spark.read.parquet(f"{path}/table").toPandas().sort_values("id")  # one row per id of the vocabulary
    freq = rows["freq"].to_numpy().astype(np.uint64)
    bits = int(freq.sum()).bit_length() - 1
    frames = spark.read.schema("file int, first long, n long, frame binary").parquet(f"{path}/frames")
    sums = {r["file"]: r["n"] for r in frames.groupBy("file").agg(F.sum("n").alias("n")).collect()}  # one per file
    before, base = 0, {}
    for k in sorted(sums):
        base[k] = before
        before += sums[k]
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, bits)
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                directory, docs, first, ids = coder.unframe(raw)
                null = np.frombuffer(directory, np.uint8, docs)
                names, lengths = np.frombuffer(directory, "<i8", docs, docs), np.frombuffer(directory, "<i8", docs, 9 * docs)
                ends = np.cumsum(lengths)
                each = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                out = [pa.array(names, pa.int64(), mask=null.astype(bool)), pa.array(ends - lengths + first + base[file]), pa.array(lengths), pa.array([ids_crc32(x) for x in each], pa.int64())]
                if with_ids:
                    out.append(pa.array(each, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    read = frames.select("file", "frame").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return written(read, "token-read", rows=4)
