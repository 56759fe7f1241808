"""Quality rules: repetition and size rules, then tokeniser fertility against bands per language or script.

Two public vocabularies are asked about every whole text: the byte-level one gives characters per token, the share of
tokens that are mere fragments of a character, and the entropy of its tokens (over the most that so many tokens can
have); the piece vocabulary gives the share of tokens that are byte fallbacks, which stand for the characters it
lacks. Over all documents that pass the rules, the quartiles of each measure are taken per language, or per script
where a document names no language; a document is rejected if a measure lies further from the quartiles than REACH
times their distance plus a fixed slack. Quartiles come from histograms of fixed bins, so they are the same for any
partitioning.

Every document is judged, at every size of its group: the quartiles are of a language's n documents and LEAST more that
are spread as those of its script, whose quartiles in turn are of its own and LEAST more spread as the whole corpus. So
a small group's bounds are those of its script, and move to its own as it grows, without a step at any size.

Defined results: null and empty texts have counts 0 and fail the rules; equal rows get equal verdicts; an empty table
gives an empty result. Words are separated by ASCII white space only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.llm.common import tidy, worker_cache, written
from pixelweave.llm.tokens import byte_spelling, tokenizer, vocabulary_path

PIECES = "piece_bpe_32k.model"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
WORDS_REMEMBERED = 300_000
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "fragment_share", "fallback_share", "token_entropy")
#: Bins per unit of a measure, quartile distances and slack that a measure may lie outside the quartiles; documents that
#: a group's wider one counts for.
STEPS, REACH, SLACK, LEAST = 500, 2.5, (0.06, 0.05, 0.02, 0.1), 50
# fixed values: scripts by ranges of code points
SCRIPTS = ((0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0E00, 0x0E7F, "Thai"), (0x3040, 0x30FF, "Kana"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"))


def script_of(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "Latin"
    count: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            name = next((s for a, b, s in SCRIPTS if a <= ord(c) <= b), "other")
            count[name] = count.get(name, 0) + text.count(c)
    return max(sorted(count), key=count.get, default="other")


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    z = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key = key * np.uint64(0xD6E8FEB86659FD93) + z[j : j + n]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if not all((codes[a + j] == codes[b + j]).all() for j in range(WINDOW)):  # keys of different windows agree
        _, inverse, number = np.unique(np.lib.stride_tricks.sliding_window_view(codes, WINDOW), axis=0, return_inverse=True, return_counts=True)
        a = b = np.flatnonzero(number[inverse.ravel()] > 1)
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.unique(np.concatenate([a, b]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            if line in seen:
                dup += 1
            seen.add(line)
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), dup, repeated_words(codes)


class Vocabularies:
    """Measures of a text under the byte-level and the piece vocabulary."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece

        self.tok = tokenizer(bytes_path)
        self.fragment = np.zeros(self.tok.size, bool)
        spelt = {chr(b): b for b in range(256)} | {c: b for b, c in byte_spelling().items()}
        for token, k in self.tok.tok.get_vocab().items():
            try:
                bytes(spelt[c] for c in token).decode("utf-8")
            except UnicodeDecodeError:
                self.fragment[k] = True
            except KeyError:
                pass
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.is_byte = np.fromiter(map(self.pieces.is_byte, range(len(names))), bool, len(names))
        # a text of single spaces is made of its words, if no piece holds a space within
        self.by_word = not any("\u2581" in p.lstrip("\u2581") for p in names)
        self.known: dict[str, tuple[int, int]] = {}

    def counted(self, texts: list[str]) -> np.ndarray:
        """Tokens, and byte fallbacks among them, of each text under the piece vocabulary, by the library."""
        ids = self.pieces.encode(texts, num_threads=1)
        number = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.cumsum(number)
        missing = np.concatenate([[0], np.cumsum(self.is_byte[np.fromiter(chain.from_iterable(ids), np.int32, int(number.sum()))])])
        return np.stack([number, missing[ends] - missing[ends - number]], 1)

    def fallbacks(self, texts: list[str]) -> np.ndarray:
        """As counted: words that a worker has seen are remembered, and texts go whole where words are not set off plainly."""
        out = np.zeros((len(texts), 2), np.int64)
        plain = [k for k, t in enumerate(texts) if self.by_word and t and t[0] != " " and t[-1] != " " and "  " not in t and "\u2581" not in t]
        rest = sorted({k for k, t in enumerate(texts) if t}.difference(plain))
        if rest:
            out[rest] = self.counted([texts[k] for k in rest])
        if plain:
            lists = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
            words = lists.flatten().dictionary_encode()
            if len(self.known) > WORDS_REMEMBERED:
                self.known.clear()
            names = words.dictionary.to_pylist()
            new = [w for w in names if w not in self.known]
            mine = dict(zip(new, map(tuple, self.counted(new).tolist()))) if new else {}
            self.known.update((w, c) for w, c in mine.items() if len(w) <= 64)
            each = np.array([mine.get(w) or self.known[w] for w in names], np.int64).reshape(len(names), 2)
            sums = np.concatenate([[[0, 0]], np.cumsum(each[words.indices.to_numpy()], 0)])
            at = lists.offsets.to_numpy()
            out[plain] = sums[at[1:]] - sums[at[:-1]]
        return out

    def measure(self, texts: list[str]) -> list[list[float]]:
        every, number = self.tok.flat(texts)
        fallback = self.fallbacks(texts)
        out = []
        for text, n, end, (tokens, missing) in zip(texts, number.tolist(), np.cumsum(number).tolist(), fallback.tolist()):
            ids = every[end - n : end]
            if not n:
                out.append([0.0] * len(MEASURES))
                continue
            if n > 2000:
                count = np.bincount(ids)
                count = count[count > 0]
            else:
                s = np.sort(ids)
                count = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
            entropy = np.log2(n) - float((count * np.log2(count)).sum()) / n
            most = np.log2(min(n, self.tok.size))
            out.append([len(text) / n, float(self.fragment[ids].mean()), missing / tokens if tokens else 0.0, entropy / most if most else 0.0])
        return out


def measured(docs: DataFrame, bytes_path: str, pieces_path: str, ident: str, text: str, lang: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("tokens")
        if ("vocabularies", bytes_path, pieces_path) not in cache:
            cache["vocabularies", bytes_path, pieces_path] = Vocabularies(bytes_path, pieces_path)
        both = cache["vocabularies", bytes_path, pieces_path]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_counts(t) for t in texts]
            x = both.measure(texts)
            script = [script_of(t) for t in texts]
            group = [k if k is not None else "script " + of for k, of in zip(b.column(2).to_pylist(), script)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in zip(*base)], pa.array(group, pa.string()), pa.array(script, pa.string()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "group", "script", "x"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, group string, script string, x array<double>"
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(tidy(run), schema)


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ruled(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """doc_id, the rules' counts and base_failed, for every row of docs: as judge gives them, without what only its bands need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = np.array([base_counts(t or "") for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in base.T]], names=["doc_id", *COUNTS])

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return written(rows.withColumn("base_failed", failed()), "fertility-base", rows=500)


def bands(rows: DataFrame) -> DataFrame:
    """(group, script, lo, hi): arrays of bounds by measure, for each language (or script) and script of its documents."""
    bins = rows.select("group", "script", F.posexplode("x").alias("m", "v")).groupBy("group", "script", "m", F.floor(F.col("v") * STEPS).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    bins = written(bins, "fertility-bins")
    share = lambda t, *by: t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "m")))  # noqa: E731 - at most as many rows as bins
    # each wider one's shares count as LEAST documents: the corpus for a script, and that for a language
    corpus = share(bins.groupBy("m", "bin").agg(F.sum("n").alias("n")), "m")
    scripts = bins.select("script", "m").distinct()
    own = bins.groupBy("script", "m", "bin").agg(F.sum("n").alias("n"))
    own = own.unionAll(scripts.join(corpus, "m").select("script", "m", "bin", F.col("p") * LEAST)).groupBy("script", "m", "bin").agg(F.sum("n").alias("n"))
    own = share(own, "script")
    pairs = bins.select("group", "script").distinct()
    # a language in two scripts has its own counts in both, and each script's prior
    mine = bins.groupBy("group", "m", "bin").agg(F.sum("n").alias("n")).join(pairs, "group").select("group", "script", "m", "bin", "n")
    prior = pairs.join(own, "script").select("group", "script", "m", "bin", F.col("p") * LEAST)
    bins = mine.unionAll(prior).groupBy("group", "script", "m", "bin").agg(F.sum("n").alias("n"))
    all_of = Window.partitionBy("group", "script", "m")
    running = bins.withColumn("_run", F.sum("n").over(all_of.orderBy("bin"))).withColumn("_all", F.sum("n").over(all_of))
    at = lambda share: F.min(F.when(F.col("_run") >= F.col("_all") * share - 1e-6, F.col("bin"))) / STEPS
    quartiles = running.groupBy("group", "script", "m").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    slack = F.element_at(F.array(*[F.lit(s) for s in SLACK]), F.col("m") + 1)
    wide = (F.col("q3") - F.col("q1")) * REACH + slack
    both = quartiles.select("group", "script", "m", (F.col("q1") - wide).alias("lo"), (F.col("q3") + wide).alias("hi"))
    ordered = F.sort_array(F.collect_list(F.struct("m", "lo", "hi")))
    return both.groupBy("group", "script").agg(ordered.alias("b")).select("group", "script", F.transform("b", lambda s: s["lo"]).alias("lo"), F.transform("b", lambda s: s["hi"]).alias("hi"))


def judge(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, ident="doc_id", text="text", lang="lang") -> DataFrame:
    """doc_id, the rules' counts, base_failed, kept, and the measures, for every row of docs."""
    rows = measured(docs, bytes_path or vocabulary_path(), pieces_path or vocabulary_path(PIECES), ident, text, lang)
    rows = written(rows.withColumn("base_failed", failed()), "fertility-measures", rows=500)
    limits = written(bands(rows.where("not base_failed")), "fertility-bands")
    inside = F.forall(F.arrays_zip("x", "lo", "hi"), lambda s: (s["x"] >= s["lo"]) & (s["x"] <= s["hi"]))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return rows.join(limits, ["group", "script"], "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *[F.col("x")[k].alias(m) for k, m in enumerate(MEASURES)])
