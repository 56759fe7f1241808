"""Language identification by cross-parsing entropy.

For each labelled language, however rare, texts are sampled, a bounded number of rows, and pieces from all over each of
them are joined into one reference text, whose suffix automaton is built. A text is parsed against a reference by taking,
again and again, the longest match that starts at the current letter; the number of phrases, times the logarithm of the
reference's length, over the number of letters, estimates the cross entropy. The language with the fewest normalised
phrases wins; of equals, the one first in code-point order.

Texts are lower-cased and reduced to words, which are runs of letters set off by spaces; a match may pass from word to
word. Whole texts are parsed, in segments of SEGMENT letters, where a new phrase starts; all segments of a batch go
through the automaton side by side, as one array. Workers hold the automata of at most GROUP languages; documents pass by
each group of languages in turn, and take along the best language so far and the sum that their score needs.

Defined results: a null text, or one without letters, is `und` with score 0; nulls and labels that say `und` teach
nothing; without any labelled text all are `und`; equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.llm.common import finished, id_crc, tidy, unit_hash, worker_cache, written
from pixelweave.llm.tokens import PairRanks

UNKNOWN = "und"
#: Labelled rows sampled by language, letters taken from each (all are used), and languages learned at a time, at most.
TEXTS, TEXT_LETTERS, GROUP = 60, 800, 12
#: Pieces of a long text, spread evenly over it, that are learned from.
PIECES = 10
#: Letters of a segment, segments parsed side by side, and entries up to which an automaton is a plain table.
SEGMENT, SIDE_BY_SIDE, DENSE = 1024, 2048, 1 << 23
LETTERS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """States of all substrings of a text; walking from the root follows a match as long as it lasts."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            self.next.append({})
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    self.next.append(dict(self.next[q]))
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, text: str) -> int:
        """Longest matches that make up the text, from left to right; a letter that never occurs is one of its own."""
        count, state, step = 0, 0, self.next
        for c in text:
            to = step[state].get(c)
            if to is None:
                count += state != 0
                to = step[0].get(c)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state != 0)


class Parser:
    """A reference's automaton as arrays: (state, letter) -> next state, with OPEN set if a phrase ended before it."""

    OPEN = np.uint32(1 << 31)

    def __init__(self, text: str):
        step = SuffixAutomaton(text).next
        letters = sorted(set(text))
        self.code = np.zeros(0x110000, np.uint16)  # 0: a letter that the reference lacks
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        to = [(s, int(self.code[ord(c)]), t) for s, mine in enumerate(step) for c, t in mine.items()]
        state, letter, target = np.array(to, np.int64).reshape(-1, 3).T
        self.root = np.zeros(self.width, np.uint32)
        self.root[letter[state == 0]] = target[state == 0]
        self.table = None
        if len(step) * self.width <= DENSE:
            self.table = np.tile(self.root | self.OPEN, (len(step), 1))
            self.table[0] = self.root
            self.table[state, letter] = target
            self.table = self.table.ravel()
        else:  # many letters: only the transitions that exist
            self.known, self.target = PairRanks(state, letter), target.astype(np.uint32)

    def phrases(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each range of letters (code points). A letter that the reference lacks is one of its own."""
        out = np.zeros(len(start), np.int64)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), SIDE_BY_SIDE):
            some = order[at : at + SIDE_BY_SIDE]
            first, n = start[some], size[some]
            longest = int(n[0])
            place = np.minimum(first + np.arange(longest)[:, None], len(letters) - 1)
            codes = self.code[letters[place]]
            inside = np.arange(longest)[:, None] < n
            count = ((codes == 0) & inside).sum(0)
            active = inside.sum(1).tolist()
            state = np.zeros(len(some), np.uint32)
            for c, k in zip(codes, active):
                c, mine = c[:k], state[:k]
                if self.table is not None:
                    new = self.table[mine.astype(np.int64) * self.width + c]
                else:
                    rank = self.known.find(mine, c)
                    found = rank < PairRanks.NONE
                    new = np.where(found, self.target[np.where(found, rank, 0)], self.root[c] | np.where(mine > 0, self.OPEN, np.uint32(0)))
                count[:k] += new >> np.uint32(31)
                state[:k] = new & ~self.OPEN
            out[some] = count + (state != 0)
        return out


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def sampled(text: str) -> str:
    """At most TEXT_LETTERS letters and spaces: PIECES runs of words, spread over the whole text where it is longer."""
    words = words_of(text)
    whole = " ".join(words)
    if len(whole) <= TEXT_LETTERS:
        return whole
    size = TEXT_LETTERS // PIECES
    starts = (k * (len(whole) - size) // (PIECES - 1) for k in range(PIECES))
    return " ".join(whole[a : a + size - 1] for a in starts)


def references(docs: DataFrame, learn: Column | None, ident: str, text: str, lang: str) -> DataFrame:
    """(lang, texts): at most TEXTS sampled texts of every language, for its reference."""
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    # a letter at least: what has none teaches nothing, and must not take the place of what has
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    share = rows.groupBy("lang").agg((2.0 * TEXTS / F.count("*")).alias("_share"))
    # about twice as many as are used, and the bound is kept exactly; a row by language, written so that its size is known:
    # Spark broadcasts it while it is small, and texts stay put
    some = rows.join(written(share, "langid-shares"), "lang").where(unit_hash(F.lit(5), F.col("doc_id")) < F.col("_share"))
    order = Window.partitionBy("lang").orderBy(unit_hash(F.lit(6), F.col("doc_id"), F.col("text")), F.col("doc_id").cast("string"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sampled(t) for t in b.column(1).to_pylist()], pa.string()), b.column(2)], names=["lang", "text", "o"])

    first = some.withColumn("o", F.row_number().over(order)).where(F.col("o") <= TEXTS).select("lang", "text", "o")
    short = first.mapInArrow(tidy(shorten), "lang string, text string, o int")
    return written(short.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("o", "text"))).alias("t")).select("lang", F.col("t.text").alias("texts")), "langid-references", rows=500)


def identify(docs: DataFrame, learn: Column | None = None, ident="doc_id", text="text", lang="lang") -> DataFrame:
    """doc_id, lang_pred, score, phrases (of the language chosen), letters, for every row of docs."""
    learned = references(docs, learn, ident, text, lang)
    names = sorted(r["lang"] for r in learned.select("lang").collect())
    none = [F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("least"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("phrases"), F.lit(0).cast("long").alias("letters")]
    state = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), *none)
    for at in range(0, max(1, len(names)), GROUP):
        before = state if at else None
        mine = names[at : at + GROUP]
        texts = {r["lang"]: r["texts"] for r in learned.where(F.col("lang").isin(mine)).collect()} if mine else {}
        state = parsed(state, {k: " " + " ".join(dict.fromkeys(texts[k])) + " " for k in mine})
        if at + GROUP < len(names):
            state = written(state, "langid-state", rows=500)
            if before is not None:
                finished(before)
    known = F.col("lang_pred").isNotNull()
    out = state.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, 1 / F.col("total")).otherwise(0.0).alias("score"), "phrases", "letters")
    return written(out, "langid-found", rows=500)


def parsed(state: DataFrame, known: dict[str, str]) -> DataFrame:
    """state (doc_id, text, lang_pred, least, total, phrases, letters) after the languages of known (name -> reference)."""
    names = list(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, key = worker_cache("langid"), hash(tuple(known.values()))
        if key not in cache:
            cache.clear()
            cache[key] = [Parser(known[k]) for k in names]
        parsers = cache[key]
        logs = np.log2([len(known[k]) + 1 for k in names])
        for b in batches:
            texts = [f" {' '.join(words)} " if t and (words := words_of(t)) else "" for t in b.column("text").to_pylist()]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            # the segments of each text
            number = -(-size // SEGMENT)
            turn = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            start = np.repeat(np.cumsum(size) - size, number) + turn * SEGMENT
            each = np.minimum(SEGMENT, np.repeat(size, number) - turn * SEGMENT)
            owner = np.repeat(np.arange(len(texts)), number)
            counts = np.stack([np.bincount(owner, p.phrases(letters, start, each), len(texts)).astype(np.int64) for p in parsers], 1) if parsers else np.zeros((len(texts), 0), np.int64)
            preds, least, total, phrases = (b.column(c).to_pylist() for c in ("lang_pred", "least", "total", "phrases"))
            for i, n in enumerate(size.tolist()):
                if not n or not names:
                    continue
                h = counts[i] * logs / n
                k = int(h.argmin())
                if preds[i] is None or h[k] < least[i]:
                    total[i] *= 0.0 if preds[i] is None else float(np.exp2(-(least[i] - h[k]) * 4))
                    preds[i], least[i], phrases[i] = names[k], float(h[k]), int(counts[i, k])
                total[i] += float(np.exp2(-(h - least[i]) * 4).sum())
            columns = [b.column("doc_id"), b.column("text"), pa.array(preds, pa.string()), pa.array(least, pa.float64()), pa.array(total, pa.float64()), pa.array(phrases, pa.int64()), pa.array(size)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "lang_pred", "least", "total", "phrases", "letters"])

    return state.mapInArrow(tidy(run), "doc_id long, text string, lang_pred string, least double, total double, phrases long, letters long")


def learnable() -> Column:
    """The rows that the query may learn from."""
    return id_crc("doc_id") % 3 != 1
