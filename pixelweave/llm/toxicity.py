"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

1. A lexicon is learned from a bounded sample of labelled texts: words, and word beginnings of four to nine letters,
   that are much likelier in toxic texts. A short fixed list of English insults is added to it.
2. Every text gets dense features in one pass: lexicon densities and log-odds, distinct hits, how near hits stand to
   the second person, shares of capitals and punctuation, and rates of obfuscated words (letters replaced by digits or
   symbols, which also are undone before the lexicon is asked).
3. Trees are grown on a second bounded sample, with labels of texts that the lexicon did not see, and calibrated by
   isotonic regression on a third.

Only sampled ids, counts of candidate terms that pass a threshold, and features of sampled rows reach the driver.

Defined results: null and empty texts have all features 0 and get a score like any other; a document whose labels
disagree counts as toxic; labels that are null are ignored; without any label of either kind the score is the share of
toxic labels, or 0 if there are none; equal rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import batches_of, id_crc, tidy, unit_hash, written
from pixelweave.llm.learning import boost, calibrated, isotonic, margins

#: Labelled rows that are sampled for the lexicon, the trees and the calibration, at most.
LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS = 8000, 16000, 6000
#: Terms of the learned lexicon, the documents that a term must be in, and its least log-odds.
TERMS, LEAST_DOCS, LEAST_ODDS = 600, 4, 1.6
#: Words between a hit and a second person that count as near.
NEAR = 8
WORDS_REMEMBERED = 200_000
# fixed values
INSULTS = "idiot idiots moron morons scum loser losers stupid trash pathetic worthless disgusting clown dumb imbecile vermin filth filthy jerk bastard".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()
SYMBOL_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
FEATURES = ("words", "odds_density", "odds_sum", "hit_density", "hits", "distinct", "strongest", "insult_density", "near_second_person", "second_person", "capitals", "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "digits")


def plain(word: str) -> str:
    """A lower-case word without punctuation at its ends."""
    return word.strip(".,;:!?\"'()[]{}|%$*&#<>-_~`…«»„“”‘’¿¡/\\")


def term_forms(word: str) -> list[str]:
    """The forms under which the lexicon may hold a word: itself, and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in range(4, 10) if len(word) >= k)] if word else []


class Lexicon:
    """Codes of words: 0 none, 1 second person, 2 obfuscated only, then terms, then terms in obfuscated form."""

    def __init__(self, odds: dict[str, float]):
        self.terms = list(odds)
        self.index = {t: k for k, t in enumerate(self.terms)}
        weight = np.array([odds[t] for t in self.terms])
        self.weight = np.concatenate([np.zeros(3), weight, weight])
        self.insult = np.array([t in INSULTS for t in self.terms], bool)
        self.insult = np.concatenate([np.zeros(3, bool), self.insult, self.insult])
        self.second = frozenset(SECOND_PERSON)
        self.mixed = re.compile(r"[^\W\d_](?:[^\w\s'’.,|-]|\d|_)+[^\W\d_]|^(?:\d|[@$*])+[^\W\d_]{2,}")

    def find(self, word: str) -> int | None:
        """The heaviest term among a word's forms."""
        found = [self.index[f] for f in term_forms(word) if f in self.index]
        return max(found, key=lambda k: (self.weight[3 + k], -k), default=None)

    def code(self, raw: str) -> int:
        word = plain(raw)
        if not word:
            return 0
        if word in self.second:
            return 1
        k = self.find(word)
        if k is not None:
            return 3 + k
        if self.mixed.search(word):
            k = self.find(word.translate(SYMBOL_LETTERS))
            return 2 if k is None else 3 + len(self.terms) + k
        return 0


class Codes(dict):
    """Word -> code, remembered."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        k = self.lexicon.code(word)
        if len(word) <= 64:
            self[word] = k
        return k


def features(text: str, codes: Codes) -> np.ndarray:
    words = text.lower().split()
    n = len(words)
    out = np.zeros(len(FEATURES))
    if not n:
        return out
    c = np.fromiter(map(codes.__getitem__, words), np.int32, n)
    lex, raw = codes.lexicon, text.encode("utf-8", "ignore")
    w = lex.weight[c]
    at = np.flatnonzero(w)
    you = np.flatnonzero(c == 1)
    near = 0
    if len(at) and len(you):
        right = np.searchsorted(you, at)
        gap = np.minimum(np.where(right < len(you), you[np.minimum(right, len(you) - 1)] - at, n), np.where(right > 0, at - you[np.maximum(right, 1) - 1], n))
        near = int((gap <= NEAR).sum())
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    terms = (c[at] - 3) % max(1, len(lex.terms))
    out[:] = (
        np.log1p(n), w.sum() / n, np.log1p(w.sum()), len(at) / n, np.log1p(len(at)), len(np.unique(terms)), w.max(), lex.insult[c].sum() / n, near / n, len(you) / n,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), share(b"!"), (c == 2).sum() / n, (c >= 3 + len(lex.terms)).sum() / n, share(b"0123456789"),
    )
    return out


def marked(labels: DataFrame, label: str, ident="doc_id") -> DataFrame:
    """(doc_id, y) of documents with a label."""
    return labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))


def sampled(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most so many rows, chosen by a hash of the id; small enough to be broadcast."""
    return rows.withColumn("_o", unit_hash(F.lit(salt), F.col("doc_id"))).orderBy("_o", "doc_id").limit(most).drop("_o")


def learn_lexicon(docs: DataFrame, known: DataFrame, ident: str, text: str) -> dict[str, float]:
    """Terms and their log-odds, from the texts of known (doc_id, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, ys = [], []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = {f for w in set((t or "").lower().split()) for f in term_forms(plain(w))}
                terms += mine
                ys += [y] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ys, pa.int32())], names=["term", "y"])

    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id").select("text", "y")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {w: 1.0 for w in INSULTS}
    counted = rows.mapInArrow(tidy(run), "term string, y int").groupBy("term").agg(F.sum("y").alias("k1"), F.sum(1 - F.col("y")).alias("k0"))
    odds = F.log((F.col("k1") + 0.5) / (n1 + 1.0)) - F.log((F.col("k0") + 0.5) / (n0 + 1.0))
    best = counted.where(F.col("k1") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    # the longest terms last: of two beginnings that say the same, the shorter is kept by its larger count
    rows = best.orderBy(F.desc(F.col("odds") * F.log1p("k1")), "term").limit(TERMS).collect()
    found = {r["term"]: float(r["odds"]) for r in rows}
    return {w: 1.0 for w in INSULTS} | found


def all_features(docs: DataFrame, odds: dict[str, float], ident: str, text: str) -> DataFrame:
    """(doc_id, f) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(Lexicon(odds))
        for b in batches:
            if len(codes) > WORDS_REMEMBERED:
                codes.clear()
            x = [features(t or "", codes).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, f array<double>")


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("f", "y").collect()  # a bounded sample
    return np.array([r["f"] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], float)


def train(feats: DataFrame, trees: DataFrame, calibration: DataFrame) -> tuple[dict, tuple[np.ndarray, np.ndarray]]:
    # equal rows would count more than once otherwise
    pick = lambda known: feats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("f").alias("f")).orderBy("doc_id")
    x, y = _matrix(pick(trees))
    xc, yc = _matrix(pick(calibration))
    if not len(x):
        x, y = np.zeros((0, len(FEATURES))), np.zeros(0)
    model = boost(x, y)
    if not len(x) or y.min() == y.max():
        level = float(y.mean()) if len(y) else 0.0
        return model, (np.array([0.0]), np.array([level]))
    if not len(xc) or yc.min() == yc.max():
        xc, yc = x, y
    return model, isotonic(margins(model, xc), yc)


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", ident="doc_id", text="text") -> DataFrame:
    """doc_id, score, predicted for every row of docs; learn says, over a doc_id column, which labels may be used."""
    known = marked(labels, label)
    known = written(known.where(learn) if learn is not None else known, "toxic-labels")
    part = unit_hash(F.lit(17), F.col("doc_id"))
    words = written(sampled(known.where(part < 0.45), LEXICON_ROWS, 1), "toxic-lexicon-rows")
    trees = written(sampled(known.where((part >= 0.45) & (part < 0.85)), TREE_ROWS, 2), "toxic-tree-rows")
    calibration = written(sampled(known.where(part >= 0.85), CALIBRATION_ROWS, 3), "toxic-calibration-rows")
    with batches_of(docs.sparkSession, 500):
        odds = learn_lexicon(docs, words, ident, text)
    feats = written(all_features(docs, odds, ident, text), "toxic-features", rows=500)
    model, fit = train(feats, trees, calibration)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(FEATURES))
            p = calibrated(fit, margins(model, x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return feats.mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, ident="doc_id", text="text", **how) -> DataFrame:
    """docs without those that are predicted to be toxic; docs' own columns."""
    verdicts = score(docs, labels, ident=ident, text=text, **how)
    # equal ids with different texts are judged by their worst text
    bad = written(verdicts.where("predicted = 1").select("doc_id").distinct(), "toxic-ids")
    return docs.join(bad.withColumnRenamed("doc_id", "_toxic"), F.col(ident).cast("long") == F.col("_toxic"), "left_anti")


def learnable() -> Column:
    """The rows whose labels the query may learn from."""
    return id_crc("doc_id") % 5 != 0
