"""Quality classifier: Bradley-Terry pairwise ranking.

Every whole text gets dense features in one pass. From a bounded sample of labelled rows, preference pairs (a text
labelled 1 over one labelled 0) are drawn; document scores are linear in the expanded features, and their weights
minimise the logistic loss on feature differences, which is the Bradley-Terry model. A document is predicted 1 if its
score reaches the quantile of the sample's scores that leaves the labelled share of ones above it.

Defined results: null and empty texts have all features 0 and are scored like any other; a document whose labels
disagree counts as 0; null labels are ignored; without labels of both kinds all scores are 0.5 (predicted 1) if there
are labels 1, else 0; equal rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import id_crc, tidy, unit_hash, written
from pixelweave.llm.learning import paired_logistic

#: Labelled rows that are sampled, and pairs drawn from them, at most.
ROWS, PAIRS = 20000, 60000
#: Cuts of each feature in the expansion.
CUTS = 4
FEATURES = ("words", "word_length", "distinct", "same_as_previous", "symbol_words", "symbols", "pipes", "exclaimed", "capitals", "digits", "punctuation", "short_words", "lines", "repeated_lines", "blank_lines", "words_by_line", "top_word", "letters", "ended_lines")


def features(text: str) -> np.ndarray:
    words = text.split()
    n = len(words)
    out = np.zeros(len(FEATURES))
    if not n:
        return out
    raw = text.encode("utf-8", "ignore")
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    index: dict[str, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    lengths = np.fromiter(map(len, index), np.int64, len(index))[codes]
    ends = np.fromiter((w[-1] in "#*$%&|<>" for w in index), bool, len(index))[codes]
    shouts = np.fromiter((w.endswith("!!") for w in index), bool, len(index))[codes]
    lines = text.split("\n")
    full = [x for x in lines if x and not x.isspace()]
    upper, lower = share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"abcdefghijklmnopqrstuvwxyz")
    out[:] = (
        np.log1p(n), lengths.mean(), len(index) / n, (codes[1:] == codes[:-1]).sum() / n, ends.sum() / n, share(b"#*$%&|<>"), share(b"|"), shouts.sum() / n, upper / (upper + lower) if upper + lower else 0.0,
        share(b"0123456789"), share(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), (lengths <= 3).sum() / n, np.log1p(len(full)), 1 - len(set(full)) / max(1, len(full)), 1 - len(full) / len(lines), np.log1p(n / max(1, len(full))),
        np.bincount(codes).max() / n, 1 - share(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789 \n\r\t"), sum(x.rstrip()[-1] in ".!?\"" for x in full) / max(1, len(full)),
    )
    return out


def expansion(x: np.ndarray) -> dict:
    """Means, scales and cuts of the sample's features."""
    return {"mean": x.mean(0), "scale": np.maximum(x.std(0), 1e-6), "cuts": np.quantile(x, np.linspace(0, 1, CUTS + 2)[1:-1], axis=0)}


def expand(x: np.ndarray, how: dict) -> np.ndarray:
    """Each feature, clipped, and its excess over each cut."""
    scale = lambda v: np.clip(v / how["scale"], -5, 5)
    return np.concatenate([scale(x - how["mean"]), *[np.maximum(scale(x - c), 0) for c in how["cuts"]]], 1)


def marked(labels: DataFrame, label: str, ident="doc_id") -> DataFrame:
    return labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("doc_id")).agg(F.min((F.col(label) > 0).cast("int")).alias("y"))


def all_features(docs: DataFrame, ident: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t or "").tolist() for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, f array<double>")


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict | None:
    """The ranking model: expansion, weights, threshold and scale of scores."""
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return None
    how = expansion(x)
    z = expand(x, how)
    rng = np.random.default_rng(seed)
    many = min(PAIRS, len(good) * len(bad), 40 * max(len(good), len(bad)))
    w = paired_logistic(z[rng.choice(good, many)] - z[rng.choice(bad, many)], ridge=1e-3)
    s = z @ w
    # between the rows on either side of the quantile
    order, k = np.sort(s), len(bad)
    edge = float((order[k - 1] + order[k]) / 2)
    return how | {"w": w, "edge": edge, "spread": float(max(s.std(), 1e-6) / 2)}


def scores(x: np.ndarray, model: dict | None, default: float) -> np.ndarray:
    if model is None:
        return np.full(len(x), default)
    return 1 / (1 + np.exp(-np.clip((expand(x, model) @ model["w"] - model["edge"]) / model["spread"], -500, 500)))


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", ident="doc_id", text="text") -> DataFrame:
    """doc_id, score, predicted for every row of docs; learn says, over a doc_id column, which labels may be used."""
    known = marked(labels, label)
    known = known.where(learn) if learn is not None else known
    rows = written(known.withColumn("_o", unit_hash(F.lit(23), F.col("doc_id"))).orderBy("_o", "doc_id").limit(ROWS).drop("_o"), "quality-rows")
    feats = written(all_features(docs, ident, text), "quality-features", rows=500)
    got = feats.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("f").alias("f")).orderBy("doc_id").collect()  # at most ROWS
    y = np.array([r["y"] for r in got], float)
    model = fit(np.array([r["f"] for r in got], float).reshape(len(got), len(FEATURES)), y)
    default = 0.5 if (y > 0).any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scores(np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(FEATURES)), model, default)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return feats.mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def learnable() -> Column:
    """The rows whose labels the query may learn from."""
    return id_crc("doc_id") % 3 != 1
