"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts. Trees are fitted on the driver over the statistics of a bounded sample of labelled rows
(TRAIN_ROWS, those with the smallest id hashes) and flattened into arrays, which score all rows by vectorised traversal.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import fold_of, hash_sample, id_and_text, in_batches, per_batch, read, sliced

TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper", "digits", "symbols", "non_ascii", "spaces", "distinct_words", "top_word",
    "repeats", "log_lines", "distinct_lines", "mean_line", "lower_start", "ends_sentence", "byte_entropy", "short_words",
    "distinct_pairs", "top_symbol",
)
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
_PLAIN = (_BYTES >= 97) & (_BYTES <= 122) | _UPPER | _DIGIT | _SPACE | (_BYTES >= 128) | np.isin(_BYTES, [ord(c) for c in ".,"])


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS; defined for empty texts too."""
    data = text.encode()
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = max(1, len(data))
    words = text.split()
    lines = text.split("\n")
    n_words = max(1, len(words))
    kinds = Counter(words)
    repeats = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    seen = hist[hist > 0] / n
    own = hist * ~_PLAIN
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n_words, hist[_UPPER].sum() / n, hist[_DIGIT].sum() / n, own.sum() / n,
        hist[128:].sum() / n, hist[_SPACE].sum() / n, len(kinds) / n_words, max(kinds.values(), default=0) / n_words,
        repeats / n_words, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
        sum(x[:1].islower() for x in lines) / len(lines), text.count(".") / n_words, float(-(seen * np.log2(seen)).sum()) if len(seen) else 0.0,
        sum(len(w) <= 3 for w in kinds) / max(1, len(kinds)), pairs / max(1, len(words) - 1), own.max() / n,
    ]


@dataclass
class Forest:
    """Perfect binary trees of one depth: feature and cut of the inner nodes, value of the leaves, each (tree, node)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        n_trees, n_inner = self.feature.shape
        if not n_trees or not len(x):
            return total
        rows, trees = np.arange(len(x))[:, None], np.arange(n_trees)[None, :]
        at = np.zeros((len(x), n_trees), np.int64)
        while n_inner and at[0, 0] < n_inner:
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return total + self.value[trees, at - n_inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Forest:
    """Boost logistic loss. Without rows, or with one class only, the forest has no trees and gives the smoothed base rate."""
    base = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(base / (1 - base)))
    n_inner, n_leaf = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, n_inner), int), np.zeros((0, n_inner)), np.zeros((0, n_leaf)), start)
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1)
    margin = np.full(len(y), start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(n_inner, int), np.full(n_inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            whole = total_g**2 / (total_h + l2)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                key = local * bins + binned[:, f]
                left_g = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[f])]
                left_h = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[f])]
                gain = left_g**2 / (left_h + l2) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + l2) - whole[:, None]
                gain[(left_h < 1e-3) | (total_h[:, None] - left_h < 1e-3)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - n_inner
        value = -rate * np.bincount(leaf, g, n_leaf) / (np.bincount(leaf, h, n_leaf) + l2)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(np.array(features), np.array(cuts), np.array(values), start)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fit on labelled rows outside the held-out fold, at most train_rows of them. Rows without a label or id don't count; of documents
    that repeat a labelled id, the first by text counts for each label."""
    mine = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(fold_of(F.col("doc_id"), FOLDS) != 0)
    mine = hash_sample(mine, mine.count(), train_rows, "doc_id", "y")  # train_rows of 16 bytes: safe to broadcast
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(mine.distinct()), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    found = per_batch(rows, lambda texts: {"x": [statistics(t) for t in texts]}, "y double, x array<double>", columns=("y", "text"), keep=("y",)).collect()
    found.sort(key=lambda r: (r.y, r.x))  # arrival order doesn't matter
    x = np.array([r.x for r in found]).reshape(len(found), len(STATISTICS))
    return grow(x, np.array([r.y for r in found]))


def score(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row. A null or empty text is scored like any other."""

    def compute(texts: list[str]) -> dict:
        p = forest.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS)))
        return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

    return per_batch(id_and_text(docs, id_col, text_col), compute, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    import pyarrow as pa

    forest = fit(docs, labels)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 8_000_000):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                p = forest.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS)))
                yield part.filter(pa.array(p >= THRESHOLD))

    return in_batches(docs).mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
