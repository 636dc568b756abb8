"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once, in parallel, and written: a few dozen numbers a document.
The trees are fitted on a bounded sample of labelled rows, binned into histograms; they are complete
binary trees flattened into arrays, which score a batch of rows level by level with numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, in_fold, written

CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "foreign": range(128, 256),
    "stop": b".",
    "comma": b",",
    "loud": b"!?",
    "bar": b"|",
    "junk": b"#$%&*@^~",
    "quote": b"\"'`",
    "mark": b":;/\\<>(){}[]=+-_",
}
TABLE = np.zeros((256, len(CLASSES)))
for _at, _bytes in enumerate(CLASSES.values()):
    TABLE[list(_bytes), _at] = 1
NAMES = [*CLASSES, "bytes", "words", "word_mean", "word_sd", "longest", "distinct", "top_share", "shouted", "titled", "bare", "short", "lines", "line_mean", "line_repeats", "entropy", "pair_repeats"]


def statistics(text: str | None) -> np.ndarray:
    """Numbers about a whole text; all 0 for null or empty text."""
    raw = (text or "").encode()
    out = np.zeros(len(NAMES))
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    often = Counter(words)
    pairs = set(zip(words, words[1:]))
    out[: len(CLASSES)] = counts @ TABLE / len(raw)
    out[len(CLASSES) :] = (
        len(raw), len(words), sizes.mean(), sizes.std(), sizes.max(), len(often) / n, max(often.values(), default=0) / n,
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n, sum(map(bytes.isalpha, words)) / n, (sizes <= 3).mean(),
        len(lines), len(words) / len(lines), 1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(), 1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0,
    )
    return out


@dataclass
class Forest:
    """Complete trees of one depth: node i's children are 2i + 1 and 2i + 2; a row goes right if its value is above the node's bound."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray
    leaf: np.ndarray  # trees x leaves
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss; split gains come from per-bin sums of gradients. With no rows, or
    one label only, the score is constant: one half, or close to the label."""
    inner = 2**depth - 1
    empty = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    if not len(y):
        return empty
    rate_of_ones = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    empty.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if y.min() == y.max():
        return empty
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)])
    logit = np.full(len(y), empty.base)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            gain = np.full((n, x.shape[1], bins), -np.inf)
            for j in range(x.shape[1]):
                at = (node - first) * bins + binned[:, j]
                left_g, left_h = (np.bincount(at, w, n * bins).reshape(n, bins).cumsum(axis=1) for w in (g, h))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                value = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                k = len(bounds[j])
                gain[:, j, :k] = np.where((left_h > 1) & (all_h - left_h > 1), value, -np.inf)[:, :k]
            best = gain.reshape(n, -1).argmax(axis=1)
            for i, b in enumerate(best):
                j, k = divmod(int(b), bins)
                if gain[i, j, k] > 1e-6:
                    feature[first + i], limit[first + i] = j, bounds[j][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        logit += leaf[at]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Forest(empty.base, np.array(features), np.array(limits), np.array(leaves), depth)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted.

    Trees learn from labelled rows outside the held-out fold, crc32(id) mod ``modulus`` = ``remainder``:
    at most ``max_rows`` of them, those whose hashed ids are smallest. Inputs are statistics of the
    whole text alone. Null text counts as empty and is scored as such; null ids are not held out and have no
    label; labels that are null or not 0 or 1 are ignored; of several labels of an id the largest counts.
    Repeated rows get equal rows. An empty table gives an empty result. Other columns are ignored.
    """

    @F.arrow_udf("array<double>")
    def features(text: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in text.to_pylist()]).reshape(len(text), len(NAMES))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))

    known = written(docs.select(col(id_col).alias("id"), in_fold(col(id_col), modulus, remainder).alias("held_out"), features(col(text_col).cast("string")).alias("x")))
    marked = labels.select(col(id_col).alias("id"), col(label_col).alias("y")).filter("y IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    sample = known.filter("NOT held_out").join(marked, "id").orderBy(F.xxhash64("id")).limit(max_rows).select("x", "y").toArrow()
    forest = fit_forest(np.array(sample.column("x").to_pylist()).reshape(-1, len(NAMES)), sample.column("y").to_numpy().astype(np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(x.flatten().to_numpy().reshape(-1, len(NAMES))))

    return known.select(F.col("id").alias(id_col), "held_out", scored("x").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
