"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text (FEATURES) are cut into BINS quantile bins each. Boosting goes round
all features in turn, many times, with a small step: a tree of at most LEAVES leaves on one
feature's bins is fitted to the current residuals and added to that feature's lookup table.
Then the PAIRS pairs of features whose joint bins explain most of what is left get tables of
their own, boosted the same way with trees that cut both features. A score is the logistic
of the sum of the table entries of a text's bins, so scoring is a lookup and an addition per term.

Features are computed once for all documents in one pass over the texts and kept in the
shared folder. The model is fitted on at most TRAINING_ROWS labelled rows, those with the
smallest key hashes, which is the one bound; scoring covers all rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, key_crc, lean_batches

TRAINING_ROWS = 40_000
BINS, COARSE, LEAVES, ROUNDS, PAIRS, PAIR_ROUNDS, STEP, SMOOTH = 48, 8, 3, 300, 6, 80, 0.08, 4.0
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "symbols", "sentence_marks", "commas", "bars", "non_ascii",
    "marked_words", "upper_words", "distinct_words", "top_word", "stop_like", "lines", "line_words", "distinct_lines", "ended_lines", "sentence_words", "repeated_pairs",
)

_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK[list(b".!?")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+/<=>@[]\\^_`{|}~")] = True
_TRAIL = "#$%&*+/<=>@[]\\^_`{|}~!"


def features_of(text: str | None) -> list[float]:
    """The FEATURES of one text; null counts as empty. All shares are 0 where there is nothing to count."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars, words, lines = len(text), text.split(), [line for line in text.split("\n") if line.strip()]
    n, c = max(1, len(words)), max(1, chars)
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    marks = int(counts[_MARK].sum())
    pairs = set(zip(words, words[1:], strict=False))
    return [
        float(np.log1p(chars)), float(np.log1p(len(words))), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n,
        counts[_UPPER].sum() / c, counts[_DIGIT].sum() / c, counts[_SYMBOL].sum() / c, marks / n, counts[44] / n, counts[124] / n, counts[128:].sum() / c,
        sum(w[-1] in _TRAIL for w in words) / n, sum(w.isupper() for w in words) / n, len(seen) / n, max(seen.values(), default=0) / n,
        sum(len(w) <= 3 for w in words) / n, float(np.log1p(len(lines))), len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
        sum(line.rstrip()[-1] in ".!?" for line in lines) / max(1, len(lines)), len(words) / max(1, marks), 1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


def featured(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, features array<double>) of every row."""
    extract = F.pandas_udf(lambda texts: texts.map(features_of), "array<double>")
    return documents.select(F.col(key).alias("key"), extract(F.coalesce(F.col(text), F.lit(""))).alias("features"))


def leaf_values(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """The step function over ordered bins with at most so many pieces that a greedy tree gives: the value of each bin."""
    pieces = [(0, len(gradient))]
    g, h = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SMOOTH)
    while len(pieces) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(pieces):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain_of(a, cuts) + gain_of(cuts, b) - gain_of(a, b)
                at = int(gains.argmax())
                best = max(best, (float(gains[at]), k, int(cuts[at])))
        if not best[2]:
            break
        a, b = pieces.pop(best[1])
        pieces += [(a, best[2]), (best[2], b)]
    values = np.zeros(len(gradient))
    for a, b in pieces:
        values[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SMOOTH)
    return values


def quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree that cuts both axes once: its gain, and the value of each cell."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    score = lambda x, y: x**2 / (y + SMOOTH)
    gs = [g[:-1, :-1], g[:-1, -1:] - g[:-1, :-1], g[-1:, :-1] - g[:-1, :-1]]
    hs = [h[:-1, :-1], h[:-1, -1:] - h[:-1, :-1], h[-1:, :-1] - h[:-1, :-1]]
    gs.append(g[-1, -1] - sum(gs))
    hs.append(h[-1, -1] - sum(hs))
    total = sum(score(x, y) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(total.argmax(), total.shape)
    values = np.empty(gradient.shape)
    for k, (a, b) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        values[a, b] = gs[k][i, j] / (hs[k][i, j] + SMOOTH)
    return float(total[i, j] - score(g[-1, -1], h[-1, -1])), values


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AdditiveModel:
    """Edges and lookup table of each feature, the coarse edges and tables of the pairs, and the intercept."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        """x: rows by features, y: 0 or 1. Without rows, or with one class alone, every score is that share (no rows: a half)."""
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for column in x.T]
        self.coarse = [np.unique(np.quantile(column, np.linspace(0, 1, COARSE + 1)[1:-1])) if len(y) else np.zeros(0) for column in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not 0 < y.sum() < len(y):
            return self
        bins, wide = self.binned(x, self.edges), self.binned(x, self.coarse)
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for k, table in enumerate(self.tables):
                p = logistic(total)
                step = STEP * leaf_values(np.bincount(bins[:, k], y - p, len(table)), np.bincount(bins[:, k], p * (1 - p), len(table)), LEAVES)
                table += step
                total += step[bins[:, k]]

        def joint(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            return wide[:, i] * shape[1] + wide[:, j], shape

        def tree(i: int, j: int) -> tuple[float, np.ndarray]:
            p = logistic(total)
            cells, shape = joint(i, j)
            sums = (np.bincount(cells, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))
            return quadrants(*sums)

        able = [k for k in range(x.shape[1]) if len(self.coarse[k])]
        ranked = sorted(((tree(i, j)[0], i, j) for i in able for j in able if i < j), reverse=True)[:PAIRS]
        self.pairs = [(i, j, np.zeros(joint(i, j)[1])) for _, i, j in ranked]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                step = STEP * tree(i, j)[1]
                table += step
                total += step.ravel()[joint(i, j)[0]]
        return self

    @staticmethod
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, "right") for e, column in zip(edges, x.T, strict=True)], axis=1) if len(edges) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.binned(x, self.edges), np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        if self.pairs:
            wide = self.binned(x, self.coarse)
            for i, j, table in self.pairs:
                total += table[wide[:, i], wide[:, j]]
        return logistic(total)


def fit_quality(keyed: DataFrame, labels: DataFrame, training: Column, label: str = "quality", key: str = "doc_id", rows: int = TRAINING_ROWS) -> AdditiveModel:
    """Fit on the labelled rows for which `training` holds; rows: the most that are used. Null labels and null keys teach nothing."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    taught = keyed.where(training).join(known, ["key"])
    picked = taught.orderBy(F.xxhash64("key"), "key", "label").limit(rows).select("features", "label").collect()
    x = np.array([r["features"] for r in picked], float).reshape(len(picked), len(FEATURES))
    return AdditiveModel().fit(x, np.array([r["label"] for r in picked], float))


def score_quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: key, features, score.

    Labels are learned only from rows whose key's CRC-32 isn't a multiple of 5. Null and empty texts are
    scored by their features, all 0. With no usable label every score is a half.
    Equal texts get equal scores; repeated labels count repeatedly.
    """
    with lean_batches(documents.sparkSession):
        keyed = cut(featured(documents, key, text))
    model = fit_quality(keyed, labels, F.pmod(key_crc(F.col("key")), F.lit(5)) != 0)
    scored = F.pandas_udf(lambda features: pd.Series(model.score(np.array(features.tolist(), float).reshape(len(features), len(FEATURES)))), "double")
    return keyed.withColumn("score", scored("features"))


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(documents, labels)
    return scored.select(
        F.col("key").alias("doc_id"), (F.pmod(key_crc(F.col("key")), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
