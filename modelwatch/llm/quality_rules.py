"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Trees are grown on a bounded sample of labelled rows, flattened into node arrays, and applied to whole batches at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.llm.common import ASCII_SPACE, map_texts, stored

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = b"0123456789"
#: Bytes that continue a code point in UTF-8.
CONTINUATION = bytes(range(0x80, 0xC0))

STATISTICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, "
    "n_distinct long, n_upper long, n_lower long, n_digits long, n_marks long, n_sentences long, n_pairs_again long"
)
#: Name and direction (+1: may only raise the score, -1: may only lower it, 0: free) of each model feature.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_lines": -1,
    "repeat_words": -1,
    "pairs_again": -1,
    "distinct_words": 0,
    "upper_share": -1,
    "digit_share": 0,
    "marks_per_word": -1,
    "sentences_per_word": 0,
}


def covered_by_repeats(codes: np.ndarray, width: int) -> int:
    """Number of positions in windows of ``width`` codes that occur at least twice, first occurrence included."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    base = int(codes.max()) + 1
    windows, size = codes[:n], base
    for j in range(1, width):
        if size * base >= 2**62:  # number the windows densely, so that nothing overflows
            _, windows = np.unique(windows, return_inverse=True)
            size = n
        windows, size = windows * base + codes[j : j + n], size * base
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] >= 2)
    hit = np.zeros(len(codes), bool)
    for j in range(width):
        hit[starts + j] = True
    return int(hit.sum())


def statistics_of(raw: bytes | None) -> tuple[int, ...]:
    """The numbers of ``STATISTICS`` for one text; a null or empty text has none of anything."""
    if not raw:
        return (0,) * 14
    words = raw.split()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n_chars = len(raw.translate(None, CONTINUATION))
    spaces = len(raw) - len(raw.translate(None, ASCII_SPACE))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip(ASCII_SPACE):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), n_chars - spaces, count(SYMBOLS), dup, covered_by_repeats(codes, 3), n_chars, lines, len(numbers),
        count(UPPER), count(LOWER), count(DIGITS), count(b"!?"), sum(w.endswith((b".", b"!", b"?")) for w in words),
        int((codes[1:] == codes[:-1]).sum()),
    )


def statistics(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """Statistics of every whole text, one row per row of ``docs``."""

    def fn(texts):
        return [np.array(c, np.int64) for c in zip(*map(statistics_of, texts), strict=True)] if texts else [[]] * 14

    return map_texts(docs, list(keep), text_col, fn, STATISTICS)


def feature_matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(s["n_words"], 1)
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1)
    columns = [
        np.log1p(s["n_words"]),
        s["word_chars"] / words,
        s["n_symbols"] / words,
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words,
        s["n_pairs_again"] / words,
        s["n_distinct"] / np.sqrt(words),
        s["n_upper"] / letters,
        s["n_digits"] / np.maximum(s["n_chars"], 1),
        s["n_marks"] / words,
        s["n_sentences"] / words,
    ]
    return np.column_stack(columns).astype(np.float64)


@dataclass
class Forest:
    """All trees in flat arrays: node i tests ``feature[i] <= threshold[i]``, goes to ``left[i]`` or ``left[i] + 1``;
    leaves have feature -1 and add ``value[i]``. ``roots`` holds the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], 0, 1)
                at = np.where(inner, self.left[at] + go, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    directions: Sequence[int],
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    n_bins: int = 64,
    l2: float = 1.0,
    least_rows: int = 20,
) -> Forest:
    """Boosted trees for a 0/1 label by second-order logistic loss over histograms.

    A split on a constrained feature is taken only in its direction, and the midpoint of its two values bounds all
    values below it, so the score is monotonic in that feature over the whole tree. Without rows of both classes the
    forest is a constant.
    """
    n = len(y)
    rate_of_ones = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            column.append(empty)
        return len(feature) - 1

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if n else np.zeros(0) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if n else x
    margin = np.full(n, base)
    for _ in range(n_trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(root := node())
        work = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            leaf = float(np.clip(-g / (h + l2), low, high))
            best = (1e-6, None, None, None, None)
            if level < depth and len(rows) >= 2 * least_rows:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    bins = binned[rows, j]
                    gl = np.cumsum(np.bincount(bins, grad[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins, hess[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(bins, minlength=len(e) + 1))[:-1]
                    wl = np.clip(-gl / (hl + l2), low, high)
                    wr = np.clip(-(g - gl) / (h - hl + l2), low, high)
                    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                    bad = (nl < least_rows) | (len(rows) - nl < least_rows)
                    bad |= directions[j] * (wr - wl) < 0
                    gain[bad] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
            if best[1] is None:
                value[at] = rate * leaf
                margin[rows] += rate * leaf
                continue
            _, j, k, wl, wr = best
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at] = node()
            node()
            goes_left = binned[rows, j] <= k
            middle = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            for side, part, (lo, hi) in zip((0, 1), (rows[goes_left], rows[~goes_left]), bounds[directions[j]], strict=True):
                work.append((left[at] + side, part, level + 1, lo, hi))
    return Forest(
        np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(value, float),
        np.array(roots, np.int64), base,
    )


def labelled_sample(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows, the same ones on every run: those whose ids hash lowest. Null labels are left out."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    joined = rows.join(known, F.col(id_col) == F.col("__id"))
    names = [c for c in joined.columns if c not in ("__id", id_col)]
    return joined.orderBy(F.xxhash64("__id"), "__id", *names).limit(most)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_train_rows: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """Statistics, score and verdict of every row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated 3-word windows. ``kept`` is false for
    those; otherwise the trees decide (``score >= threshold``). Null and empty texts have zero counts and fail. The
    trees are fitted on at most ``most_train_rows`` labelled rows; with none, or one class only, the score is constant.
    Repeated rows are judged each; other columns do not matter. An empty table gives an empty result.
    """
    rows = stored(statistics(docs, [id_col], text_col), "quality-rules")
    sample = labelled_sample(rows, labels, id_col, label_col, most_train_rows).toPandas()
    x = feature_matrix({c: sample[c].to_numpy(np.float64) for c in rows.columns if c != id_col})
    forest = fit_forest(x, sample["__label"].to_numpy(np.float64), list(FEATURES.values()))
    names = rows.columns

    def run(batches):
        for batch in batches:
            s = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names if c != id_col}
            score = forest.probability(feature_matrix(s))
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            kept = ~failed & (score >= threshold)
            extra = [pa.array(score), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "score", "base_failed", "kept"])

    schema = T.StructType([*rows.schema.fields]).add("score", "double").add("base_failed", "boolean").add("kept", "boolean")
    return rows.mapInArrow(run, schema)
