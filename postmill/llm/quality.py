"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins.  Cyclic boosting visits
one feature after the other and adds a shallow tree over its bins to the
feature's lookup table; then pairs of features that explain what is left get
two-way tables in the same manner.  A score is the sum of table entries at the
row's bins, computed for whole batches.

The model is fitted on a bounded sample of labelled rows; every row is scored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Labelled rows that a model is fitted on, at most (in expectation).
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 12
SEED_SPACE = 1 << 30

NAMES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "letters", "upper", "digits", "symbols", "stops", "blanks",
    "lines_per_word", "distinct_words", "top_word", "same_as_last", "distinct_lines", "bare_symbols", "caps_words", "entropy", "high_bytes",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|!~^<>{}[]\\@_=+/")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def features(text: str | None) -> list[float]:
    """Numbers of one text; zeros for null and for texts without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    blanks = int(by[9:14].sum() + by[32])
    ink = max(size - blanks, 1)
    letters = int(by[_LETTERS].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = raw.split(b"\n")
    p = by[by > 0] / size
    return [
        np.log1p(size), np.log1p(n), ink / n, np.log1p(int(lengths.max())), letters / ink,
        int(by[65:91].sum()) / max(letters, 1), int(by[48:58].sum()) / ink, int(by[_SYMBOLS].sum()) / ink,
        int(by[[33, 44, 46, 58, 59, 63]].sum()) / ink, blanks / size, len(lines) / n, len(counts) / n, max(counts.values()) / n,
        sum(map(bytes.__eq__, words, itertools.islice(words, 1, None))) / n, len(set(lines)) / len(lines),
        sum(counts[w] for w in counts if len(w) == 1 and _SYMBOLS[w[0]]) / n, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        float(-(p * np.log2(p)).sum()), int(by[128:].sum()) / ink,
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        at = self.bins(x)
        total = np.full(x.shape[0], self.base)
        for table, b in zip(self.single, at):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.double):
            total += table[_coarse(at[i]), _coarse(at[j])]
        return 1 / (1 + np.exp(-total))


def _coarse(b: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // BINS


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> np.ndarray:
    """Leaf values over ordered bins: the best cuts of gradient sums, greedily."""
    parts = [(0, g.size)]
    cg, ch = np.append(0, g.cumsum()), np.append(0, h.cumsum())

    def worth(lo, hi):
        return (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)

    while len(parts) < leaves:
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = worth(lo, at) + worth(at, hi) - worth(lo, hi)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), (lo, hi), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(g.size)
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of both axes at once: its worth and the four leaf values as a table."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best = (-1.0, np.zeros_like(g))
    for a, b in itertools.product(range(1, PAIR_BINS), repeat=2):
        boxes = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
        sums = []
        for c in (cg, ch):
            c00, c01, c10, c11 = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
            sums.append((c00, c01 - c00, c10 - c00, c11 - c01 - c10 + c00))
        value = [x / (y + ridge) for x, y in zip(*sums)]
        worth = sum(x * v for x, v in zip(sums[0], value))
        if worth > best[0]:
            table = np.zeros_like(g)
            for box, v in zip(boxes, value):
                table[box] = v
            best = (worth, table)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> Model:
    """Boosted tables for features ``x`` and labels ``y``; a constant where a label is missing."""
    cuts = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for i in range(len(NAMES))]
    share = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
    model = Model(cuts, float(np.log(share / (1 - share))), [np.zeros(BINS) for _ in cuts])
    if len(np.unique(y)) < 2:
        return model
    at = model.bins(x)
    total = np.full(len(y), model.base)

    def gradients(cells: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        size = int(np.prod(shape))
        return tuple(np.bincount(cells, w, size).reshape(shape) for w in (y - p, p * (1 - p)))

    for _ in range(rounds):
        for i, b in enumerate(at):
            step = rate * _tree(*gradients(b, (BINS,)))
            model.single[i] += step
            total += step[b]
    coarse = _coarse(at)
    square = (PAIR_BINS, PAIR_BINS)
    worth = {(i, j): _quadrants(*gradients(coarse[i] * PAIR_BINS + coarse[j], square))[0] for i, j in itertools.combinations(range(len(NAMES)), 2)}
    model.pairs = sorted(worth, key=worth.get, reverse=True)[:PAIRS]
    model.double = [np.zeros(square) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            step = rate * _quadrants(*gradients(coarse[i] * PAIR_BINS + coarse[j], square))[1]
            model.double[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on a sample of about ``rows`` labelled documents, chosen by a hash of the id.

    Null labels are ignored; of repeated labels of an id the larger counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SPACE)) < SEED_SPACE * rows // n)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select(F.col("label").cast("double"), "text")
    found = picked.mapInArrow(batch, "label double, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)
    return fit(x[order], found["label"].to_numpy(float)[order])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score``, the probability of label 1.

    Null, empty and blank texts have the features of no words and a score like
    any other.  An input column ``quality_score`` is replaced.
    """
    docs = docs.drop("quality_score")
    schema = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(text_col).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, "quality_score"])

    return docs.mapInArrow(batch, schema)
