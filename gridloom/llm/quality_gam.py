"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numbers about its words, characters and lines. Each number is binned at
quantiles of the sample, and one lookup table per feature is learnt by cyclic boosting: in turn, each
feature gets a shallow tree over its bins, fitted to what the sum of all tables still leaves of the
log loss. The pairs of features that explain most of the rest then get tables of their own, learnt in
the same way with one cut along each axis. A score is the sum of table entries, so scoring a batch is
binning and vectorised additions.

The model is fitted on the driver from the features of at most SAMPLE labelled rows.

Defined results: a null or empty text has all features 0 and is scored like any other; repeated rows
are scored each for itself; without labelled rows of both classes the score is the smoothed share of
label 1, 0.5 without any; an empty table gives an empty frame.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import labelled_sample, remainder, slices, table
from gridloom.llm.fertility import repeated

DIVISOR, HELD_OUT = 3, 1
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "same_as_before", "repeated_windows", "short_words", "duplicate_lines",
    "words_per_line", "upper", "digits", "symbols", "stops", "marks", "bars", "beyond_ascii", "letters_entropy", "word_entropy",
)
SYMBOLS = b"#*$%&<>@^~_={}[]\\/+"


def features(text: str) -> list[float]:
    """The numbers of one text, in the order of FEATURES."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    inked = max(len(data) - int(by_byte[9:14].sum()) - int(by_byte[32]), 1)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    index = {w: i for i, w in enumerate(counts)}
    numbers = np.array([index[w] for w in words], np.uint64)
    share = by_byte[97:123] / max(int(by_byte[97:123].sum()), 1)
    share = share[share > 0]
    freq = np.fromiter(counts.values(), float, len(counts)) / n
    spread = np.log2(min(n, 4096)) if n > 1 else 1.0
    return [
        float(np.log1p(n)),
        inked / n,
        len(counts) / n**0.75,
        max(counts.values()) / n,
        float((numbers[1:] == numbers[:-1]).sum()) / n,
        repeated(numbers) / n,
        sum(c for w, c in counts.items() if len(w) < 4) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        int(by_byte[65:91].sum()) / inked,
        int(by_byte[48:58].sum()) / inked,
        int(by_byte[list(SYMBOLS)].sum()) / inked,
        int(by_byte[46] + by_byte[44]) / n,
        int(by_byte[33] + by_byte[63]) / n,
        int(by_byte[124]) / n,
        int(by_byte[128:].sum()) / inked,
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        float(-(freq * np.log2(freq)).sum() / spread),
    ]


@dataclass
class Gam:
    """Cut points and lookup tables; `pairs` holds (feature, feature, coarse table)."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        total = np.full(len(x), self.intercept)
        if self.tables and len(x):
            for bins, values in zip(self.bins(x, self.cuts), self.tables):
                total += values[bins]
            coarse = self.bins(x, self.coarse)
            for i, j, values in self.pairs:
                total += values[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton step for summed gradients and curvatures; the constant shrinks thin leaves."""
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; the place is the first bin on the right."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    if not len(gain):
        return 0.0, 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A tree over ordered bins, grown at the best cut until it has `leaves`; a value per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts)]
        gain, at, k = max(options)
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut along each axis of a grid of bins: gain and a value per cell."""
    _, at = _best_cut(g.sum(1), h.sum(1))
    best, values = 0.0, np.zeros(g.shape)
    for rows in {at, g.shape[0] // 2} - {0}:
        for cols in range(1, g.shape[1]):
            made, gain = np.zeros(g.shape), -(g.sum() ** 2) / (h.sum() + 1)
            for a in (slice(0, rows), slice(rows, None)):
                for b in (slice(0, cols), slice(cols, None)):
                    gs, hs = g[a, b].sum(), h[a, b].sum()
                    made[a, b] = _leaf(gs, hs)
                    gain += gs**2 / (hs + 1)
            if gain > best:
                best, values = float(gain), made
    return best, values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 80, pair_rounds: int = 30, most_pairs: int = 8, rate: float = 0.15, leaves: int = 4) -> Gam:
    """Fit to features x and labels y."""
    ones = float(y.sum())
    intercept = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    if not ones or ones == len(y):
        return Gam(intercept, [])
    gam = Gam(intercept, [_cuts(c, bins) for c in x.T], coarse=[_cuts(c, coarse) for c in x.T])
    binned, rough = gam.bins(x, gam.cuts), gam.bins(x, gam.coarse)
    gam.tables = [np.zeros(len(c) + 1) for c in gam.cuts]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, values in enumerate(gam.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(binned[j], g, len(values)), np.bincount(binned[j], h, len(values)), leaves)
            values += step
            total += step[binned[j]]

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(gam.coarse[i]) + 1, len(gam.coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    gains = sorted(((_cross(*grids(i, j, g, h))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:most_pairs] if gain > 1.0]
    gam.pairs = [(i, j, np.zeros((len(gam.coarse[i]) + 1, len(gam.coarse[j]) + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, values in gam.pairs:
            step = rate * _cross(*grids(i, j, *slopes()))[1]
            values += step
            total += step[rough[i], rough[j]]
    return gam


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [features(t or "") for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Fit on at most `sample` labelled rows outside the held-out ones."""
    rows = labelled_sample(docs, labels, "quality", DIVISOR, HELD_OUT, sample)
    found = rows.select("text", "label").mapInArrow(_features, "x array<double>, label int").collect()
    # A fixed order: the fit adds floats.
    found.sort(key=lambda r: (r["x"], r["label"]))
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], float))


def score(docs: DataFrame, gam: Gam, text: str = "text") -> DataFrame:
    """(row, score): the rows of docs as structs, so that their columns may have any name, and the
    probability of label 1."""
    wrapped = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gam.score(x), pa.float64())], names=["row", "score"])

    return wrapped.mapInArrow(run, StructType([wrapped.schema["row"], StructField("score", DoubleType())]))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier, trained on those with labels, takes for label 1."""
    return score(docs, train(docs, labels, sample)).where(F.col("score") >= 0.5).select("row.*")


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gam = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, gam).select(
        "row.doc_id", (remainder("row.doc_id", DIVISOR) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op6_quality_gam": op6_quality_gam}
ORACLES: dict[str, str] = {}
