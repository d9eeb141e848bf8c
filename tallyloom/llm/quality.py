"""A quality classifier: histogram gradient-boosted trees over document statistics, held as arrays and walked in numpy.

Statistics are numbers of the text alone: shares of character classes, of words and of repetitions. The trees are grown level by
level on binned statistics: each level adds the gradients of all rows into a histogram of (node, statistic, bin) and takes the best
cut of each node. A tree of depth d is 2^d - 1 cuts and 2^d leaf values, all trees side by side in two arrays, so that all
documents of a batch walk down a tree together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, crc_of_id, id_and_text, per_text

#: Labelled rows to fit on, at most: those of the smallest hashes of their ids. Only this bounded sample reaches the driver.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1

_CLASSES = [range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",", b"!", b"|", b"?", b"$%&*#@^~", b"'\"`", b"()[]{}<>", b";:-/_=+\\", range(128, 192), range(192, 256)]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _i
UPPER, LETTERS = 1, (0, 1)
ODD = (7, 8, 10)
_IS_ODD = np.isin(np.arange(len(_CLASSES) + 1), ODD)
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def _line_shares(codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of odd marks and of capitals in each line that is not blank, of its whole length; one share of 0 if there is none."""
    ends = np.flatnonzero(codes == 10)
    starts = np.r_[0, ends + 1]
    lengths = np.r_[ends, len(codes)] - starts
    if starts[-1] == len(codes):
        starts, lengths = starts[:-1], lengths[:-1]
    per_line = lambda hit: np.add.reduceat(hit, starts, dtype=np.int64)
    told = per_line(~_BLANK[codes]) > 0
    if not told.any():
        return np.zeros(1), np.zeros(1)
    odd, loud = per_line(_IS_ODD[classes]), per_line(classes == UPPER)
    return odd[told] / lengths[told], loud[told] / lengths[told]


def statistics(raw: bytes) -> list[float]:
    """The numbers that the trees see; an empty text has zeros."""
    if not raw:
        return [0.0] * N_STATISTICS
    codes = np.frombuffer(raw, np.uint8)
    classes = _CLASS_OF[codes]
    shares = np.bincount(classes, minlength=len(_CLASSES) + 1) / len(raw)
    words = raw.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    odd, loud = _line_shares(codes, classes)
    pairs = max(1, len(words) - 1)
    return [
        *shares.tolist(),
        float(np.log1p(len(raw))), float(np.log1p(len(words))), len(raw) / n,
        len(counts) / n, len(counts) / np.sqrt(n), sum(top) / n, (top or [0])[0] / n,
        sum(map(eq, words, words[1:])) / pairs, len(set(zip(words, words[1:]))) / pairs,
        len(lines) / n, len(set(lines)) / max(1, len(lines)),
        float(odd.max()), float(odd.min()), float(loud.max()), float(loud.min()),
    ]


N_STATISTICS = len(_CLASSES) + 1 + 15


@dataclass(frozen=True)
class Trees:
    """Cut i of tree t leads to 2i+1 or 2i+2; below the last cuts come the leaves."""

    statistic: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.statistic.shape[1]
        for statistic, cut, leaf in zip(self.statistic, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, statistic[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosting on the logistic loss. Without both labels the start value alone decides."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, k = 2**depth - 1, x.shape[1]
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    place = binned + np.arange(k) * bins
    total = np.full(len(y), start)
    cuts, stats, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node, stat, cut = np.zeros(len(y), np.int64), np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * bins) + place).ravel()
            sums = [np.bincount(at, np.repeat(w, k), width * k * bins).reshape(width, k, bins) for w in (grad, hess, np.ones(len(y)))]
            left = [np.cumsum(s, axis=2) for s in sums]
            right = [s[:, :, -1:] - s for s in left]
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge)
            gain[(left[2] < least) | (right[2] < least)] = -1
            whole = left[0][:, 0, -1] ** 2 / (left[1][:, 0, -1] + ridge)
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), bins)
                if gain[i, j, c] > whole[i] + 1e-9 and c < len(edges[j]):
                    stat[first + i], cut[first + i] = j, edges[j][c]
            node = 2 * node + 1 + (x[np.arange(len(y)), stat[node]] > cut[node])
        g, h = (np.bincount(node - inner, w, inner + 1) for w in (grad, hess))
        leaf = -rate * g / (h + ridge)
        total += leaf[node - inner]
        cuts.append(cut), stats.append(stat), leaves.append(leaf)
    return Trees(np.array(stats), np.array(cuts), np.array(leaves), start)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on labelled rows outside the held-out fold, ``rows`` of them at most. Rows without an id, a text or a label teach nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_of_id(FOLDS) != HELD_OUT))
    chosen = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    schema, sql = pa.schema([("x", pa.list_(pa.float64()))]), "x array<double>"
    # the chosen labels are two numbers a row, a few hundred KB at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    measured = per_text(id_and_text(texts), lambda t: {"x": list(map(statistics, t))}, schema, sql)
    got = measured.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality", "x").limit(rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, N_STATISTICS)), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), got["quality"].to_numpy(np.float64))


def scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """Documents to (doc_id, score): 0 to 1, higher for better. A null or empty text gets a score too; repeated rows all stay."""

    def work(texts):
        return {"score": trees.score(np.array([statistics(t) for t in texts]).reshape(-1, N_STATISTICS))}

    return per_text(id_and_text(docs), work, pa.schema([("score", pa.float64())]), "score double")


def keep_good(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The rows whose text scores ``least`` or more, with the columns that they came with."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            good = trees.score(np.array([statistics(t) for t in raw]).reshape(-1, N_STATISTICS)) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
