"""Quality by Bradley-Terry ranking of text features.

Documents of label 1 are preferred to documents of label 0. The logistic loss of the difference of scores, linear in
features, is minimised by Newton's method over all pairs of all labelled rows. The threshold is the quantile of the scores
of labelled rows that leaves as large a share below it as label 0 has; scores are shifted so that the threshold is THRESHOLD.

No pair is made: with scores given, a pair's loss and its derivatives depend on two numbers, so sums over pairs are sums
over pairs of nodes of a grid. Every row is dealt to the ORDER nodes around its score by the weights of polynomial
interpolation, which is exact to about 1e-9 as the loss is smooth and the grid fine. Tasks sum moments of their rows'
features at each node, and the driver holds the nodes in use, whose number is bounded by the scores' range (features are
clipped, the loss holds weights down), not by the rows. Features of labelled rows are a scratch table. Scores at the
threshold's rank are selected digit by digit of their bits, so they are exact. Every text is scored whole. Features come
from the text alone: shares of kinds of bytes, repeated words, neighbours and lines, and lengths.

Defined cases: null and empty texts are scored as empty; labels of other values, null labels and null ids don't teach;
without both labels there are no pairs and every score is THRESHOLD; rows are scored one by one, so repeated rows get
equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import id_slot, plain, set_bits, slot_map, text_of
from docloom.llm.minhash import word_hashes
from docloom.sources.scratch import materialize, scratch_scope

#: Score of the threshold; rows that are worked on at once; distance of nodes of the grid, and nodes that a row is dealt to.
THRESHOLD, SLICE, STEP, ORDER = 0.7, 256, 0.125, 8
#: Bits of a digit when scores are selected; columns of what tasks tell.
DIGIT, TRIPLE = 16, "a long, b long, v array<double>"
_KIND = np.full(256, 5, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (0x20, *range(9, 14)), (46, 44, 39, 59, 58, 45, 63, 40, 41, 34))):
    _KIND[list(_bytes)] = _k
_KIND[128:] = 6
NAMES = [
    "lower", "upper", "digit", "space", "punctuation", "symbol", "high", "log_bytes", "log_words", "word_length",
    "repeated_neighbour", "repeated_word", "log_types_share", "repeated_line", "symbol_word", "line_words", "top_word", "empty",
]


def features(texts: list[str]) -> np.ndarray:
    """A row of len(NAMES) numbers for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for row, text in zip(out, texts, strict=True):
        data = text.encode("utf-8", "surrogatepass")
        if not data.strip():
            row[-1] = 1
            continue
        x = np.frombuffer(data, np.uint8)
        kinds = _KIND[x]
        row[:7] = np.bincount(kinds, minlength=7) / len(x)
        words, starts = word_hashes(data)
        n = len(words)
        order = np.sort(words)
        new = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True])))
        types = len(new) - 1
        lines = data.split(b"\n")
        row[7:10] = np.log1p(len(x)) / 10, np.log1p(n) / 10, min(len(x) / n, 40) / 10
        row[10] = (words[1:] == words[:-1]).mean() if n > 1 else 0
        row[11] = 1 - types / n
        row[12] = np.log1p(types) / np.log1p(n)
        row[13] = 1 - len(set(lines)) / len(lines)
        row[14] = (kinds[starts] == 5).mean()
        row[15] = min(n / len(lines), 400) / 100
        row[16] = np.diff(new).max() / n
    return out


@dataclass
class Ranker:
    """score = sigmoid(logit(THRESHOLD) + weights . (features - mean) / scale - cut)"""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-20, 20)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(axis=1)  # a row's score doesn't depend on its batch

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(THRESHOLD / (1 - THRESHOLD)) + self.raw(x) - self.cut
        s = 1 / (1 + np.exp(-z.clip(-500, 500)))
        return np.where(self.raw(x) >= self.cut, np.maximum(s, THRESHOLD), np.minimum(s, np.nextafter(THRESHOLD, 0)))


def _logistic(d: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(d))"""
    return 0.5 * (1 - np.tanh(d / 2))


class Moments:
    """Sums over rows of (1, z, z z') at the nodes of a grid of scores w . z, by label: node numbers to arrays."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.sums: dict[int, dict[int, np.ndarray]] = {0: {}, 1: {}}

    def add(self, z: np.ndarray, y: np.ndarray) -> None:
        """Standardised rows and their labels."""
        full = np.column_stack([np.ones(len(z)), z])
        first = np.floor(z @ self.weights / STEP).astype(np.int64) - ORDER // 2 + 1
        at = (z @ self.weights) / STEP - first
        shares = np.ones((len(z), ORDER))
        for p in range(ORDER):
            for q in range(ORDER):
                if p != q:
                    shares[:, p] *= (at - q) / (p - q)
        for label, sums in self.sums.items():
            for cell in np.unique(first[y == label]):
                rows = (first == cell) & (y == label)
                x = full[rows]
                for p in range(ORDER):
                    value = (x * shares[rows, p : p + 1]).T @ x
                    node = int(cell) + p
                    sums[node] = sums[node] + value if node in sums else value

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(label, node, the half of its sums that tells the other)"""
        for label, sums in self.sums.items():
            for node in sorted(sums):
                yield label, node, sums[node][np.triu_indices(len(self.weights) + 1)]

    def put(self, label: int, node: int, half: np.ndarray) -> None:
        full = np.zeros((len(self.weights) + 1,) * 2)
        full[np.triu_indices(len(full))] = half
        self.sums[label][node] = full + np.triu(full, 1).T

    def loss(self, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss of all pairs with ``ridge``, its gradient and its curvature."""
        w, (s, p), (t, q) = self.weights, self._nodes(1), self._nodes(0)
        width, pairs = len(w), p[:, 0, 0].sum() * q[:, 0, 0].sum()
        loss, gradient, curvature = 0.0, np.zeros(width), np.zeros((width, width))
        for i in range(0, len(s), SLICE):  # nodes of label 1, some at once
            d, m = s[i : i + SLICE, None] - t, p[i : i + SLICE]
            loss += m[:, 0, 0] @ np.logaddexp(0, -d) @ q[:, 0, 0]
            k = _logistic(d)
            gradient -= (k @ q[:, 0, 0]) @ m[:, 0, 1:] - (m[:, 0, 0] @ k) @ q[:, 0, 1:]
            k *= 1 - k
            cross = m[:, 0, 1:].T @ k @ q[:, 0, 1:]
            curvature += np.tensordot(k @ q[:, 0, 0], m[:, 1:, 1:], 1) + np.tensordot(m[:, 0, 0] @ k, q[:, 1:, 1:], 1) - cross - cross.T
        return loss / pairs + ridge / 2 * w @ w, gradient / pairs + ridge * w, curvature / pairs + ridge * np.eye(width)

    def _nodes(self, label: int) -> tuple[np.ndarray, np.ndarray]:
        nodes = sorted(self.sums[label])
        return np.array(nodes) * STEP, np.array([self.sums[label][n] for n in nodes])


def minimised(moments: Callable[[np.ndarray], Moments], ridge: float) -> np.ndarray:
    """Weights of the least loss; ``moments``: those of all rows at given weights."""
    w = np.zeros(len(NAMES))
    loss, gradient, curvature = moments(w).loss(ridge)
    for _ in range(50):
        move, t = np.linalg.solve(curvature, gradient), 1.0
        while True:
            there = moments(w - t * move).loss(ridge)
            if there[0] <= loss + 1e-9 or t <= 1e-4:
                break
            t /= 2
        w, (loss, gradient, curvature) = w - t * move, there
        if np.abs(t * move).max() < 1e-6:
            break
    return w


def fit_pairs(better: np.ndarray, worse: np.ndarray, share_worse: float, ridge: float = 1e-2) -> Ranker:
    """Fit on feature rows of preferred and other documents; share_worse: the quantile of the threshold."""
    width = len(NAMES)
    if not len(better) or not len(worse):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    both = np.concatenate([better, worse])
    ranker = Ranker(both.mean(axis=0), both.std(axis=0) + 1e-6, np.zeros(width), 0.0)
    y = np.concatenate([np.ones(len(better), int), np.zeros(len(worse), int)])

    def moments(w: np.ndarray) -> Moments:
        out = Moments(w)
        out.add(ranker.standard(both), y)
        return out

    ranker.weights = minimised(moments, ridge)
    raw = ranker.raw(both)
    weight = np.where(y == 1, (1 - share_worse) / len(better), share_worse / len(worse))
    order = np.argsort(raw, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share_worse - 1e-12))
    below, above = raw[order[min(at, len(raw) - 1)]], raw[order[min(at + 1, len(raw) - 1)]]
    ranker.cut = float((below + above) / 2)
    return ranker


def _sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of finite doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _double(bits: int) -> float:
    """The double of a sortable integer."""
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def ranked_value(scores: Callable[[Callable[[np.ndarray], dict[int, int]]], dict[int, int]], rank: int) -> float:
    """The score of ``rank`` from 0 in ascending order; ``scores`` sums what a function counts over all rows' scores.

    Each pass counts the values of the next DIGIT bits among scores that begin with the bits found: 65,536 numbers at most.
    """
    found = 0
    for shift in range(64 - DIGIT, -1, -DIGIT):

        def digits(raw: np.ndarray, shift: int = shift, found: int = found) -> dict[int, int]:
            bits = _sortable(raw)
            if shift + DIGIT < 64:
                bits = bits[bits >> np.uint64(shift + DIGIT) == np.uint64(found)]
            values, counts = np.unique((bits >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1), return_counts=True)
            return dict(zip(values.tolist(), counts.tolist(), strict=True))

        for digit, count in sorted(scores(digits).items()):
            if rank < count:
                break
            rank -= count
        found = found << DIGIT | digit
    return _double(found)


def feature_rows(docs: DataFrame, labels: DataFrame, teaches: Column, key: str, text: str, label: str) -> DataFrame:
    """(y, x): label and features of every labelled row of ``docs``, as a scratch table.

    Texts are turned into features before they meet labels, so that only features are shuffled; a slot map of the labels'
    ids (8 MiB) holds most other texts back.
    """
    marked = labels.select(F.col(key).alias(key), F.col(label).cast("int").alias("y")).filter(F.col(key).isNotNull() & F.col("y").isin(0, 1) & teaches).distinct()
    slot = id_slot(F.col(key).cast("string"))
    held = docs.sparkSession.sparkContext.broadcast(slot_map(marked.select((slot + 1).alias("s")), "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(set_bits(held.value, batch.column(2).to_numpy())))
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                x = features(piece.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["k", "x"])

    rows = docs.select(F.col(key).alias(key), text_of(text).alias("text")).filter(F.col(key).isNotNull() & teaches)
    rows = rows.select(F.col(key).alias("k"), "text", slot.alias("slot"))
    made = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, x array<double>")
    return materialize(made.join(marked, F.col("k") == F.col(key)).select("y", "x"), "features")


def triples(rows: Iterable[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows (a, b, v)."""
    rows = iter(rows)
    while some := list(islice(rows, SLICE)):
        a, b, v = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.list_(pa.float64()))], names=["a", "b", "v"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of ``v`` for each (a, b); equal ones follow each other."""

    def sums():
        held = None
        for batch in batches:
            for a, b, v in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                v = v.values.to_numpy()
                if held and held[:2] == (a, b):
                    held = a, b, held[2] + v
                    continue
                if held:
                    yield held
                held = a, b, v
        if held:
            yield held

    yield from triples(sums())


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, key: str = "doc_id", text: str = "text", label: str = "quality", ridge: float = 1e-2) -> Ranker:
    """Fit on all rows whose key satisfies ``teaches`` and that ``labels`` marks."""
    width = len(NAMES)
    with scratch_scope(docs.sparkSession):
        rows = feature_rows(docs, labels, teaches, key, text, label)

        def told(work: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], Iterable[tuple[int, int, np.ndarray]]]) -> DataFrame:
            """Rows (a, b, v) that ``work`` makes of a task's (labels, features)."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield from triples(work((b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, width)) for b in batches if b.num_rows))

            return rows.mapInArrow(run, TRIPLE)

        def first(parts):
            n, total = np.zeros(2, np.int64), np.zeros(width)
            for y, x in parts:
                n, total = n + np.bincount(y, minlength=2), total + x.sum(axis=0)
            yield n[0], n[1], total

        got = told(first).collect()
        n = np.array([sum(r.a for r in got), sum(r.b for r in got)])
        if not n.all():
            return fit_pairs(np.zeros((0, width)), np.zeros((0, width)), 0.0)
        mean = sum(np.array(r.v) for r in got) / n.sum()
        got = told(lambda parts: [(0, 0, sum((((x - mean) ** 2).sum(axis=0) for _, x in parts), np.zeros(width)))]).collect()
        ranker = Ranker(mean, np.sqrt(sum(np.array(r.v) for r in got) / n.sum()) + 1e-6, np.zeros(width), 0.0)

        def moments(w: np.ndarray) -> Moments:
            def some(parts):
                held = Moments(w)
                for y, x in parts:
                    held.add(ranker.standard(x), y)
                return held.rows()

            out = Moments(w)
            for r in materialize(told(some).repartition("a", "b").sortWithinPartitions("a", "b", "v").mapInArrow(merged, TRIPLE), "moments").collect():
                out.put(r.a, r.b, np.array(r.v))
            return out

        ranker.weights = minimised(moments, ridge)

        def counted(count: Callable[[np.ndarray], dict[int, int]]) -> dict[int, int]:
            made = told(lambda parts: ((k, v, np.zeros(0)) for _, x in parts for k, v in count(ranker.raw(x)).items()))
            return {r.a: r.n for r in made.groupBy("a").agg(F.sum("b").alias("n")).collect()}

        below, above = (ranked_value(counted, int(r)) for r in (n[0] - 1, n[0]))
        ranker.cut = (below + above) / 2
    return ranker


def score(docs: DataFrame, ranker: Ranker, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, score) of every row; ``keep``: columns to pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                s = ranker.score(features(piece.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(s)], names=[*kinds.names, "score"])

    names = list(dict.fromkeys([key, *(keep or [])]))
    rows, (words, *held) = plain(docs, text, *names)
    rows = rows.select(text_of(words).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(held)])
    kinds = rows.drop("text").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", score double"
    return rows.mapInArrow(run, schema).toDF(*names, "score")
