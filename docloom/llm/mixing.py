"""Mixing to target weights with soft membership.

A softmax classifier of domains is fitted on labelled documents and gives each document's posterior p over the domains.
Document rates r >= lowest are fitted so that the expected domain totals of tokens, sum of r * tokens * p, match the
targets: least squares by projected gradient. A gradient step changes a document's rate by -p . u, u being the residual
of all domains in the metric of the second moments of the documents whose rate isn't at its bound; so the state is the
short list of vectors u, each iteration is one distributed sum of a vector, and rates are replayed from the list wherever
they are needed. A step that makes the residual worse is taken back and replaced by one in the metric of all documents,
which can't. The fit ends when the residual is at most MET of the targets' tokens. Where a plain step gains less than
LITTLE of the residual, or after ITERATIONS, it ends too, with a warning; the result tells the residual and whether it
was met, as targets need not be within the bounds' reach.

The classifier is fitted on all labelled rows: its loss with a ridge has one minimum, which L-BFGS approaches until no part
of the gradient is above FLAT; each loss and gradient is one distributed sum. Features of labelled rows are a scratch
table, and the driver holds PAST pairs of vectors of the weights' size, which grows with domains, not with rows. Counts of
tokens, moments and residuals are over all documents.

Defined cases: null and empty texts have no tokens and get the posterior of the classifier's bias; labelled rows of null
domain don't teach; with no labelled rows there is one domain, ''; with fewer domains than targets, the others' targets
are spread over those there are; no tokens at all: every rate is 1; repeated rows get equal rates; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import id_slot, materialize, plain, set_bits, slot_map, text_of
from docloom.llm.minhash import word_hashes
from docloom.sources.scratch import scratch_scope

#: Buckets of hashed words; features; iterations at most.
BUCKETS, WIDTH, ITERATIONS = 512, 256 + 512, 60
#: Largest part of the gradient at the classifier's minimum; steps to it at most, beyond which it warns; steps remembered.
FLAT, STEPS, PAST = 1e-8, 1_000, 50
#: A feature that isn't 0.
CELL = np.dtype([("at", "<u2"), ("value", "<f4")])
#: Shares of the targets' tokens that a met residual has at most, and of the residual that a plain step has to gain.
MET, LITTLE = 1e-6, 0.02
#: How many times the tokens that let every domain keep its own are resampled at most, so that targets are in reach.
REACH = 2.0
SLICE = 256


def bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, tokens): unit-length roots of counts of bytes and hashed words of each text, and its number of words."""
    x, tokens = np.zeros((len(texts), WIDTH), np.float32), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        words, _ = word_hashes(data)
        tokens[k] = len(words)
        if len(words):
            x[k, :256] = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
            x[k, 256:] = np.bincount((words % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / len(words)
    return np.sqrt(x), tokens


@dataclass
class Domains:
    """Softmax classifier."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def packed(x: np.ndarray) -> pa.Array:
    """Each row's cells that aren't 0, as bytes."""
    row, column = np.nonzero(x)
    cells = np.empty(len(row), CELL)
    cells["at"], cells["value"] = column, x[row, column]
    ends = np.searchsorted(row, np.arange(len(x) + 1)) * CELL.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cells.tobytes())])


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of ``packed``, each with a 1 behind."""
    cells = np.frombuffer(b"".join(column.to_pylist()), CELL)
    x = np.zeros((len(column), WIDTH + 1))
    x[np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy() // CELL.itemsize), cells["at"]] = cells["value"]
    x[:, -1] = 1
    return x


def labelled_bags(docs: DataFrame, labelled: DataFrame, domain: str, key: str, text: str) -> DataFrame:
    """(y, x): domain and packed features of every row of ``docs`` whose key is in ``labelled``, as a scratch table.

    Texts are turned into features before they meet the keys, so that only features are shuffled; a slot map of the keys
    (8 MiB) holds most other texts back.
    """
    kind = docs.select(key).union(labelled.select(key)).schema[0].dataType  # as a join compares them
    keys = labelled.select(F.col(key).cast(kind).alias("k")).filter("k IS NOT NULL").distinct()
    held = docs.sparkSession.sparkContext.broadcast(slot_map(keys.select((id_slot("k") + 1).alias("s")), "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(set_bits(held.value, batch.column(0).to_numpy())))
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                x, _ = bag(piece.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), packed(x)], names=["k", "y", "x"])

    rows = docs.select(F.col(key).cast(kind).alias("k"), F.col(domain).cast("string").alias("y"), text_of(text).alias("text"))
    rows = rows.filter("k IS NOT NULL AND y IS NOT NULL").select(id_slot("k").alias("slot"), "k", "y", "text")
    made = rows.mapInArrow(run, f"k {kind.simpleString()}, y string, x binary")
    made = made.join(keys.hint("merge"), "k", "left_semi").sortWithinPartitions("k", "y", "x")  # a rerun has the same order
    return materialize(made.select("y", "x"), "bags")


def softmax_loss(bags: DataFrame, names: list[str], n: int, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The mean loss of all ``n`` rows of ``bags`` at weights ``w`` (biases last) with ``ridge``, and its gradient.

    Tasks' sums are added in the order of their values, so a rerun gives the same numbers.
    """
    domains = pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros(w.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                x, y = unpacked(piece.column(1)), pc.index_in(piece.column(0), domains).to_numpy()
                own = np.arange(len(y)), y
                z = x @ w
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                total = p.sum(axis=1)
                loss += (np.log(total) - z[own]).sum()
                p /= total[:, None]
                p[own] -= 1
                gradient += x.T @ p
        out = np.append(gradient.ravel(), loss)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["k", "v"])

    told = bags.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v"))
    got = told.select("k", F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("v")).toArrow()
    out = np.zeros(w.size + 1)
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out[-1] / n + ridge / 2 * (w * w).sum(), out[:-1].reshape(w.shape) / n + ridge * w


def minimised(loss_at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """Weights of the least loss, by L-BFGS from ``w``; ``loss_at``: (loss, gradient) at given weights."""
    loss, gradient = loss_at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(gradient).max() <= FLAT:
            return w
        move, shares = gradient.copy(), []
        for s, d in reversed(past):
            shares.append((s * move).sum() / (s * d).sum())
            move -= shares[-1] * d
        if past:
            s, d = past[-1]
            move *= (s * d).sum() / (d * d).sum()
        for (s, d), share in zip(past, reversed(shares), strict=True):
            move += s * (share - (d * move).sum() / (s * d).sum())
        t, slope = 1.0, (move * gradient).sum()
        while True:
            there = loss_at(w - t * move)
            if there[0] <= loss - 1e-4 * t * slope + 1e-12 or t <= 1e-6:
                break
            t /= 2
        s, d = -t * move, there[1] - gradient
        if (s * d).sum() > 0:  # but for rounding, it is
            past = [*past, (s, d)][-PAST:]
        w, (loss, gradient) = w - t * move, there
    warnings.warn(f"the classifier's gradient is {np.abs(gradient).max():.3g} after {STEPS} steps", stacklevel=2)
    return w


def fit_domains(docs: DataFrame, labelled: DataFrame, domain: str, key: str = "doc_id", text: str = "text", ridge: float = 1e-3) -> Domains:
    """Fit on all documents whose key is in ``labelled``; ``domain``: a column of ``docs``."""
    with scratch_scope(docs.sparkSession):
        bags = labelled_bags(docs, labelled, domain, key, text)
        counts = {r.y: r.n for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        names = sorted(counts) or [""]
        if len(names) < 2:
            return Domains(names, np.zeros((WIDTH, 1)), np.zeros(1))
        n = sum(counts.values())
        w = minimised(lambda w: softmax_loss(bags, names, n, w, ridge), np.zeros((WIDTH + 1, len(names))))
    return Domains(names, w[:-1], w[-1])


def posteriors(docs: DataFrame, domains: Domains, key: str, text: str) -> DataFrame:
    """(key, h, tokens, p) of every row; h: 64-bit hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(domains.names)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                x, tokens = bag(piece.column(2).to_pylist())
                p = domains.posterior(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * k, pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(tokens), lists], names=["key", "h", "tokens", "p"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, h long, tokens long, p array<double>")


def replayed(p: np.ndarray, moves: list[np.ndarray], lowest: float) -> np.ndarray:
    """Rates after the gradient steps ``moves``, each projected."""
    r = np.ones(len(p))
    for u in moves:
        r = np.maximum(lowest, r - p @ u)
    return r


def sums(members: DataFrame, k: int, moves: list[np.ndarray], lowest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(totals, free, parts): expected tokens of each domain after ``moves``, second moments of the documents whose rate
    is above ``lowest``, and by likeliest domain the expected tokens at a rate of 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, free, parts = np.zeros(k), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy().astype(np.float64)
                p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                r = replayed(p, moves, lowest)
                tp = p * t[:, None]
                total += r @ tp
                free += tp[r > lowest].T @ p[r > lowest]
                np.add.at(parts, p.argmax(axis=1), tp)
        out = np.concatenate([total, free.ravel(), parts.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["k", "v"])

    out = np.zeros(k + 2 * k * k)
    for r in members.select("tokens", "p").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out[:k], out[k : k + k * k].reshape(k, k), out[k + k * k :].reshape(k, k)


@dataclass
class Fit:
    """Gradient steps, the largest residual as a share of the targets' tokens, and whether it is at most MET."""

    moves: list[np.ndarray]
    residual: float
    met: bool


def fit_rates(members: DataFrame, targets: np.ndarray, lowest: float, begin: tuple | None = None) -> Fit:
    """Rates of ``members`` (tokens, p) whose expected totals are nearest to ``targets``; ``begin``: ``sums`` of all documents."""
    k = len(targets)

    def metric(moments: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(moments + 1e-9 * scale * np.eye(k))

    def off(totals: np.ndarray) -> float:
        return float(np.abs(totals - targets).max() / targets.sum()) if targets.sum() > 0 else 0.0

    totals, whole, _ = begin or sums(members, k, [], -np.inf)
    scale = np.trace(whole)
    best = Fit([], off(totals), off(totals) <= MET)
    if scale <= 0 or best.met:
        return Fit([], best.residual, True) if scale <= 0 else best
    at, free, plain_step = totals, whole, True
    for _ in range(ITERATIONS):
        moves = [*best.moves, metric(free) @ (at - targets)]
        totals, above, _ = sums(members, k, moves, lowest)
        gain = 1 - off(totals) / best.residual
        if gain > 0:
            best, at, free = Fit(moves, off(totals), off(totals) <= MET), totals, above
        if best.met or plain_step and gain < LITTLE:
            break
        # After a step that gained little or nothing, one in the metric of all documents.
        plain_step = gain < LITTLE
        if plain_step:
            free = whole
    if not best.met:
        warnings.warn(f"rates of at least {lowest} leave a residual of {best.residual:.3g} of the target tokens after {len(best.moves)} steps", stacklevel=2)
    return best


def reachable(parts: np.ndarray, weights: np.ndarray) -> float:
    """The fewest tokens that mix to ``weights`` (shares) when no document's rate is under 1.

    Each domain keeps its own tokens, and what the documents of a likeliest domain are repeated adds to all domains in the
    shares of their posteriors, as ``parts`` has them by likeliest domain. At most REACH times the first bound.
    """
    have = parts.sum(axis=0)
    least = max(have.sum(), *(have[weights > 0] / weights[weights > 0]))
    some = parts.sum(axis=1) > 0
    leak = np.linalg.pinv((parts[some] / parts[some].sum(axis=1, keepdims=True)).T)
    up, own = leak @ weights, leak @ have
    return float(min(REACH * least, max(least, *(own[up > 1e-9] / up[up > 1e-9]), 0.0)))


def target_totals(names: list[str], weights: dict[str, float], tokens: float) -> np.ndarray:
    """Token targets of the domains there are; weights are normalised over them (all equal if none is named)."""
    w = np.array([max(0.0, weights.get(n, 0.0)) for n in names])
    w = w if w.sum() > 0 else np.ones(len(names))
    return tokens * w / w.sum()


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], domain: str = "lang", lowest: float = 0.0,
    upsample: bool = False, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, h, n_tokens, domain, posterior, rate, residual, met) of every row; the last two are those of the fit.

    The targets' sum is the tokens of all documents, or, with ``upsample``, as many as let every domain keep its own.
    """
    domains = fit_domains(docs, labelled, domain, key, text)
    members = materialize(posteriors(docs, domains, key, text), "posteriors")
    k = len(domains.names)
    begin = sums(members, k, [], -np.inf)
    have, _, parts = begin
    targets = target_totals(domains.names, weights, float(have.sum()))
    if upsample and have.sum() > 0:
        targets = targets / targets.sum() * reachable(parts, targets / targets.sum())
    fit = fit_rates(members, targets, lowest, begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(3).flatten().to_numpy().reshape(-1, k)
            best = pa.array([domains.names[i] for i in p.argmax(axis=1)] if len(p) else [], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], best, batch.column(3), pa.array(replayed(p, fit.moves, lowest))], names=["key", "h", "n_tokens", "domain", "posterior", "rate"])

    kind = members.schema["key"].dataType.simpleString()
    out = members.mapInArrow(run, f"key {kind}, h long, n_tokens long, domain string, posterior array<double>, rate double")
    return out.withColumnRenamed("key", key).withColumns({"residual": F.lit(fit.residual), "met": F.lit(fit.met)})


def resampled(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: its whole part, and once more with its fraction's probability.

    Chance is a hash of the row's key and text, so a rerun gives the same rows.
    """
    chance = F.pmod(F.xxhash64(F.lit("mix"), key, "h"), F.lit(1 << 30)) / float(1 << 30)
    times = mixed.select(F.col(key).alias("key"), F.col("h").alias("g"), F.floor(F.col("rate") + chance).cast("int").alias("times"))
    times = times.groupBy("key", "g").agg(F.max("times").alias("times")).filter("times > 0")
    rows, (id_, words) = plain(docs, key, text)
    names = rows.columns
    rows = rows.withColumn("h", F.xxhash64(words)).join(times, F.col(id_).eqNullSafe(F.col("key")) & (F.col("h") == F.col("g")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*names).toDF(*docs.columns)
