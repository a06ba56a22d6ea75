"""Language-model scoring with a weighted backoff automaton.

Tokens are words (runs without white space, A-Z lower-cased) and one end per text. Smoothed n-grams of up to ``order``
tokens become states with failure arcs. A state is a history of up to order - 1 tokens, the start of the text counting as
one; an arc (history, token) weighs the discounted relative frequency of the n-gram and leads to the longest state that
ends the n-gram. A token without an arc adds the state's backoff weight and is looked up in the state without its first
token, down to the root: the token's discounted count over all training tokens, plus the discounted mass spread evenly over
the known words and the unknown one. A text is read once from left to right: the state's depth is carried from token to
token, and the weights of the arc and of the failure arcs before it are added up. The events are those of the base score,
all words not seen in training being one, and the weights of each state's words sum to one. Every n-gram of the training
texts seen ``least`` times or more is an arc, whatever the corpus: there is no other limit, so arcs grow with the corpus.

All counts cover all training texts and are exchanged with bounded tasks; nothing of the model is held by the driver or
broadcast. N-grams are told by 64-bit hashes, so that among n of them about n**2 / 2**65 pairs are taken for one (1e9
n-grams: 0.03 pairs).
1. Tasks pack texts into batches of about BATCH tokens. Each batch sends its distinct words and bigrams to the buckets of
   their hashes, and gets corpus counts back. Of the batches that ask for an n-gram, the first is told that it is.
2. For each order from two on, the batches that were first add up for each history what its arcs take, send these sums to
   the histories' buckets, and get the whole sums of all their histories back, which give backoff weights. At the same
   time they ask for the next longer n-grams whose first and last ``order`` tokens are arcs (no others can be).
A frequent n-gram or history is one entry of each batch. Messages number batches times buckets, so both are made large.

Defined cases: null and empty texts are one end; texts are never cut; null ids are scored and, as the caller's condition
is null for them, not learnt from; repeated rows count as often as they occur; with no training texts all counts are 0
and the unknown word has probability 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, runs, text_of
from docloom.llm.minhash import mixed

#: Tokens of a batch; words and tokens of a bucket as goals; tasks over batches at most (a task takes one by one).
BATCH, BUCKET, PAIRS, TASKS = 1_500_000, 400_000, 2_000_000, 100_000
#: Occurrences of an arc. Its share of the tokens (FLOOR) and its gain over the root (GAIN) aren't limited.
LEAST, FLOOR, GAIN = 2, 0.0, 0.0
#: The code of the start of a text.
START = np.uint64(0x5EED0FA57A127000)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str) -> list[bytes]:
    """Words of ``text``; the end is not among them."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shrunk(x: np.ndarray) -> bytes:
    """Compressed bytes of integers, those of equal weight together."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def grown(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    """The ``n`` integers that were shrunk."""
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def packed(docs: DataFrame, teaches: Column, key: str, text: str) -> DataFrame:
    """Batches of texts: (batch, keys, taught, sizes, ids, hashes, n_words, n_tokens, n_taught).

    ids: numbers of all tokens, ends included, in ``hashes``, the words' hashes, of which the first is the end's.
    Batches are numbered from 0 without gaps.
    """
    limit = BATCH
    names = ["part", "seq", "keys", "taught", "sizes", "ids", "hashes", "n_words", "n_tokens", "n_taught"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, taught, sizes, ids, vocab = [], [], [], array("I"), defaultdict(count().__next__)
        part, seq = TaskContext.get().partitionId(), count()

        def out():
            flat = np.frombuffer(ids, np.uint32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))
            row = [
                pa.array([part], pa.int32()), pa.array([next(seq)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([taught], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int32())), pa.array([shrunk(flat)], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
                pa.array([len(vocab)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([sum(n for n, t in zip(sizes, taught, strict=True) if t)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for k, t, s in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    if not ids:
                        vocab[b""]
                    before = len(ids)
                    ids.extend(map(vocab.__getitem__, tokens(s)))
                    ids.append(0)
                    keys.append(k)
                    taught.append(t)
                    sizes.append(len(ids) - before)
                    if len(ids) >= limit:
                        yield out()
                        keys, taught, sizes, ids, vocab = [], [], [], array("I"), defaultdict(count().__next__)
        if keys:
            yield out()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(teaches, F.lit(False)).alias("t"), text_of(text).alias("s"))
    schema = "part int, seq long, keys array<long>, taught array<boolean>, sizes array<int>, ids binary, hashes binary, n_words long, n_tokens long, n_taught long"
    batches = materialize(rows.mapInArrow(run, schema), "batches")
    parts = batches.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each split of the input
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    batches = batches.join(F.broadcast(materialize(parts, "parts")), "part").withColumn("batch", F.col("first") + F.col("seq"))
    return batches.select("batch", *names[2:])


#: What batches and buckets tell each other. role k: n-grams of k tokens, -k: histories of k tokens; batch -2, -3, -4:
#: numbers (n) of the words there are, seen once, seen twice. Questions hold codes and counts or sums, answers the
#: whole counts, and whether the batch was first, or sums.
MESSAGE = "bucket int, role int, batch long, n int, a binary, b binary, c binary, d binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
_NAMES = ["bucket", "role", "batch", "n", "a", "b", "c", "d"]


def message(bucket: int, role: int, batch: int, n: int, arrays: Iterable[np.ndarray | bytes | None]) -> tuple:
    data = [shrunk(x) if isinstance(x, np.ndarray) else x for x in arrays]
    return (bucket, role, batch, n, *data, *[None] * (4 - len(data)))


def messages(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of messages, some at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row[4:] if x)
        if size > 1 << 22 or len(held) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names=_NAMES)


def of_each(rows: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(first columns, tuples of the others) of each run of rows."""
    now, held = None, []
    for key, part in runs(rows, keys):
        if key != now:
            if held:
                yield now, held
            now, held = key, []
        held += zip(*(part.column(i).to_pylist() for i in range(keys, part.num_columns)), strict=True)
    if held:
        yield now, held


def sent(codes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted codes; buckets are ranges of codes."""
    cuts = np.searchsorted((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield k, slice(int(cuts[k]), int(cuts[k + 1]))


def steps(codes: np.ndarray) -> np.ndarray:
    """Differences of sorted codes, which ``np.cumsum`` undoes."""
    return np.diff(codes, prepend=np.uint64(0))


def discount(n1: float, n2: float) -> float:
    """The usual estimate of an absolute discount, from the numbers of n-grams seen once and twice."""
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


class Root:
    """Sizes of the training texts, and the weights of words that no state has an arc for."""

    def __init__(self, total: int, types: int, once: int, twice: int):
        self.total, self.types = total, types
        self.discount = discount(once, twice)
        self.unknown = self.discount * types / total / (types + 1) if total else 1.0

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words in the root, given their corpus counts."""
        if not self.total:
            return np.zeros(len(counts))
        return np.log10(np.maximum(counts - self.discount, 0) / self.total + self.unknown)

    def arcs(self, counts: np.ndarray, histories: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(counts - self.discount, 1e-9) / np.maximum(histories, 1))

    def backoff(self, history: np.ndarray, shorter: np.ndarray | None, arcs: np.ndarray, taken: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 backoff weight of states that occur ``history`` times and without their first token ``shorter`` times
        (None: that is the root), whose ``arcs`` arcs occur ``taken`` times and without their first token ``last`` times.
        What the arcs leave is shared by the other words in proportion to their weights in the shorter state."""
        out, some = np.zeros(len(arcs)), arcs > 0
        h, n, t, w = (x[some].astype(np.float64) for x in (history, arcs, taken, last))
        left = (h - t + self.discount * n) / h
        whole = self.total if shorter is None else shorter[some].astype(np.float64)
        rest = (whole - w + self.discount * n) / whole - (n * self.unknown if shorter is None else 0.0)
        out[some] = np.log10(left / np.maximum(rest, self.unknown if shorter is None else 1e-12))
        return out


class Batch:
    """Texts of a batch with the counts that are known of their n-grams.

    ``codes[k]``: distinct n-grams of k tokens, sorted; ``at[k]``: each token's place among them as their last token, -1
    where there is none; ``counts[k]``: their corpus counts.
    """

    def __init__(self, taught: list, sizes: list, ids: bytes, hashes: bytes):
        self.sizes = np.array(sizes, np.int64)
        n = int(self.sizes.sum())
        self.first = np.cumsum(self.sizes) - self.sizes
        self.taught = np.repeat(np.array(taught, bool), self.sizes)
        self.texts = sum(taught)
        ids, words = grown(ids, n, np.uint32), np.frombuffer(hashes, np.uint64)
        self.code = words[ids]
        codes = np.sort(np.append(words, START))
        self.start = int(np.searchsorted(codes, START))
        self.codes, self.at, self.counts, self.flags = {1: codes}, {1: np.searchsorted(codes, words).astype(np.int32)[ids]}, {}, {}
        self.extend(2, np.ones(n, bool))

    def before(self, k: int) -> np.ndarray:
        """The place of the k tokens before each token, -1 where there are none."""
        out = np.empty_like(self.at[k])
        out[1:] = self.at[k][:-1]
        out[self.first] = self.start if k == 1 else -1
        return out

    def extend(self, k: int, some: np.ndarray) -> None:
        """Number the n-grams of k tokens that end in ``some`` tokens and whose first k - 1 are numbered."""
        history = self.before(k - 1)
        some = some & (history >= 0)
        code = mixed(self.codes[k - 1][history[some]] * _TURN + self.code[some] + np.uint64(k))
        self.codes[k], place = np.unique(code, return_inverse=True)
        self.at[k] = np.full(len(some), -1, np.int32)
        self.at[k][some] = place

    def own(self, k: int) -> np.ndarray:
        """Occurrences of the n-grams of k tokens in the batch's training texts."""
        out = np.bincount(self.at[k][self.taught & (self.at[k] >= 0)], minlength=len(self.codes[k]))
        if k == 1:
            out[self.start] = self.texts
        return out

    def learn(self, k: int, answers: dict, least: int) -> None:
        """Take the counts of ``answers``: {role: messages in the order of buckets}."""
        if k > 2:
            self.extend(k, self.arcs(k - 1, least))
        got = answers.get(k, [])
        self.counts[k] = np.concatenate([np.zeros(0, np.int64), *(grown(a, n) for n, a, *_ in got)])
        if k > 1:
            self.flags[k] = np.concatenate([np.zeros(0, np.uint8), *(grown(b, n, np.uint8) for n, _, b, *_ in got)]) > 0

    def seen(self, k: int, places: np.ndarray, least: int) -> np.ndarray:
        """Whether the n-grams at ``places`` occur ``least`` times in training."""
        if not len(self.counts[k]):
            return np.zeros(len(places), bool)
        return (places >= 0) & (self.counts[k][places] >= least)

    def arcs(self, k: int, least: int) -> np.ndarray:
        """Whether the k tokens before each token and the k tokens up to it are arcs."""
        return self.seen(k, self.before(k), least) & self.seen(k, self.at[k], least)

    def histories(self, k: int, least: int) -> np.ndarray:
        """The places of the states of k tokens whose backoff weights the batch may need: each has training texts."""
        before, some = self.before(k), np.zeros(len(self.codes[k]), bool)
        some[before[before >= 0]] = True
        return np.flatnonzero(some & (self.counts[k] >= (least if k > 1 else 1)))

    def taken(self, k: int, least: int) -> tuple[np.ndarray, ...]:
        """By history of k tokens: numbers of arcs, their occurrences, and those without their first token, for arcs that
        the batch was first to ask for."""
        history = np.zeros(len(self.codes[k + 1]), np.int64)
        some = self.at[k + 1] >= 0
        history[self.at[k + 1][some]] = self.before(k)[some]
        arcs = (self.counts[k + 1] >= least) & self.flags[k + 1]
        sums = [np.zeros(len(self.codes[k]), np.int64) for _ in range(3)]
        for to, x in zip(sums, (np.ones(len(arcs), np.int64), self.counts[k + 1], self.shorter(k + 1)), strict=True):
            np.add.at(to, history[arcs], x[arcs])
        return tuple(sums)

    def traversed(self, root: Root, order: int, least: int, answers: dict) -> np.ndarray:
        """log10 weight of each token, read from left to right."""
        depth = np.zeros(len(self.code), np.int64)  # tokens of the state that has the arc
        out = root.weights(self.counts[1])[self.at[1]]
        failures = []
        for k in range(1, order):
            before = self.before(k)
            arc = self.seen(k + 1, self.at[k + 1], least)
            out[arc] = root.arcs(self.counts[k + 1][self.at[k + 1][arc]], self.counts[k][before[arc]])
            depth[arc] = k
            places = self.histories(k, least)
            got = answers.get(-k, [])
            sums = [np.concatenate([np.zeros(0, np.int64), *(grown(x[j], x[0]) for x in got)]) for j in (1, 2, 3)]
            weights = np.zeros(len(self.codes[k]))
            if len(places):
                weights[places] = root.backoff(self.counts[k][places], None if k == 1 else self.shorter(k)[places], *sums)
            failures.append((before, weights))
        # The state that a token finds is the longest that ends in the arc before it.
        found = np.empty_like(depth)
        found[1:] = np.minimum(depth[:-1] + 1, order - 1)
        found[self.first] = min(1, order - 1)
        for k, (before, weights) in enumerate(failures, 1):
            failed = (found >= k) & (depth < k)
            out[failed] += weights[before[failed]]
        return out

    def shorter(self, k: int) -> np.ndarray:
        """Corpus counts of the n-grams of k tokens without their first one."""
        out = np.zeros(len(self.codes[k]), np.int64)
        some = self.at[k] >= 0
        out[self.at[k][some]] = self.counts[k - 1][self.at[k - 1][some]]
        return out


def asked(batches: DataFrame, buckets: int) -> DataFrame:
    """Messages about words and bigrams: differences of codes, and occurrences."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for number, taught, sizes, ids, hashes in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                texts = Batch(taught, sizes, ids, hashes)
                for k in (1, 2):
                    own = texts.own(k)
                    yield from messages(message(b, k, number, s.stop - s.start, [steps(texts.codes[k][s]), own[s]]) for b, s in sent(texts.codes[k], buckets))

    return batches.select("batch", "taught", "sizes", "ids", "hashes").mapInArrow(run, MESSAGE)


def answered(role: int, bucket: int, held: list[tuple]) -> Iterator[tuple]:
    """What a bucket says about the messages of a role; ``held``: (batch, n, a, b, c, d)."""
    codes = np.concatenate([np.cumsum(grown(a, n, np.uint64), dtype=np.uint64) for _, n, a, *_ in held])
    order = np.argsort(codes)
    new = np.ones(len(codes), bool)
    new[1:] = np.diff(codes[order]) > 0
    starts = np.flatnonzero(new)
    place = np.empty(len(codes), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = [np.add.reduceat(np.concatenate([grown(x[j], x[1]) for x in held])[order], starts) for j in (range(3, 6) if role < 0 else range(3, 4))]
    first = np.zeros(len(codes), np.uint8)
    first[np.minimum.reduceat(order, starts)] = 1
    at = 0
    for x in held:
        here = slice(at, at + x[1])
        yield message(bucket, role, x[0], x[1], [*(s[place[here]] for s in sums), *([first[here]] if role > 1 else [])])
        at += x[1]
    if role == 1:
        words = sums[0][codes[order][starts] != START]
        for k, n in enumerate((words > 0, words == 1, words == 2)):
            yield message(bucket, role, -2 - k, int(n.sum()), [])


def exchanged(rows: DataFrame, buckets: int) -> DataFrame:
    """The buckets' answers to messages."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, role), held in of_each(rows, 2):
            yield from messages(answered(role, bucket, held))

    rows = rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "role", "batch")
    return materialize(rows.mapInArrow(run, MESSAGE), "answers")


def by_batch(batches: DataFrame, n: int, answers: list[DataFrame]) -> DataFrame:
    """Answers to each batch, and its texts behind them."""
    texts = ["keys", "taught", "sizes", "ids", "hashes"]
    nothing = lambda names: [F.lit(None).alias(c) for c in names]
    rows = batches.select("batch", F.lit(1 << 20).alias("role"), F.lit(-1).alias("bucket"), F.lit(0).alias("n"), *nothing("abcd"), *texts)
    for x in answers:
        rows = rows.unionAll(x.filter("batch >= 0").select("batch", "role", "bucket", "n", *"abcd", *nothing(texts)))
    tasks = max(1, min(n, TASKS))
    rows = rows.repartitionById(tasks, F.floor(F.col("batch") * tasks / n).cast("int"))
    return rows.sortWithinPartitions("batch", "role", "bucket")


def met(rows: Iterator[pa.RecordBatch], known: int, least: int) -> Iterator[tuple[int, list, list, Batch, dict]]:
    """(batch, keys, taught, texts, answers) of ``by_batch`` rows, counts of up to ``known`` tokens being answered."""
    for (number,), held in of_each(rows, 1):
        answers: dict[int, list] = {}
        for role, _, n, a, b, c, d, keys, taught, sizes, ids, hashes in held:
            if sizes is None:
                answers.setdefault(role, []).append((n, a, b, c, d))
                continue
            texts = Batch(taught, sizes, ids, hashes)
            for k in range(1, known + 1):
                texts.learn(k, answers, least)
            yield number, keys, taught, texts, answers


def score_texts(docs: DataFrame, teaches: Column, key: str = "doc_id", text: str = "text", order: int = 2, least: int = LEAST) -> DataFrame:
    """(key, taught, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows that teach."""
    batches = packed(docs, teaches, key, text)
    size = batches.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"), F.sum("n_taught").alias("total"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, size.n)
    buckets = max(12, math.ceil((size.words or 0) / BUCKET), math.ceil((size.tokens or 0) / PAIRS))
    answers = [exchanged(asked(batches, buckets), buckets)]
    seen = answers[0].agg(*[F.sum(F.when(F.col("batch") == -2 - i, F.col("n"))) for i in range(3)]).first()
    root = Root(size.total or 0, *(x or 0 for x in seen))
    for k in range(2, order + 1):

        def ask(rows: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for number, _, _, texts, _ in met(rows, k, least):
                places = texts.histories(k - 1, least)
                codes, sums = texts.codes[k - 1][places], [x[places] for x in texts.taken(k - 1, least)]
                yield from messages(message(b, 1 - k, number, s.stop - s.start, [steps(codes[s]), *(x[s] for x in sums)]) for b, s in sent(codes, buckets))
                if k < order:
                    texts.extend(k + 1, texts.arcs(k, least))
                    codes, own = texts.codes[k + 1], texts.own(k + 1)
                    yield from messages(message(b, k + 1, number, s.stop - s.start, [steps(codes[s]), own[s]]) for b, s in sent(codes, buckets))

        answers.append(exchanged(by_batch(batches, n, answers).mapInArrow(ask, MESSAGE), buckets))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, taught, texts, told in met(rows, max(2, order), least):
            counts = texts.counts[1]
            known, base = (counts > 0).astype(np.int64), np.log10((counts + 1) / (root.total + root.types + 1))
            out = [np.add.reduceat(x, texts.first) for x in (known[texts.at[1]], base[texts.at[1]], texts.traversed(root, order, least, told))]
            arrays = [
                pa.array(keys, pa.int64()), pa.array(taught, pa.bool_()), pa.array(texts.sizes), pa.array(out[0]),
                pa.array(np.full(len(keys), root.total, np.int64)), pa.array(out[1]), pa.array(out[2]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "taught", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = by_batch(batches, n, answers).mapInArrow(run, "key long, taught boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
