"""The backoff automaton of several orders against a walk over dictionaries."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import lm


class Automaton:
    """Brute force: states are tuples of tokens, None being the start; arcs and failure arcs are dictionaries."""

    def __init__(self, texts, order, least):
        self.order, grams = order, Counter()
        for t in texts:
            for k in range(len(t)):
                for n in range(1, order + 1):
                    if k - n + 1 >= -1:
                        grams[tuple([None, *t][k - n + 2 : k + 2])] += 1
        words = {g: c for g, c in grams.items() if len(g) == 1}
        self.words, self.total = {g[0]: c for g, c in words.items()}, sum(words.values())
        once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        self.unknown = d * len(words) / self.total / (len(words) + 1)
        self.root = {g[0]: (c - d) / self.total + self.unknown for g, c in words.items()}
        times = Counter({(None,): len(texts)})
        for g, c in grams.items():
            times[g] = c
        self.arcs = {}
        for g, c in grams.items():
            if len(g) > 1 and c >= least:
                self.arcs.setdefault(g[:-1], {})[g[-1]] = (c - d) / times[g[:-1]]
        self.fails = {}
        for h in sorted(self.arcs, key=len):
            left = 1 - sum(self.arcs[h].values())
            self.fails[h] = left / (1 - sum(self.p(h[1:], w) for w in self.arcs[h]))

    def p(self, state, word):
        if not state:
            return self.root.get(word, self.unknown)
        if word in self.arcs.get(state, {}):
            return self.arcs[state][word]
        return self.fails.get(state, 1.0) * self.p(state[1:], word)

    def score(self, text):
        """One walk that carries the state."""
        state, total = (None,), 0.0
        for w in text:
            while state and w not in self.arcs.get(state, {}):
                total += math.log10(self.fails.get(state, 1.0))
                state = state[1:]
            total += math.log10(self.arcs[state][w] if state else self.p((), w))
            state = (*state, w)[-(self.order - 1) :]
        return total


@pytest.mark.parametrize("order, least", [(2, 1), (3, 2), (3, 1), (4, 2)])
def test_orders_against_a_walk(spark, monkeypatch, order, least):
    monkeypatch.setattr(lm, "BATCH", 900)
    monkeypatch.setattr(lm, "BUCKET", 300)
    rng = random.Random(order * 10 + least)
    phrases = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "Same text twice " * 3), (203, "same TEXT twice " * 3), (204, "a " * 3000), (None, "w1 w2"), (205, " \t\n"), (202, "again")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, batch long")
    taught = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    words = [((t or "").lower().split()) + ["</end>"] for _, t in rows]
    model = Automaton([w for (i, _), w in zip(rows, words, strict=True) if taught(i)], order, least)
    teaches = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = lm.score_texts(docs.repartition(4), teaches, order=order, least=least).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    expected = sorted(((i, len(w), sum(x in model.words for x in w), model.total, model.score(w)) for (i, _), w in zip(rows, words, strict=True)), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got), key=key)
    assert [x[:4] for x in got] == [x[:4] for x in expected]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in expected], rel=1e-9)
    assert any(len(h) == order - 1 for h in model.arcs)
    # The walk adds up the model's probabilities, and those of each state sum to one, the unknown word included.
    w = words[3]
    histories = [tuple([None, *w][max(0, k - order + 2) : k + 1]) for k in range(len(w))]
    assert model.score(w) == pytest.approx(sum(math.log10(model.p(h, x)) for h, x in zip(histories, w, strict=True)))
    for state in [*list(model.arcs)[:20], ()]:
        assert sum(model.p(state, x) for x in [*model.words, "not a word"]) == pytest.approx(1)


def test_more_texts_give_more_arcs(spark):
    """A trigram of any small share of all tokens is scored by its own arc."""
    rows = [(1, "x y " * 400_000), (2, "far left right"), (3, "far left right"), (4, "far left right")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_texts(docs, F.col("doc_id") < 4, order=3).collect()}
    d = lm.discount(0, 3)
    assert got[4] == pytest.approx(math.log10((2 - d) / 3) + 3 * math.log10((2 - d) / 2))
