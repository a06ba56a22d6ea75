"""Line dedup against a brute force that finds its own passages, over frequent and rare ones and colliding hashes."""

import random

import pytest
import xxhash

from docloom.llm import common, linededup


def passages(text, words=50):
    """(first line, end) of the documented passages, found the slow way."""
    lines = text.encode().split(b"\n")
    n = [len(x.split()) for x in lines]
    out, start, last = set(), 0, 0
    for i, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line)
        rolled = (h * 0x9E3779B97F4A7C15 + last * 0xC2B2AE3D27D4EB4F) % 2**64
        last = h
        if i == len(lines) - 1 or (i > start and (rolled >> 32) % 3 == 0):
            if i > start:
                out.add((start, i + 1))
            start = i + 1
    for i in range(len(lines)):
        if n[i] > words:
            out.add((i, i + 1))
        ends = [j for j in range(i, len(lines)) if n[i] and n[j] and sum(n[i : j + 1]) > words]
        starts = [j for j in range(i + 1) if n[i] and n[j] and sum(n[j : i + 1]) > words]
        if ends:
            out.add((i, min(ends) + 1))
        if starts:
            out.add((max(starts), i + 1))
    return [(s, e) for s, e in sorted(out) if b"\n".join(lines[s:e]).strip()]


def expected(texts):
    """{id: text} after each passage that occurs again has gone everywhere but where it is first."""
    seen = {}
    for i, t in sorted(texts.items()):
        lines = (t or "").split("\n")
        for s, e in passages(t or ""):
            seen.setdefault("\n".join(lines[s:e]), []).append((i, s))
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        gone = {k for s, e in passages(t or "") if seen["\n".join(lines[s:e])][0] != (i, s) for k in range(s, e)}
        out[i] = t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def documents():
    rng = random.Random(21)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    hot = [line(rng.choice([3, 20, 60])) for _ in range(6)]
    rare = [[line(rng.choice([0, 4, 9, 30, 70])) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    texts = {}
    for i in range(60):
        parts = [[line(5) for _ in range(rng.randint(0, 3))], *rng.sample(rare, rng.choice([0, 1, 1, 2])), [line(5)]]
        if i % 3 == 0:
            parts.insert(1, hot)
        texts[i] = "\n".join(x for p in parts for x in p)
    return texts | {100: None, 101: "", 102: "\n\n", 103: texts[3], 104: "\n".join(hot * 2), 105: "one\n" * 200, 106: "é " * 60 + "\n" + hot[0]}


@pytest.mark.parametrize("most", [10_000, 25, 0.5])
def test_frequent_and_rare_passages(spark, monkeypatch, most):
    """10,000: all are joined by broadcast; 25: the frequent ones; 0.5: none."""
    monkeypatch.setattr(common, "FREQUENT", most)
    texts = documents()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, _list string")
    got = linededup.without_repeated_chunks(docs.repartition(4))
    rows = {r.doc_id: r for r in got.collect()}
    want = expected(texts)
    assert {i: r.text for i, r in rows.items()} == want and got.columns == ["doc_id", "text", "_list", "n_lines", "n_removed_lines"]
    for i, t in texts.items():
        assert rows[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert rows[i].n_lines - rows[i].n_removed_lines == (0 if t is None else want[i].count("\n") + 1) or not want[i]
    assert sum(t != want[i] for i, t in texts.items()) > 20


@pytest.mark.parametrize("values", [1, 40])
def test_hashes_that_collide_are_told_apart_by_bytes(spark, values):
    texts = documents()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = linededup.without_repeated_chunks(docs.repartition(4), digest=lambda c: (len(c) * 7 + c[0]) % values)
    assert {r.doc_id: r.text for r in got.collect()} == expected(texts)


def test_rows_that_share_an_id_and_a_text(spark):
    text = "\n".join(f"line {k} of some words" for k in range(40))
    docs = spark.createDataFrame([(7, text), (7, text), (7, text), (8, "own\n" + text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in linededup.without_repeated_chunks(docs).collect())
    assert [r[1] for r in got[:3]] == [text] * 3 and "line 20" not in got[3][1] and got[3][1].startswith("own")
