"""Formatting, tokens, fingerprints, archives and lines: exact round trips and brute force."""

import hashlib
import io
import random
import unicodedata

import public_tokenizers
import pytest

from docloom.llm import bpe, chat, fingerprint, linededup, warc
from docloom.llm.common import materialize, plain

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


# Chat formatting


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns string")
    return {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "<+>", "\\l\\\\h#<", "", "a</turn>\n### user: b", "\\", "x" * 200_000, "é漢😀\r\n "]
    rows = [(1, i, ["user", "assistant"][(i // 2) % 2], t, "f", "t") for i, t in enumerate(texts)]
    got = formatted(spark, rows)[1]
    flat = [(b.role, t) for b in got.blocks for t in b.texts]
    assert flat == [(r[2], r[3]) for r in rows]
    assert len(got.blocks) == 4  # adjacent turns of a role are one block


def test_chat_edges(spark):
    rows = [(1, 2, "user", "b", "", ""), (1, 2, "user", "a", "", ""), (1, None, None, None, "", ""), (None, 1, "a: b <", "x", "", ""), (1, 2, "user", "a", "", "")]
    got = formatted(spark, rows)
    assert [(b.role, list(b.texts)) for b in got[1].blocks] == [("", [""]), ("user", ["a", "a", "b"])]
    assert [(b.role, list(b.texts)) for b in got[None].blocks] == [("a: b <", ["x"])]
    assert formatted(spark, []) == {}


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.parse_conversations(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.byte_bpe(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_tiktoken(coder, reference):
    rng = random.Random(3)
    pool = "abc xyz ABC  \n\t\r\x0b\x0c\x1c\x85\xa0 　é漢字ß12٣½²'s'll!?.,<|>😀‍́\0"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", "<|endoftext|>", "a" * 5000, " " * 3000, "word " * 40_000, "漢字 kana " * 20_000, "the the'll don't 123"]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids.tolist()) == text.encode()


def test_bpe_offsets_cover_split_characters(coder):
    text = "a😀漢é b"
    spans = coder.offsets(text)
    ids = coder.encode([text])[0].tolist()
    assert len(spans) == len(ids) and spans[0][0] == 0 and spans[-1][1] == len(text)
    for (s, e), i in zip(spans, ids, strict=True):
        assert coder.bytes_of[i] in text[s:e].encode()


def test_bpe_frames(spark, reference):
    rows = [(1, "a b", "x"), (2, None, "x"), (None, "", "x"), (1, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.digest_documents(docs, PATH, public_tokenizers.PATTERN).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(reference.encode_ordinary("a b"))
    assert got == [(0, 0, sha("")), (1, n, sha("a b")), (1, n, sha("a b")), (2, 0, sha(""))]
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


# Fingerprints


def test_canonical():
    assert fingerprint.canonical("  Ａ B\n ﬁ ") == fingerprint.canonical("a b FI") == b"a b fi"
    assert fingerprint.canonical("é") == unicodedata.normalize("NFKC", "é").encode()


def test_edited_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "z" * 50_000, "same", "same", "Same "]
    ids = rng.sample(range(-500, 500), len(texts))
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, canon string, part string")
    for chars in (8_000_000, 40):
        fingerprint.RANGE_CHARS = chars
        got = {r.doc_id: r for r in fingerprint.edited_likeness(docs.repartition(5)).collect()}
        order = sorted(zip(ids, [t or "" for t in texts], strict=True))
        assert len(got) == len(order)
        for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
            half = len(t) // 2
            edited = t[: len(t) - half] + following[:half]
            r, c = got[i], fingerprint.canonical
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == fingerprint.digest(c(t)).hex() and r.edited_fingerprint == fingerprint.digest(c(edited)).hex()
            assert (r.near_edited, r.near_next) == (float(c(t) == c(edited)), float(c(t) == c(following)))
    fingerprint.RANGE_CHARS = 8_000_000


def test_fingerprint_edges(spark):
    docs = spark.createDataFrame([(None, "x"), (1, "X "), (1, "y"), (1, "y")], "doc_id long, text string")
    got = fingerprint.fingerprints(docs).collect()
    assert len({r.fingerprint for r in got}) == 2 and len(got) == 4
    assert fingerprint.edited_likeness(docs).count() == 4
    assert fingerprint.edited_likeness(docs.limit(0)).count() == 0


def test_unequal_bytes_of_one_digest_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "d", bytearray(b"a")), (2, "d", bytearray(b"b")), (3, "d", bytearray(b"a")), (4, "e", None)], "id int, f string, c binary")
    got = {r.id: r.f for r in fingerprint.named(rows, [("f", "c")]).collect()}
    assert got == {1: "d", 2: "d-1", 3: "d", 4: "e"}


# WARC


def test_reader_owns_each_record_once():
    rng = random.Random(2)
    inner = warc.member(warc.record_bytes(99, "u", b"inner", "d", None, "t"), 0)
    payloads = [rng.randbytes(rng.randint(0, 400)) for _ in range(40)] + [inner * 3, b"x" * 5000]
    data = b"".join(warc.member(warc.record_bytes(i, "http://h", p, hashlib.sha256(p).hexdigest(), None, "t"), i % 2 * 6) for i, p in enumerate(payloads))
    for size in (1 << 20, 1000, 97):
        found = []
        for start in range(0, len(data), size):
            file = warc._Reader(io.BytesIO(data), len(data))
            found += warc.records_in_range(file, start, min(len(data), start + size))
        if size > 1000:
            assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == payloads
        ids = [f["warc-record-id"] for f, _ in found if f["warc-record-id"] != warc.record_id(99)]
        assert ids == [warc.record_id(i) for i in range(len(payloads))]
    with pytest.raises(ValueError):
        warc.records_in_range(warc._Reader(io.BytesIO(data[:-9]), len(data) - 9), 0, len(data))


def test_archive_round_trip(spark):
    long = "é" * 60
    rows = [(5, "u", long), (3, "u\r\nX: y", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (3, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark, pages).collect())
    assert got == [(0, 120, "revisit", 3), (1, 5, "response", None), (2, 5, "response", None), (3, 120, "response", None), (3, 120, "response", None), (4, 0, "response", None), (5, 120, "revisit", 3), (9, 120, "revisit", 3)]
    assert warc.archived(spark, pages.limit(0)).count() == 0


def test_headers_of_any_length(spark):
    rng = random.Random(3)
    urls = ["http://h/" + rng.randbytes(n).hex() for n in (10, 50_000, 400_000, 10, 100_000)] + ["u" * 3_000_000]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.archived(spark, pages.repartition(1)).collect()) == list(range(len(urls)))
    data = [warc.member(warc.record_bytes(i, u, b"x", "d", None, "t")) for i, u in enumerate(urls)]
    for one in data:
        assert warc._is_member(warc._Reader(io.BytesIO(one), len(one)), 0)


def test_records_that_are_not_read_raise(spark, monkeypatch):
    ranges = warc.ranges
    monkeypatch.setattr(warc, "ranges", lambda files: ranges(files).limit(0))
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    with pytest.raises(Exception, match="records were written"):
        warc.archived(spark, pages).collect()


# Line dedup


def expected_lines(texts):
    """Brute force: {id: text}."""
    count, owner = {}, {}
    for i, t in sorted(texts.items()):
        for _, _, c in linededup.chunks(t or ""):
            count[c] = count.get(c, 0) + 1
            owner.setdefault(c, i)
    out = {}
    for i, t in texts.items():
        lines, drop, seen = (t or "").split("\n"), set(), set()
        for first, n, c in linededup.chunks(t or ""):
            if count[c] > 1 and (owner[c] != i or c in seen):
                drop |= set(range(first, first + n))
            seen.add(c)
        out[i] = t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    passage = [f"shared line {k}" for k in range(30)]
    texts = {}
    for i in range(40):
        own = [f"{rng.random()}" for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(own))
        texts[i] = "\n".join(own[:at] + (passage if i % 3 == 0 else []) + own[at:])
    texts |= {100: None, 101: "", 102: "\n\n\n\n", 103: "\n\n\n\n", 104: texts[0], 105: "\n".join(passage * 2), 106: "one\n" * 20_000}
    rows = [(i, t, i, "x") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _at long, n_lines string")
    got = linededup.without_repeated_chunks(docs.repartition(3))
    assert got.columns == ["doc_id", "text", "_at", "n_lines", "n_removed_lines"]
    assert {r.doc_id: r.text for r in got.collect()} == expected_lines(texts)
    assert sum("shared line 15" in (t or "") for t in texts.values()) == 16
    assert sum("shared line 15" in (t or "") for t in expected_lines(texts).values()) <= 2
    assert linededup.without_repeated_chunks(docs.limit(0)).count() == 0


def test_line_dedup_repeated_and_null_ids(spark):
    text = "\n".join(f"line {k}" for k in range(40))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, "line 20" in r.text) for r in linededup.without_repeated_chunks(docs).collect())
    assert got == [(0, True), (1, False), (2, False), (2, False)]


def repeated_runs(texts, words):
    """Brute force: {id: lines in runs of over ``words`` words that a text of a smaller id has}, but blank ones."""
    split, out = {i: t.split("\n") for i, t in texts.items()}, {i: set() for i in texts}
    for b, y in split.items():
        for x in (split[a] for a in split if a < b):
            for s in range(len(x)):
                for r in range(len(y)):
                    n = 0
                    while s + n < len(x) and r + n < len(y) and x[s + n] == y[r + n]:
                        n += 1
                    if sum(len(z.split()) for z in y[r : r + n]) > words:
                        out[b] |= {k for k in range(r, r + n) if y[k].strip()}
    return out


def test_line_dedup_removes_whole_runs(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(f"v{rng.random()}" for _ in range(n))
    shared = [[line(rng.choice([0, 1, 4, 9, 20, 60])) for _ in range(rng.randint(1, 7))] for _ in range(14)] + [[line(51)], [line(26), "", line(25)], [line(25), line(25)]]
    texts = {}
    for i in range(40):
        lines = []
        for part in rng.sample(shared, 3):
            cut = rng.randint(0, len(part) - 1) if rng.random() < 0.3 else 0  # some runs are shared in part
            lines += [f"own {i} {rng.random()}" for _ in range(rng.randint(1, 3))] + part[cut:]
        texts[i] = "\n".join([*lines, f"end {i}"])
    texts |= {50: shared[-3][0], 51: shared[-3][0]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in linededup.without_repeated_chunks(docs.repartition(3)).collect()}
    runs = repeated_runs(texts, 50)
    assert sum(map(len, runs.values())) > 100
    for i, t in texts.items():
        lines = t.split("\n")
        assert not {lines[k] for k in runs[i]} & set(got[i])
        assert {x for x in lines if x.startswith(("own", "end"))} <= set(got[i])
    assert {x for t in texts.values() for x in t.split("\n")} - {""} == {x for t in got.values() for x in t} - {""}


def test_plain_and_materialize(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, c0 int")
    renamed, names = plain(df, "c0")
    assert renamed.columns == ["c0", "c1"] and names == ["c1"] and materialize(renamed, "x").collect() == renamed.collect()
