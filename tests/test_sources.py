import io
import json
import urllib.error

import pytest

from docloom.operators import taskspec
from docloom.sources import documents
from docloom.sources.clients import HashingEmbedder, JsonClient, ModelError, embedded
from docloom.sources.config import Settings


def test_settings_file(spark, tmp_path):
    (tmp_path / "env").write_text('A="x"\n# c\nB\n\nC=a=b\nA=y\n')
    assert documents.read_settings(spark, str(tmp_path / "env")) == {"A": "y", "C": "a=b"}


def test_settings_fall_back():
    s = Settings.from_mapping({"OPENAI_API_KEY": "k", "EMBEDDING_API_BASE": "e", "RERANK_ENABLED": " No "})
    assert (s.embedding_key, s.rerank_key, s.rerank_base, s.rerank_enabled, s.batch_size, s.rerank_factor) == ("k", "k", "e", False, 10, 4)


def test_scan_and_results(spark, tmp_path):
    for name in ("b.txt", "a.md", "sub/c.html", "x.pdf"):
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"one\xff\r\ntwo")
    rows = documents.read_documents(spark, str(tmp_path / "docs")).orderBy("doc_ord").collect()
    assert [r.path.rsplit("/", 1)[-1] for r in rows] == ["a.md", "c.html", "b.txt"] and {r.text for r in rows} == {"one\ntwo"}
    before = documents.fingerprint(documents.scan(spark, str(tmp_path / "docs"))).first()[0]
    (tmp_path / "docs" / "a.md").write_text("changed")
    assert documents.fingerprint(documents.scan(spark, str(tmp_path / "docs"))).first()[0] != before
    for task, files in {"t1": {"stdout.log": "out", "result.json": "{}"}, "t2": {"stderr.log": "err"}}.items():
        (tmp_path / "work" / task).mkdir(parents=True)
        for name, text in files.items():
            (tmp_path / "work" / task / name).write_text(text)
    got = {r.task: (r.stdout, r.stderr, r.result) for r in documents.read_results(spark, str(tmp_path / "work")).collect()}
    assert got == {"t1": ("out", "", "{}"), "t2": ("", "err", None)}


class Service:
    def __init__(self, answer):
        self.answer, self.requests = answer, []

    def __call__(self, request, timeout):
        self.requests.append(request)
        if isinstance(self.answer, Exception):
            raise self.answer
        return io.BytesIO(json.dumps(self.answer).encode())


def test_client():
    service = Service({"data": [{"embedding": [1, 2.5]}]})
    assert JsonClient("http://h/", "k", service).embed("m", ["t"]) == [[1.0, 2.5]]
    assert service.requests[0].full_url == "http://h/embeddings" and service.requests[0].get_header("Authorization") == "Bearer k"
    for wrong in ({"data": {}}, {"data": [{"embedding": []}]}, {"data": [{"embedding": ["x"]}]}):
        with pytest.raises(ModelError):
            JsonClient("http://h", "k", Service(wrong)).embed("m", ["t"])
    assert JsonClient("http://h", "k", Service({"choices": [{"message": {"content": "hi"}}]})).chat("m", []) == "hi"
    assert JsonClient("http://h", "k", Service({"data": []})).models() == {"data": []}
    with pytest.raises(ModelError, match="API HTTPError 429: slow"):
        JsonClient("http://h", "k", Service(urllib.error.HTTPError("u", 429, "m", {}, io.BytesIO(b"slow")))).models()
    with pytest.raises(ModelError, match="API URLError: gone"):
        JsonClient("http://h", "k", Service(urllib.error.URLError("gone"))).models()


def test_embedded_cuts_texts(spark):
    rows = spark.createDataFrame([(1, "word " * 2000), (2, None)], "id long, text string")
    got = {r.id: r.embedding for r in embedded(rows, HashingEmbedder, "m").collect()}
    assert got[1] == HashingEmbedder().embed("m", [("word " * 2000)[:3000]])[0] and len(got[2]) == 64


def test_json_and_script(spark):
    rows = [('noise {"a":1} tail', '{"a":1}'), ("[1]", "{}"), ("", "{}"), ("{bad}", "{}"), (None, "{}")]
    df = spark.createDataFrame(rows, "t string, e string")
    assert all(json.loads(r[0]) == json.loads(r[1]) for r in df.select(taskspec.json_object("t"), "e").collect())
    compile(taskspec.sweep_script({"points": 50}), "script", "exec")
    assert "50" in taskspec.sweep_script({"points": 50})
