from docloom.plans.engine import chunk_documents
from docloom.sources.documents import read_documents
from docloom.streaming.ingest import append_chunks, arriving, chunks_in


def test_files_are_chunked_once_as_they_arrive(spark, tmp_path):
    docs, table, checkpoint = tmp_path / "docs", f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint"
    docs.mkdir()
    (docs / "a.md").write_text("# One\n" + "some text of the first document. " * 60)
    (docs / "b.html").write_text("<h1>Two</h1><p>" + "a page with a paragraph in it. " * 5 + "</p>")
    (docs / "c.bin").write_text("not read " * 20)

    def work() -> dict:
        append_chunks(arriving(spark, str(docs), 1), table, checkpoint).awaitTermination()
        return {(r.chunk_id, r.text): r.batch for r in chunks_in(spark, table).collect()}

    def expected() -> set:
        return {(r.chunk_id, r.text) for r in chunk_documents(read_documents(spark, str(docs))).collect()}

    first = work()
    assert set(first) == expected() and len(set(first.values())) == 2
    (docs / "later.txt").write_text("what came later is read by the next run alone. " * 3)
    second = work()
    assert set(second) == expected() and {k: second[k] for k in first} == first and len(second) == len(first) + 1
    assert work() == second
