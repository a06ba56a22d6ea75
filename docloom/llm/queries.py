"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, chat, embeddings, fingerprint, linededup, lm, minhash, mixing, quality, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, reads the output back and digests what it says."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    parsed = chat.parse_conversations(chat.format_conversations(rows.unionByName(extra)))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b.texts, lambda t: F.concat(b.role, F.lit("\n"), t, F.lit("\n")))))
    loss = F.flatten(F.transform(F.filter("blocks", lambda b: b.role == "assistant"), lambda b: b.texts))
    parsed = parsed.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the multi-line chunks that an earlier document has."""
    return linededup.without_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document's whole text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Target shares of the languages that op1_mixing mixes to.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that mix their languages, as a classifier sees them, to TARGETS."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS).drop("h")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, ranker)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page and reads the archives back."""
    return warc.archived(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    scored = lm.score_texts(docs, ~held_out, order=3)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors."""
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash": op5_minhash,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_line_dedup": op7_line_dedup,
    "op8_fingerprint": op8_fingerprint,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_embedding_dedup": op10_embedding_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op5_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM w
        ), x AS (SELECT doc_id, len(s) AS k, hash(unnest(s)) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (g)
              WHERE a.doc_id <> b.doc_id AND 100 * a.k >= 85 * b.k AND 100 * b.k >= 85 * a.k GROUP BY ALL),
        links AS (
            SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.s) + len(sb.s) - n)
        ), reach AS (
            SELECT doc_id AS id, doc_id AS r FROM s UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
        )
        SELECT doc_id, len(any_value(s)) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM s JOIN reach ON id = doc_id GROUP BY doc_id
    """,
    "op6_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        ), n AS (
            SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
                   length(text) + len(regexp_extract_all(text, '[\\<#]')) AS text_chars, length(role) + len(regexp_extract_all(role, '[\\<#:]')) AS role_chars
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(text_chars + CASE WHEN opens THEN 6 + role_chars ELSE 3 END + CASE WHEN closes THEN 9 ELSE 0 END)::BIGINT AS formatted_chars
        FROM n GROUP BY conv_id
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE e AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach AS (
            SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
        ), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT id AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach LEFT JOIN n ON a = id GROUP BY id
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS digest FROM pages
        ), f AS (
            SELECT page_id, octet_length(b) AS n, digest,
                   CASE WHEN octet_length(b) >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first
            FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f
    """,
}
