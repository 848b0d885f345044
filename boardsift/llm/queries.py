"""The registered queries of this package and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boardsift.llm import byte_bpe, chat, hamming, licenses, minhash, packing, quality, toxicity, warc
from boardsift.llm.common import read_table
from boardsift.llm.exact_dedup import exact_duplicates


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(read_table(spark, sf_dir, "embeddings"))
    return hamming.top_k(codes, codes.where("vec_id % 50 = 0"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents")).drop("starts")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_quality": op2_quality,
    "op3_hamming_top_k": op3_hamming_top_k,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_chat_format": op7_chat_format,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_exact_dedup": op10_exact_dedup,
}


def _license_oracle() -> str:
    """Base phrases and templates by list functions over the words of each text."""
    words = lambda text: "[" + ", ".join(f"'{w.decode()}'" for w in licenses.words_of(text)) + "]"
    base = ", ".join(f"({words(p)}, '{label}')" for p, label in licenses.BASE.items())
    templates = []
    for label, (key, template) in licenses.TEMPLATES.items():
        inside, part = licenses.words_of(template), licenses.words_of(key)
        at = next(i for i in range(len(inside)) if inside[i : i + len(part)] == part)
        templates.append(f"({words(key)}, {words(template)}, {at}, '{label}')")
    return rf"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b(p, label) AS (VALUES {base}),
        k(p, tw, a, label) AS (VALUES {', '.join(templates)}),
        bs AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p)) AS s FROM t, b WHERE list_has_all(w, p)),
        ks AS (SELECT doc_id, label, w, tw, a, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p)) AS s FROM t, k WHERE list_has_all(w, p)),
        kf AS (SELECT doc_id, label, len(list_filter(range(len(tw)), lambda j: s - a + j >= 0 AND w[s - a + j + 1] = tw[j + 1])) / len(tw) AS f FROM ks),
        br AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bs GROUP BY doc_id),
        lr AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bs UNION ALL SELECT doc_id, label FROM kf WHERE f >= {licenses.TEMPLATE_SHARE}) GROUP BY doc_id),
        fr AS (SELECT doc_id, max(f) AS f FROM kf GROUP BY doc_id)
        SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(f, 0.0) END::DOUBLE AS score
        FROM t LEFT JOIN br USING (doc_id) LEFT JOIN lr USING (doc_id) LEFT JOIN fr USING (doc_id)"""


ORACLES = {
    "op3_hamming_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
        p AS (SELECT q.vec_id, r.vec_id AS neighbor_id, len(list_filter(list_zip(q.b, r.b), lambda z: z[1] <> z[2])) AS distance FROM e q JOIN e r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
        SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM p QUALIFY rank <= 10""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
              list_reduce(list_transform(range(0, 40), lambda i: right((strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1)::INTEGER::BIT::VARCHAR, 4)), lambda a, b: a || b) AS bits FROM p)
        SELECT page_id, strlen(payload) AS payload_bytes,
               list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(1, 6), lambda j: substr(bits, 5 * i + j, 1)::INTEGER), lambda x, y: 2 * x + y)::INTEGER, 1)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM d""",
    "op7_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS shown, replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t') AS name FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(shown) + length('</turn>') + 1 + CASE role WHEN 'system' THEN length('### System: ') WHEN 'user' THEN length('### User: ') WHEN 'assistant' THEN length('### Assistant: ') ELSE length('### : ') + length(name) END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_license_scan": _license_oracle(),
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size,
              first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
}
