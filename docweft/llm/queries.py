"""The queries of the subpackage: thin, each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread
from . import chat_format, conversation_repair, exact_dedup, language_id, line_templates, minhash_dedup, packing, secret_scan, sentencepiece_lattice, topk, toxicity, warc, whitening
from .repair_sql import REPAIR

#: Where the vocabulary files are; a parameter of the operators, not part of the repository.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLANTED = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(PLANTED).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    out = chat_format.format_conversations(rows.unionByName(extra))
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        chat_format.turns_digest(F.col("turns")).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_ids, ids_sha256 (the ids as little-endian 32-bit numbers), decoded_sha256 (of the decoded text), round_trip."""
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def held_out(doc_id: str, parts: int, rest: int):
    """Null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == rest


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out("doc_id", 4, 2)))
    scored = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"), toxicity.threshold(F.col("lang"), model).alias("threshold"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), width=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    prototypes = language_id.fit(docs.filter(~held_out("doc_id", 3, 1)))
    found = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), language_id.predict(F.col("text"), prototypes).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines (not blank), n_dropped, and length and digest of what is kept."""
    out = line_templates.drop_recurring(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    kinds = [r.kind for r in secret_scan.BASE]
    of = lambda *own: F.filter("spans", lambda s: s["kind"].isin(*own))
    base, counts = of(*kinds), [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the faults that the query is about; ``present`` is false for those that are dropped."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), (fault != 0).alias("present"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_exact_topk, op3_exact_dedup, op4_sentencepiece, op5_toxicity, op6_near_dedup, op7_packing, op8_warc, op9_language_id, op10_line_dedup, op11_embedding_whitening, op12_secret_scan, op13_conversation_repair)}

_WS = r"[\x20\x09-\x0D]"

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -7, i, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, role)
        ), t AS (
            SELECT *, CASE WHEN contains(text, '\') OR contains(text || ' ', '### ') OR contains(text, '</turn>') OR contains(role, '\') OR contains(role || ' ', '### ') OR contains(role, '</turn>') OR contains(role, ': ')
                THEN 13 + length(replace(replace(replace(replace(role, '\', '\\') || ' ', '### ', '\### '), '</turn>', '\</turn>'), ': ', ':\ '))
                    + length(replace(replace(replace(text, '\', '\\') || ' ', '### ', '\### '), '</turn>', '\</turn>'))
                ELSE 15 + length(role) + length(text) END AS chars
            FROM r
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10""",
    "op3_exact_dedup": rf"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
            FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op6_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
        ), e AS (
            SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
        ), l AS (
            SELECT x, y FROM p UNION ALL SELECT y, x FROM p
        ), r(x, m) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.m FROM r JOIN l ON r.x = l.x
        )
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
        FROM s JOIN (SELECT x, min(m) AS m FROM r GROUP BY x) c ON s.doc_id = c.x""",
    # the gaps before the matches of a kind, and the matches, give their places
    "op12_secret_scan": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
        ), k(rank, kind, least, needs, p) AS (VALUES
            (1, 'assign', 8, '[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{8}', '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)'),
            (2, 'access', 16, 'AKIA[A-Z0-9]{12}', '()(AKIA[A-Z0-9]+)'),
            (3, 'hex', 32, '[0-9a-f]{32}', '()([0-9a-f]+)'),
            (4, 'host_token', 36, 'gh[opsru]_[A-Za-z0-9]{36}', '(gh[opsru]_)([A-Za-z0-9]+)'),
            (5, 'web_token', 30, 'eyJ', '()(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)'),
            (6, 'private_key', 27, 'PRIVATE KEY-----', '()(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)')
        ), g AS (
            SELECT r, rank, kind, least, regexp_extract_all(t, '(?s)(.*?)' || p, 1) AS gaps, regexp_extract_all(t, '(?s)(.*?)' || p, 2) AS heads, regexp_extract_all(t, '(?s)(.*?)' || p, 3) AS tails
            FROM d, k WHERE regexp_matches(t, needs)
        ), u AS (
            SELECT r, rank, kind, least, unnest(range(1, len(gaps) + 1)) AS i, gaps, heads, tails FROM g
        ), m AS (
            SELECT r, rank, kind, least, length(tails[i]) AS n, length(heads[i]) + length(tails[i]) AS size,
                sum(length(gaps[i]) + length(heads[i]) + length(tails[i])) OVER (PARTITION BY r, rank ORDER BY i) AS stop
            FROM u
        ), f AS (
            SELECT r, rank, kind, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span, CAST(stop - size AS BIGINT) AS start FROM m WHERE n >= least
        )
        SELECT any_value(doc_id) AS doc_id, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
            sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank <= 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
        FROM d LEFT JOIN f USING (r) GROUP BY r""",
    "op13_conversation_repair": REPAIR,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), g AS (
            SELECT page_id, payload, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS top FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
            CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM g""",
}
