"""Queries of this subpackage for the driver's contract, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard, language, mixing, packing, suffixes, tool_calls, topk, url_rules, warc
from .common import held_out, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are joined by number: a page is to block if the row of ``labels`` with its id is toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("block")
    )
    mined = url_rules.mine(pages.select("page_id", "url").join(bad, "page_id"))
    return url_rules.judge(pages, mined)


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.conversation_calls(table(spark, sf_dir, "conversations"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    return language.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, sf_dir)


#: Target weights of the query: by source number below ten or not, and by language.
MIX_WEIGHTS = {("low",): 0.6, ("high",): 0.4} | {
    (d, lang): w for d in ("low", "high") for lang, w in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1))
}


def mix_documents(docs: DataFrame, share: float, epochs: int) -> DataFrame:
    """Domain (low or high source number), language, source; a token is four bytes."""
    domain = F.when(F.try_to_number(F.regexp_extract("source", r"^src(\d{1,9})$", 1), F.lit("999999999")) < 10, "low").otherwise("high")
    return mixing.mix(
        docs, [domain, F.col("lang"), F.col("source")], F.ceil(F.octet_length("text") / 4), F.col("doc_id"), share=share,
        weights=MIX_WEIGHTS, epochs=epochs
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), 1.0, 3).select("doc_id", "mix_epoch", "mix_path")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_rules, op2_tool_calls, op3_topk, op4_packing, op5_language, op6_suffixes, op7_fingerprints, op8_warc, op9_mixing,
        op10_jaccard
    )
}

ORACLE = {
    "op2_tool_calls": """
        WITH rows AS (SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
        calls AS (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY role, text) AS r, count(*) OVER (PARTITION BY conv, turn) AS n FROM
            (SELECT conv, turn, CASE role WHEN 'system' THEN 'configure' ELSE 'ask' END AS role, text FROM rows WHERE role IN ('system', 'user'))),
        results AS (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY text) AS r, count(*) OVER (PARTITION BY conv, turn) AS n FROM rows WHERE role = 'assistant'),
        met AS (SELECT coalesce(c.conv, a.conv) AS conv, coalesce(c.turn, a.turn - 1) AS slot, coalesce(c.turn, a.turn) AS turn, c.role AS name, c.text AS ask, a.text AS answer,
            coalesce(c.n, 0) AS n_calls, coalesce(a.n, 0) AS n_results,
            CASE WHEN c.r IS NULL THEN NULL WHEN c.turn > 0 AND EXISTS (SELECT 1 FROM calls z WHERE z.conv IS NOT DISTINCT FROM c.conv AND z.turn = 0) THEN 1 ELSE 0 END AS level
            FROM (SELECT * FROM calls WHERE r = 1) c FULL JOIN (SELECT * FROM results WHERE r = 1) a ON c.conv IS NOT DISTINCT FROM a.conv AND c.turn IS NOT DISTINCT FROM a.turn - 1)
        SELECT conv, 'turn' || slot AS call_id, turn, name, CAST(level AS INTEGER) AS level, n_calls, n_results,
            CASE WHEN name IS NULL THEN 'orphan' WHEN answer IS NULL THEN 'no_result' ELSE 'linked' END AS status,
            name IS NULL OR ask IS NOT NULL AS valid, CASE WHEN name IS NOT NULL AND ask IS NULL THEN 'missing text' ELSE '' END AS errors,
            '{"arguments":' || CASE WHEN name IS NULL THEN 'null' WHEN ask IS NULL THEN '{}' ELSE '{"n_chars":' || length(ask) || ',"text":' || to_json(ask) || '}' END
            || ',"call_id":"turn' || slot || '","depends_on":' || CASE WHEN name IS NOT NULL AND turn > 0 THEN '["turn0"]' ELSE '[]' END
            || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(answer), 'null') || '}' AS record
        FROM met""",
    "op3_topk": """
        WITH good AS (SELECT vec_id, row_number() OVER () AS nr, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.nr, q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score FROM good q JOIN good r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT * FROM ranked WHERE rank <= 5""",
    "op8_warc": """
        WITH heads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM heads)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM best""",
    "op6_suffixes": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, p, e[p + 1:p + 50] AS s FROM (SELECT doc_id, e, unnest(range(0, n - 49)) AS p FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS new FROM w JOIN f USING (s) WHERE first < doc_id),
        run AS (SELECT doc_id, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
        span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM run GROUP BY doc_id, k),
        cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM span GROUP BY doc_id),
        gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM span UNION ALL SELECT s.doc_id, max(s.z), any_value(d.n) FROM span s JOIN d USING (doc_id) GROUP BY s.doc_id),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id, (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links FROM documents d LEFT JOIN n USING (doc_id)""",
}
