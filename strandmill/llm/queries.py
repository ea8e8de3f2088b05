"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import bpe, chat_format, exact_dedup, ngram_join, packing, pii, quality, secret_scan, token_counts, topk


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotate(_read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "text", "start", spans.alias("mask"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return token_counts.count_edited(docs, token_counts.sample_edits(docs["text"], docs["doc_id"]))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_exact_dedup, op2_chat_format, op3_token_counts, op4_secret_scan, op5_quality, op6_packing, op7_topk, op8_ngram_join, op9_pii, op10_bpe)
    return {f.__name__: f for f in all_}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(text), doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

def _names(role: str) -> str:
    for c, shown in chat_format.NAMES.items():
        role = f"replace({role}, chr({ord(c)}), '{shown}')"
    return role


OP2_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce({_names('role')}, '{chat_format.NOBODY}') AS role, replace(coalesce(text, ''), '<|', '<||') AS text FROM conversations),
     p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
     r AS (SELECT t.conv_id, p.perspective, t.turn, t.role, t.text, t.role = p.perspective AS mine,
                  CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10) WHEN t.role = p.perspective THEN '<|im_start|>assistant' || chr(10)
                       ELSE '<|im_start|>user name=' || t.role || chr(10) END AS head
           FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
     o AS (SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r),
     c AS (SELECT *, (pos // 1048576)::INTEGER AS part FROM o)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text, min(pos) AS start,
       coalesce(string_agg((pos + length(head) - s)::VARCHAR || ':' || (pos + length(head) + length(text) + 10 - s)::VARCHAR, ',' ORDER BY pos) FILTER (mine), '') AS mask
FROM (SELECT *, min(pos) OVER (PARTITION BY conv_id, perspective, part) AS s FROM c) GROUP BY conv_id, perspective, part
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
     h AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     q AS (SELECT doc_id, g FROM h WHERE g IS NOT NULL UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
     z AS (SELECT doc_id, list(g ORDER BY g) AS s FROM q GROUP BY doc_id),
     s AS (SELECT doc_id, coalesce(z.s, []) AS s FROM documents LEFT JOIN z USING (doc_id)),
     c AS MATERIALIZED (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
     g AS (SELECT rep, n, unnest(s) AS g FROM c),
     u AS MATERIALIZED (SELECT g, row_number() OVER () AS id FROM g GROUP BY g HAVING count(*) > 1),
     t AS MATERIALIZED (SELECT rep, n, id FROM g JOIN u USING (g)),
     k AS (SELECT a.rep AS x, b.rep AS y, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.id = b.id AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
     l AS MATERIALIZED (SELECT x, y FROM k WHERE 100 * k >= 85 * (na + nb - k)),
     e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
     r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
     m AS (SELECT x AS rep, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.rep = m.rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op7_topk": OP7_SQL, "op8_ngram_join": OP8_SQL}
