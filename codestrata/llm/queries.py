"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dup, langid, licenses, mixture, near_dup, quality, substring_dup, token_store, winnow
from .common import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    taken = mixture.copies(docs, mixture.domain_of(), mixture.WEIGHTS, budget=0.8, epochs=2)
    return taken.where("copies > 0").select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op6_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare(table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dup.spans(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.train_rows(docs))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_token_store, op2_licenses, op3_mixture, op4_near_duplicates, op5_bpe, op6_embedding_near_duplicates, op7_quality, op8_winnowing, op9_substring, op10_language)}
ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = d.doc_id""",
    "op6_embedding_near_duplicates": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE list_aggregate(list_transform(embedding, lambda a: a IS NOT NULL AND isfinite(a)), 'bool_and') AND list_aggregate(list_transform(embedding, lambda a: a <> 0), 'bool_or')),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) >= 0.95 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
    r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id)
    SELECT e.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
    FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY 1) k ON k.x = e.vec_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = e.vec_id""",
}
