"""The training-data queries: thin digests over whole tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import html_extract, media, mixing, near_dedup, packing, pii, secrets, substring_dedup, topk, toxicity
from .common import load


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.digest(load(spark, sf_dir, "documents"))


def op3_secrets(spark, sf_dir):
    return secrets.digest(load(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_topk(spark, sf_dir):
    return topk.top_k(load(spark, sf_dir, "embeddings"))


def op6_html(spark, sf_dir):
    return html_extract.main_texts(load(spark, sf_dir, "pages"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents"))


def op9_substrings(spark, sf_dir):
    kept = substring_dedup.deduplicate(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_media(spark, sf_dir):
    return media.document_media(load(spark, sf_dir, "documents"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc),
m AS (SELECT doc, min(c) AS c FROM r GROUP BY doc)
SELECT w.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept FROM w JOIN m ON m.doc = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)),
f AS (SELECT x, min({'d': doc_id, 'i': i}) AS f FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM win JOIN f ON win.x = f.x WHERE {'d': doc_id, 'i': i} <> f.f),
words AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT words.doc_id AS doc_id, count(gone.p) AS n, string_agg(CASE WHEN gone.p IS NULL THEN v END, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def queries() -> dict:
    return {"op1_near_dedup": op1_near_dedup, "op2_pii": op2_pii, "op3_secrets": op3_secrets, "op4_toxicity": op4_toxicity, "op5_topk": op5_topk, "op6_html": op6_html, "op7_mixing": op7_mixing, "op8_packing": op8_packing, "op9_substrings": op9_substrings, "op10_media": op10_media, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op1_near_dedup": OP1_SQL, "op5_topk": OP5_SQL, "op9_substrings": OP9_SQL}
