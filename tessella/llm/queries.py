"""The numbered queries: thin digests of the operators, over whole tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from . import classifier, mixing, neargraph, packing, page_text, pii, simhash, suffixes, topk, urls
from .common import importable


def with_package(query):
    @wraps(query)
    def run(spark, sf_dir):
        importable(spark)
        return query(spark, sf_dir)

    return run


def op3_topk(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op4_suffix_dedup(spark, sf_dir):
    found = suffixes.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_neargraph(spark, sf_dir):
    return neargraph.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenizer_path(name="byte_bpe_50k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark, sf_dir):
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path=tokenizer_path(), ranks_path=tokenizer_path("byte_bpe_50k.tiktoken"))


def op1_html_extraction(spark, sf_dir):
    return page_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_simhash(spark, sf_dir):
    found = simhash.within_bits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The rules of op8: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op8_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages, URL_RULES, edges=urls.page_links(pages))


def op9_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score(docs, net, keep=["doc_id"])
    return scored.select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_pii(spark, sf_dir):
    return pii.pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries():
    named = (
        op1_html_extraction, op2_simhash, op3_topk, op4_suffix_dedup, op5_neargraph, op6_mixing, op7_packing, op8_url_filters, op9_quality_classifier, op10_pii,
    )
    return {f.__name__: with_package(f) for f in named}


OP3_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: All pairs of a label: the driver's small tables allow it, and links there are far from the threshold.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), u AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.vec_id
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT page_id, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id
)
-- These pages hold no canonical or refresh links, so that no verdict comes from an alias.
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


def oracle_sql():
    return {"op3_topk": OP3_SQL, "op5_neargraph": OP5_SQL, "op8_url_filters": OP8_SQL}
