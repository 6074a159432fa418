"""The queries of the training-data operators, each over its whole table.

`op1`: words are runs of characters other than ASCII white space; word_chars counts their code
points, n_symbols the characters `#*$%&|<>`, n_dup_lines the lines with a word that equal an earlier
line, n_repeat_words the words in 8-word windows that occur twice or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import alignment, extraction, langid, licences, mixing, neardup, packing, pieces, quality, runs, sharding, topk, toxicity
from voltide.llm.common import table

SHARDS = [f"shard-{i:02d}" for i in range(16)]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public vocabulary file is on this machine; a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(table(spark, sf_dir, "pages"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_html_extraction, op3_exact_topk, op4_language_id, op5_license_scan, op6_minmax_neardup,
        op7_sentencepiece, op8_sharding, op9_toxicity, op10_source_mixing, op11_best_fit_packing, op12_periodic_runs, op13_token_alignment, pipeline,
    )
}

OP3_SQL = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row, c.row AS other, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.row <> q.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_sql() -> str:
    """The table is filled anew, turn by turn, from the names of the shards alone."""
    names = ", ".join(f"('{s}')" for s in SHARDS)
    number = lambda text: f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"
    n, size = len(SHARDS), sharding.SIZE
    return f"""
WITH RECURSIVE s AS (SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS k, {number("shard || '/offset'")} % {size} AS o, {number("shard || '/skip'")} % {size - 1} + 1 AS j FROM (VALUES {names}) t(shard)),
p AS (SELECT list(list_transform(range({size}), lambda i: (o + i * j) % {size}) ORDER BY k) AS orders FROM s),
f AS (SELECT 0 AS turn, list_transform(range({size}), lambda i: -1) AS owner
  UNION ALL SELECT turn + 1, owner[1:slot] || [turn % {n}] || owner[slot + 2:] FROM (SELECT turn, owner, list_filter(orders[turn % {n} + 1], lambda z: owner[z + 1] = -1)[1] AS slot FROM f, p WHERE turn < {size})),
t AS (SELECT owner FROM f WHERE turn = {size}),
d AS (SELECT doc_id, {number("CAST(doc_id AS VARCHAR)")} % {size} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 2, '0') AS shard FROM d, t
"""


ORACLES = {"op3_exact_topk": OP3_SQL, "op8_sharding": op8_sql()}
