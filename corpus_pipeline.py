"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the
next one's docs. Language ID and toxicity drop the documents that they reject, near-dedup keeps one
document of each group (five-word shingles, similarity 0.8), mixing repeats or drops documents by
their number of copies, and the last stage returns the token digests of every copy. Near-dedup and
mixing go by a key of each row, as ids can be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import langid, mixing, neardup, pieces, toxicity
from voltide.llm.common import keyed, looked_up, materialise, table, unused
from voltide.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that language ID does not reject: texts without a letter, null and empty ones
    among them, and texts far from every language go. Repeated rows are judged alike."""
    judged, name = langid.identify(docs, langid.fit(docs))
    return judged.where(~F.col(f"{name}.rejected")).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are scored under 0.5; without labels none goes."""
    judged, name = toxicity.assess(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return judged.where(F.col(f"{name}.predicted") == 0).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates. Rows are told apart by a key of their own, so rows
    without an id or with a repeated one are documents like others; texts without words all stay."""
    rows, key = keyed(docs)
    others = materialise(neardup.near_duplicates(rows, k=5, row_key=key).where("not kept").select(key))
    return looked_up(rows, others, key, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Texts without words go."""
    rows, key = keyed(docs)
    times = unused(rows, "copies")
    copies = mixing.mix(rows, row_key=key).where("copies > 0").select(key, F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(times))
    mixed = looked_up(rows, materialise(copies), key)
    return mixed.withColumn(times, F.explode(times)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of every row; a null text counts as empty."""
    return pieces.token_digests(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Two stages are learned models and one draws at random: no SQL. The stages are tested in turn
#: against plain versions of their decisions, on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table is deleted once the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), docs)
    return docs
