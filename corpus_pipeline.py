"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
to the shared folder and reads it back as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import classifier, mixing, packing, pii, simhash
from tessella.llm.common import fresh, importable, named, staged
from tessella.llm.queries import tokenizer_path

#: Below this probability of good quality a document goes.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier does not reject.

    A null text is judged as an empty one; repeated rows share their fate; an empty table stays
    empty. Columns come through, whatever they are called.
    """
    importable(spark)
    net, score = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "score")
    return classifier.score(docs, net, score_col=score).where(named(score) >= LEAST_QUALITY).select(*map(named, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near-duplicates: five-word
    shingles, a similarity of 0.8 or more, verified.

    Texts without words (nulls among them) are copies of each other; of rows that repeat an id one
    stays, the same on every run; rows with a null id stay; an empty table stays empty. Columns
    come through, whatever they are called.
    """
    importable(spark)
    return simhash.kept_documents(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by format-preserving pseudonyms; n_chars, if there, follows the text.

    Every row is worked on alone: null texts stay null, repeated rows agree, an empty table stays
    empty. Columns come through, whatever they are called.
    """
    importable(spark)
    out = pii.pseudonymise(docs, counts=False)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*map(named, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents, repeated or cut, up to its target.

    Texts without words (nulls among them) take no part; a null source is a source; rows that repeat
    an id are documents each; an empty table stays empty. Columns come through, whatever
    they are called.
    """
    importable(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024: one row for each piece.

    A null text is packed as an empty one, rows that repeat an id each on its own; an empty table
    gives no rows. Columns beyond doc_id and text are not looked at.
    """
    importable(spark)
    return packing.pack(docs, tokenizer_path=tokenizer_path(), ranks_path=tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("PII pseudonyms", pseudonyms),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashing, the classifier and the tokeniser are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the corpus made from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
