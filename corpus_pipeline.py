"""A corpus pipeline of five stages over ``documents``: toxicity, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``, extra ones and those with clashing names included. :func:`run` writes each stage's result as Parquet in the
shared folder and reads it again for the next. Every stage gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterflow.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from chatterflow.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learned from ``labels``, rejects go.

    Each row is judged by its text alone, repeated rows and rows with a null doc_id too; null and empty texts stay, as do all
    texts where no label says toxic.
    """
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space), the one with the smallest doc_id stays.

    Null counts as the empty text, and empty texts form one group; of rows that repeat a doc_id and a text one stays; a null
    doc_id comes after all others.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles, the one with the smallest doc_id of a component stays.

    Texts without words and rows with a null doc_id are linked with nothing and stay; rows that repeat a doc_id stay or go together.
    """
    return near_dedup.near_dedup(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, some several times, so that the sources have their target weights of the token budget.

    Null sources form one source; texts without words cost nothing; rows that repeat a doc_id, null included, are drawn together.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence.

    Null counts as the empty text, which is one token; every row is packed, repeated ones too; only longer texts are cut.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned lexicon nor the sketches; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
