"""A training corpus from documents, in five stages: no toxic documents, no near-duplicates, no personal data, sources
mixed to target weights, texts packed into windows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arborel.llm import minhash, mixing, packing, pii, toxicity
from arborel.llm.common import stored, table


# Each stage keeps the columns of docs, whatever further ones there are and however they are named, and gives no rows for
# an empty table. Repeated rows are judged alike.


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay, as do all texts if no label is known; a text of any length is judged whole."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of a group stays, and one row of each id; rows with a null id, null and empty texts all do."""
    return minhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; n_chars follows a changed text. No row goes; null texts stay null."""
    return pii.redact(docs, pii.fit(docs), size_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source or language is a value of its own. Rows without tokens go, as they have no part in the mix; rows with
    one id, or none, fall alike."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are an end alone; every row is packed, with its id, null or not."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("minhash", without_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]
#: Models and tokenizers have no form in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
