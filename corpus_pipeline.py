"""A corpus pipeline of five stages: language ID, near-dedup, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents. SQL can't express the stages; the tests hold each of them, and run(), against
brute force.

Nulls in any column are kept as they are where nothing else is said. An empty table gives an empty table in every stage.
Copies that mixing takes twice are rows of their own from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.language_id import keep_identified
from brindle.llm.mixing import mixed_documents
from brindle.llm.near_dedup import drop_near_duplicates
from brindle.llm.packing import pack
from brindle.llm.queries import packing
from brindle.llm.suffix_dedup import SuffixDedup, cut_long_repeats
from brindle.session import Staged, ship, table

#: The shortest repeated string that is cut: passages of 50 words and more. Of the passages of 50 words or more that the test
#: tables share between documents, 27 in 100 have fewer than the 400 bytes of op10, and 2 in 100 fewer than 250.
REPEAT_BYTES = 250


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, and so do those without text or without a letter."""
    ship(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest id; documents without words or without an id stay."""
    ship(spark)
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT_BYTES or more that start anywhere else are cut out of every document; n_chars follows. Null text stays null."""
    ship(spark)
    return cut_long_repeats(docs, SuffixDedup(window=REPEAT_BYTES)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, null among them, are sampled to their targets; a document may come twice. A source without words is not taken."""
    return mixed_documents(docs, table=Staged(spark).write)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and its place there; a null or empty text is one token."""
    ship(spark)
    return pack(docs, packing())


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mix), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Staged(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        new = staged.write(out)
        staged.drop(docs)
        docs = new
