"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.centroids import cluster, cluster_sql
from brindle.llm.language_id import identify
from brindle.llm.mixing import MIX_SQL, mixture
from brindle.llm.near_dedup import near_duplicates
from brindle.llm.packing import Packing, pack
from brindle.llm.quality_fm import quality_scores
from brindle.llm.quality_ledger import QUALITY_SQL, quality
from brindle.llm.substring_dedup import remove_repeats
from brindle.llm.suffix_dedup import remove_long_repeats
from brindle.llm.tiff import document_pages
from brindle.llm.token_alignment import Alignment, align
from brindle.llm.toxicity import toxicity
from brindle.llm.warc_fixity import FIXITY_SQL, audit_pages
from brindle.session import Staged, ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(table(spark, sf_dir, "pages"), table=Staged(spark).write)


def packing() -> Packing:
    """The parameters of op6: the public tokenizer's ranks, 2048 tokens, id 0 after each document."""
    import public_tokenizers

    return Packing(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), packing())


def op7_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table=Staged(spark).write)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_long_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def tokenizers() -> Alignment:
    """The public tokenizers of op12."""
    import public_tokenizers

    return Alignment(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizers())


def op13_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shipped(q: Query) -> Query:
    @wraps(q)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return q(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {q.__name__: _shipped(q) for q in (op1_toxicity, op2_quality_rules, op3_near_dedup, op4_language_id, op5_warc_fixity, op6_best_fit_packing, op7_tiff_pages, op8_mixing, op9_substring_dedup, op10_suffix_dedup, op11_centroids, op12_token_alignment, op13_quality_fm)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY_SQL, "op5_warc_fixity": FIXITY_SQL, "op8_mixing": MIX_SQL, "op11_centroids": cluster_sql()}
