"""From raw documents to training order: five stages over the documents table, each written and read again.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns what is left, with the columns of documents,
but for the last one, which writes shards and returns the token records read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import decontaminate, mixing, quality_classifier, simhash, token_output
from lumenspan.llm.common import table, written
from lumenspan.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier scores below 0.3. It is fitted on the labelled rows of docs."""
    return quality_classifier.keep_good(docs, table(ship(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: by linked fingerprints, then by sets of five-word shingles, 0.8 alike."""
    ship(spark)
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.leak_free(docs, table(ship(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their targets."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards of token records in training order; the rows are read from them."""
    return token_output.materialised(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("mixing sources", mixed), ("token-ID output", tokens)]
#: Compression, fingerprints, edit distances and tokens are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
