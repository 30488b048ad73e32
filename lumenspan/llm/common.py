"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from lumenspan.operators.store import remove, shared_dir

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: For str.translate: ASCII white space becomes a plain space, so that split(" ") cuts at nothing else.
ASCII_SPACE = str.maketrans("\t\n\v\f\r", "     ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """The runs of characters other than ASCII white space (not str.split(), which also cuts at Unicode spaces)."""
    return [w for w in (text or "").translate(ASCII_SPACE).split(" ") if w]


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_id(docs: DataFrame, name: str = "doc_id") -> Column:
    """The id column as a long; raises at once where it is not one of integers, instead of failing in a task."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{name} has to be a column of integers, not {kind.simpleString()}")
    return quoted(name).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is computed once.

    The table is removed when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run herein go when it ends. For results that nothing computes again from its shuffles: a
    table that was written, an answer that was collected once."""
    had = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, had)


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body's lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """Exclusive running sums of an array of integers, over blocks, so that long arrays don't cost their square."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)

    def outer(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / block)).cast("int")), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
        return let(blocks, lambda s: let(before(s), lambda p: F.transform(a, lambda _, i: F.get(p, F.floor(i / block).cast("int")) + total(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block)))))

    return let(lengths, outer)


def bucket(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo of; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of
