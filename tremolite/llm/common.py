"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import tune

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words as runs of anything but ASCII white space, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators: small Arrow batches, as one text may hold megabytes."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def set_aside(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """All columns but the needed ones under neutral names, and the way back: no name an operator adds can meet one of them."""
    names = {x: f"_aside_{i}_" for i, x in enumerate(df.columns) if x not in needed}
    back = {v: k for k, v in names.items()}
    return df.toDF(*[names.get(x, x) for x in df.columns]), lambda out: out.select(*[F.col(names.get(x, x)).alias(x) for x in df.columns], *[F.col(x) for x in out.columns if x not in back and x not in df.columns])


def ascii_lower(x: Column) -> Column:
    """A-Z only, whatever the locale or the script."""
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def raw_texts(array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of an Arrow string array, without Python strings in between."""
    import pyarrow as pa

    yield from (x.as_py() for x in array.cast(pa.binary()))


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """`raw` cut behind white space into pieces of about `size` bytes, so that a very long text stays small in memory."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + size) if at + size < len(raw) else None
        to = cut.end() if cut else len(raw)
        yield raw[at:to]
        at = to
