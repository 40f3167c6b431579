"""What the operators share: table access, session settings, intermediate tables, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewframe.session import shared_dir

#: Rows in an Arrow batch. Texts may be long, so batches are kept small; a Python task holds one at a time.
BATCH_ROWS = 512
#: Bytes of such a batch, so that very long texts come in batches of their own.
BATCH_BYTES = 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Settings of the operators: small Arrow batches, UTC, adaptive plans."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, costly columns exist once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(text: str = "text") -> Column:
    """The text's bytes; a null text is an empty one."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def hashed_share(column: str, share: float) -> Column:
    """True for a fixed share of the keys, chosen by hash."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1_000_000)) < F.lit(int(round(share * 1_000_000)))


def trim(known: dict, most: int) -> None:
    """Forget the older half of a worker's memory once it holds more than ``most`` entries."""
    if len(known) > most:
        for key in list(islice(known, len(known) // 2)):
            del known[key]


def batch(schema: pa.Schema, columns: Sequence[Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema)


def pieces(schema: pa.Schema, columns: Sequence, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """Long columns (numpy arrays) as batches of bounded size."""
    n = len(columns[0])
    for at in range(0, n, rows):
        yield batch(schema, [c[at:at + rows] for c in columns])
