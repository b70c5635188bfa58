"""What the operators of this subpackage share: columns, tables and Arrow settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise, shared_dir, table  # noqa: F401

#: Rows of an Arrow batch: long texts stay within a worker's memory.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows, and by bytes where Spark can."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, only the columns named."""
    small_batches(spark)
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def utf8_bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")
