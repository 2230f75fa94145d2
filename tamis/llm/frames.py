"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tamis.session import materialize, scratch_path
from tamis.llm.ship import ship

__all__ = ["table", "pick", "fresh", "materialize", "scratch_path", "ship", "total_bytes", "write_blocks"]

_MAX_BUCKETS = 50_000  # Spark refuses a bucketed table of more than 100,000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only the named columns, renamed: pick(df, doc_id="id", text="body").

    Names are quoted, so names with dots, and extra columns of any name, do no harm.
    """
    return df.select(*[df["`" + v.replace("`", "``") + "`"].alias(k) for k, v in columns.items()])


def fresh(stem: str) -> str:
    """A column or table name nobody else has."""
    return f"_{stem}_{uuid.uuid4().hex[:10]}"


def total_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """(rows, UTF-8 bytes of one text column): one aggregate, two numbers to the driver."""
    n, b = df.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)))).first()
    return int(n), int(b or 0)


def _number_blocks(text: str, max_rows: int, max_bytes: int):
    """Rows of one partition with a block number: a block ends before the row that would take it over a bound."""
    def run(batches):
        from pyspark import TaskContext
        block, rows, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            number = []
            for n in pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist():
                if rows and (rows == max_rows or size + n > max_bytes):
                    block, rows, size = block + 1, 0, 0
                rows, size = rows + 1, size + n
                number.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], names=[*batch.schema.names, "block"])
    return run


def write_blocks(df: DataFrame, text: str, max_rows: int, max_bytes: int) -> DataFrame:
    """``df`` with a column ``block``, written to the shared folder.

    A block is consecutive rows of one partition, at most ``max_rows`` of them with at most ``max_bytes``
    of ``text`` (a longer text is a block of its own), so one very long text or many long ones leave a
    block's memory as it is. The table is bucketed by block, into as many buckets as partitions and
    ``_MAX_BUCKETS`` at most: grouping by block, or joining on it, needs no shuffle of the rows.
    """
    spark = df.sparkSession
    buckets = min(_MAX_BUCKETS, max(1, df.rdd.getNumPartitions()))
    schema = StructType([*df.schema.fields, StructField("block", LongType())])
    df = df.mapInArrow(_number_blocks(text, max_rows, max_bytes), schema)
    name = fresh("blocks")
    (df.write.bucketBy(buckets, "block").sortBy("block").format("parquet").option("path", scratch_path(spark, "blocks")).saveAsTable(name))
    return spark.table(name)
