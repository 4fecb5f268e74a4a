"""Small tables of the driver's own rows, as local relations: Spark folds projections and filters over them without a job."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a table; schema as DDL."""
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kinds)


def brought_here(df: DataFrame) -> DataFrame:
    """A table that is known to be small, run once and kept as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
