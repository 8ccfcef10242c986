"""Reading the input tables and files."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import rules
from ..functions.entities import moment
from ..operators.ranking import add_row_number
from ..operators.training import TextModel
from ..schemas import CATEGORIES, LABELLED_TEXT, PUBLIC_TEXT, SEED_EMAILS
from .json_arrays import read_json_array


def small_table(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few fixed rows as a local relation, whose size the optimizer knows."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = fields.fieldNames()
    columns = [dict(zip(names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(columns, schema=to_arrow_schema(fields)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """A database table read in parallel slices of a time or number column."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of {text, label}, however large the file."""
    return read_json_array(spark, path, LABELLED_TEXT).select(*LABELLED_TEXT.fieldNames())


def read_public(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of {subject, body, labels}, however large the file."""
    return read_json_array(spark, path, PUBLIC_TEXT).select(*PUBLIC_TEXT.fieldNames())


def read_seed_emails(spark: SparkSession, path: str, as_of: datetime | Column) -> DataFrame:
    """Sample emails with ``received_at`` counted back from the job's clock.

    The place in the file decides both the default age in days and the hour.
    """
    objects = read_json_array(spark, path, SEED_EMAILS)
    rows = add_row_number(objects, ["file"], [F.col("block"), F.col("number")], "_place").withColumn("seed_no", (F.col("_place") - 1).cast("int"))
    rows = rows.select("seed_no", *SEED_EMAILS.fieldNames())
    days = F.coalesce("days_ago", "seed_no")
    age = F.make_dt_interval(days=days, hours=F.col("seed_no") % 8)
    return rows.withColumn("received_at", moment(as_of) - age)


def categories(spark: SparkSession) -> DataFrame:
    """The category dimension: 14 fixed rows."""
    return small_table(spark, rules.CATEGORIES, CATEGORIES)


def load_model(path: str) -> TextModel | None:
    """A saved classifier, or None if there is none (then the keyword scorer is used).

    Any other failure, a broken model included, is raised.
    """
    return TextModel.load(SparkSession.active(), path)
