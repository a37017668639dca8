"""Readers and writers of the files between stages, all with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voc.schemas import RESULTS
from voc.sources.json_array import read_json_array

_CSV = dict(header=True, multiLine=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema: T.StructType, array_file: bool) -> DataFrame:
    """JSON rows of a schema; a path that does not exist gives an empty table.

    ``array_file`` reads files that hold one JSON array each; otherwise there is one object per line. Either way Spark
    splits large files among tasks.
    """
    try:
        return read_json_array(spark, path, schema) if array_file else spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by ``write_csv``; empty text and NULL are kept apart."""
    return spark.read.schema(schema).options(**_CSV, nullValue="\\N", emptyValue="").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(
        header=True, quote='"', escape='"', nullValue="\\N", emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row, one-column document as a text file."""
    df.write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata row and theme rows of a result document; themes carry their ``position``."""
    doc = spark.read.schema(RESULTS).option("multiLine", True).json(path)
    themes = doc.select(F.col("metadata.total_feedback_analyzed").alias("total"), F.posexplode("themes").alias("i", "theme_row"))
    return doc.select("metadata.*"), themes.select("theme_row.*", "total", (F.col("i") + 1).alias("position"))


def read_words(spark: SparkSession, path: str, most: int = 10_000) -> tuple[str, ...]:
    """A word list, one lower-case word a line; a longer list than ``most`` is an error."""
    lines = [r[0].strip().lower() for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"{path} has more than {most} words")
    return tuple(sorted({w for w in lines if w}))
