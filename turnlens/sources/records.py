"""JSON records: lines of objects, or one array a file, with the schema of a mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_json(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    """The objects of all .json files under a path.

    With a schema nothing is inferred, so files are read once and only for the
    columns in use. ``array`` files hold one array or object over several lines.
    A file that isn't JSON raises an error rather than giving nulls.
    """
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", array).option("pathGlobFilter", "*.json")
    return (reader.schema(schema) if schema else reader).json(path)
