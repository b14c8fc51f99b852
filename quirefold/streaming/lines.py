"""JSON lines as a stream of files, read and written so that a restart gives no row twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructType

#: Holds a line that is no JSON object of the schema, as it stands in the file.
DAMAGED = "damaged_line"


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the rows of new files in a folder, one JSON object a line; blank lines are skipped, and a damaged line is a row of nulls with its text in ``DAMAGED``."""
    if DAMAGED in schema.names:
        raise ValueError(f"{DAMAGED} is taken")
    wide = StructType([*schema.fields]).add(DAMAGED, StringType())
    return spark.readStream.schema(wide).option("columnNameOfCorruptRecord", DAMAGED).json(path)


def writing_lines(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writes a stream of ``json_lines`` as JSON lines, whole rows to ``good`` and damaged lines to ``damaged``, each batch to a folder of its number.

    A batch that runs again, after a failure between its files and its mark in the checkpoint, replaces its own folder, so its rows are there once.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            rows.where(F.col(DAMAGED).isNull()).drop(DAMAGED).write.mode("overwrite").json(f"{folder}/good/batch={batch}")
            rows.where(F.col(DAMAGED).isNotNull()).select(F.col(DAMAGED).alias("value")).write.mode("overwrite").text(f"{folder}/damaged/batch={batch}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_lines(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows that ``writing_lines`` has written so far."""
    return spark.read.schema(schema).json(f"{folder}/good/batch=*")
