"""A file stream over a folder of file lists; each batch is digested against what is known, so only new content
is computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, sha string, text string"


def digest_stream(spark: SparkSession, source: str, store: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Reads Parquet files (``SCHEMA``) that are new in ``source``, computes rows of unknown content and appends
    them to ``store`` (sha and what ``compute`` adds); ends when all is read.

    A batch's rows go to a folder of its number, so a batch that is run again replaces its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        fresh = df.groupBy("sha").agg(F.min_by("text", "path").alias("text"))
        try:
            known = df.sparkSession.read.parquet(f"{store}/batch=*").select("sha")
            known = known.filter(~F.input_file_name().contains(f"batch={number}/")).distinct()
            fresh = fresh.join(known, "sha", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        compute(fresh).write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
