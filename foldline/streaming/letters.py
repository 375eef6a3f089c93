"""Our own addition: structures that arrive as files are encoded, and letter pairs counted, as streams.

Neither needs event time: encoding is stateless, and the counts are as many as pairs of letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, length, modificationTime of files as they arrive."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def encode_arriving(files: DataFrame, encode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Writes encode(batch of sid, content) for each batch of files; a batch that is run again replaces its own output."""
    named = files.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.(pdb|ent)$", "").alias("sid"), "content")

    def write(batch: DataFrame, number: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(letters: DataFrame) -> DataFrame:
    """a, b, n over a stream of aligned letters, counted in both directions; for output mode update or complete."""
    both = letters.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
