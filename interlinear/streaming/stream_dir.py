"""A watched folder of Markdown files translated as files arrive.

Structured Streaming reads new files (``binaryFile``: one row per file, UTF-8
checked like S1; a bad file arrives with a null text and status
``invalid_utf8``) and each micro-batch runs the batch job through
``foreachBatch``. An epoch writes its own partition and overwrites it when it
is replayed after a failure, so no document is written twice. Documents are
keyed by their path. The work is stateless per document: no watermark or state
store is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_documents(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    ok = F.is_valid_utf8(F.col("content"))
    return (spark.readStream.format("binaryFile")
            .schema("path string, modificationTime timestamp, length bigint, content binary")
            .option("pathGlobFilter", glob).load(folder)
            .select("path", F.when(ok, F.decode("content", "UTF-8")).alias("text"),
                    F.when(ok, F.lit("normal")).otherwise(F.lit("invalid_utf8")).alias("read_status")))


def translate_stream(spark: SparkSession, folder: str, out: str, checkpoint: str,
                     job: Callable[[DataFrame], DataFrame], available_now: bool = True):
    """Run ``job(docs) -> DataFrame`` on every micro-batch (``doc_id`` is the
    path) and write its result to partition ``epoch`` of the parquet table
    ``out``. Returns the started query."""
    docs = stream_documents(spark, folder).withColumn("doc_id", F.col("path"))

    def each(batch: DataFrame, epoch: int) -> None:
        write_epoch(job(batch), out, epoch)

    w = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def write_epoch(result: DataFrame, out: str, epoch: int) -> None:
    """One epoch's rows as its own partition folder: a replay replaces them."""
    result.write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={int(epoch)}")
