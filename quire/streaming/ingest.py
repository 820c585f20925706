"""Packages as they arrive in a folder: a stateless stream, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import packages


def render_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, mode: str = "semantic", files_a_batch: int = 1000) -> StreamingQuery:
    """Render new .docx files below source to Parquet in sink, then stop: run it again for more."""
    packages.prepare(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_a_batch).load(source)
    out = packages.rendered(files.select(F.xxhash64("path").alias("doc_id"), "content"), mode)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
