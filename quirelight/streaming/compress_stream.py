"""Documents compressed as they arrive; an extension, since passes are per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cos.passes import Options
from ..plans.compress import compress


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of files *.pdf that arrive under a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "content")


def start(pdfs: DataFrame, out: str, checkpoint: str, options: Options = Options(), **trigger) -> StreamingQuery:
    """Writes results as Parquet; a batch that is run again after a failure is written once."""
    stream = compress(pdfs, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
