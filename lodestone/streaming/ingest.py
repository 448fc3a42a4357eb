"""Documents that keep arriving: the batch chunker on a stream of files.

Chunking works within a document, so it runs on a stream as it is; each micro-batch's chunks are
appended as Parquet. An index is built from them in a batch, as its weights depend on the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone import schemas
from lodestone.operators import chunking


def arriving_docs(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.DOCS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append_chunks(docs: DataFrame, folder: str) -> StreamingQuery:
    """Starts the query: chunks of every document under folder/chunks, exactly once by its checkpoint."""
    out = chunking.chunk_documents(docs)
    return out.writeStream.format("parquet").option("path", f"{folder}/chunks").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
