"""Indexing documents as they arrive: each batch of a file stream becomes a segment of the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strataseek.sources import documents as D
from strataseek.sources.store import Store


def index_stream(spark: SparkSession, source: str, index_path: str, checkpoint: str, kind: str = "default", analyzer: str = "cjk", dictionary: dict[str, int] | str | None = None, segments: int = 16) -> StreamingQuery:
    """Takes the documents that a scan of the folder would take into the index that plans.engine.Retriever reads, with the same
    arguments: all tables, postings, statistics and vocabulary. A document that comes again is replaced by its later version. A
    batch that runs again after a failure is taken once: the manifest that commits it names the stream and its batch. Beyond
    `segments` segments and changes they are compacted."""
    folder, analyze = D.index_folder(spark, index_path, analyzer, dictionary)
    store = Store(spark, folder, kind, analyze)
    docs = spark.readStream.schema(D.DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(source)
    docs = D.accepted(docs).drop("_corrupt_record")
    if kind == "insurance":
        docs = D.with_meta(docs)

    def take(batch: DataFrame, number: int) -> None:
        store.upsert(batch, checkpoint, number)
        told = store.manifest()
        if len(told["segments"]) + len(told["deletes"]) > segments:
            store.compact()

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
