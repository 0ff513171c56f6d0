"""Arriving documents cleaned, split, embedded and put into the collection as they come (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.chunking import semantic_chunks
from folioforge.operators.cleaning import clean
from folioforge.operators.models import embed
from folioforge.schemas import DOCUMENT


def chunk_stream(documents: DataFrame, variant: str = "desktop", size: int = 512, overlap: int = 50, embedder: str = "hashed") -> DataFrame:
    """(id, text, metadata, embedding, create_time) of documents (id, title, content, create_time); batch or stream."""
    cleaned = clean(documents.filter(F.col("content").isNotNull()), "content", variant)
    chunks = semantic_chunks(cleaned, "id", "content", size, overlap, keep=["title", "create_time"])
    return chunks.select(
        "id", "text", F.struct(F.col("doc").alias("documentid"), F.col("title").alias("documenttitle")).alias("metadata"), embed(F.col("text"), embedder).alias("embedding"), "create_time"
    )


def current_chunks(collection: DataFrame, arrived: DataFrame) -> DataFrame:
    """The valid chunks of a collection that ``ingest`` writes: those of the latest arrival of each document.

    arrived (document, ord) tells every arrival; a document that came again with fewer chunks, or with none, leaves
    nothing of its former ones.
    """
    latest = arrived.groupBy("document").agg(F.max("ord").alias("_ord"))
    own = (F.col("metadata.documentid") == F.col("document")) & (F.col("ord") == F.col("_ord"))
    return collection.join(latest, own, "left_semi")


def ingest(spark: SparkSession, source: str, collection: str, checkpoint: str, files_per_batch: int = 100, **options) -> StreamingQuery:
    """Follow a folder of document files (JSON lines) and append the chunks of each to the collection.

    A batch is written to its own partition, replaced if the batch runs again; its documents are listed beside it in
    ``{collection}_arrived``, and readers take ``current_chunks`` of both. Of a document that occurs twice in a batch the
    row of the latest create_time counts.
    """
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct("create_time", "content")).alias("d")).select("d.*")
        listed = latest.select(F.col("id").alias("document"), F.lit(number).cast("long").alias("ord"), F.lit(number).alias("batch"))
        listed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{collection}_arrived")
        rows = chunk_stream(latest, **options).withColumn("ord", F.lit(number).cast("long"))
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(collection)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
