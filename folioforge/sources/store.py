"""Vector collections as files: JSON arrays for exchange, Parquet for use; and relational sources."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.schemas import CHUNK, ENTITIES


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHUNK).withColumn("ord", F.lit(0).cast("long"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, metadata, embedding, ord) of a JSON array; a missing, blank or unreadable file gives an empty one.

    Entries keep their place as ord. A single JSON array is one value for any reader, so this is for exchange; larger
    collections are kept as Parquet.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return _empty(spark)
    whole = spark.read.text(path, wholetext=True).filter(F.length(F.trim("value")) > 0)
    entries = F.from_json("value", "array<struct<id:string,text:string,metadata:struct<documentId:bigint,documentTitle:string>,embedding:array<double>>>")
    return whole.select(F.posexplode(entries).alias("ord", "e")).select("e.*", F.col("ord").cast("long").alias("ord"))


def write_collection(rows: DataFrame, path: str) -> None:
    """As Parquet, sorted within files by document, so that reading one document's chunks skips the rest."""
    rows.sortWithinPartitions("metadata.documentid", "ord").write.mode("overwrite").parquet(path)


def export_collection(rows: DataFrame, path: str) -> None:
    """As JSON lines in order of ord; one line per chunk."""
    rows.orderBy("ord").drop("ord").write.mode("overwrite").json(path)


def to_json_array(rows: DataFrame, most: int = 100_000) -> str:
    """The collection as one JSON array, for exchange; refuses collections of more than ``most`` chunks."""
    lines = rows.orderBy("ord").drop("ord").limit(most + 1).toJSON().collect()
    if len(lines) > most:
        raise ValueError(f"more than {most} chunks; use write_collection")
    return json.dumps([json.loads(x) for x in lines], ensure_ascii=False, indent=2)


def read_table(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """An entity's table from Parquet, under its fixed schema."""
    return spark.read.schema(ENTITIES[entity]).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A relational table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **(options or {})).load()


def create_tables(spark: SparkSession, base: str, buckets: int = 64) -> None:
    """The entities' tables under ``base``; messages are bucketed by session, which is how they are read."""
    for name, schema in ENTITIES.items():
        path = os.path.join(base, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        clustered = f"CLUSTERED BY (session_id) SORTED BY (create_time) INTO {buckets} BUCKETS" if name == "chat_messages" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {clustered} LOCATION '{path}'")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def run(spark: SparkSession, statement: str, parameters: list | None = None) -> DataFrame:
    return spark.sql(statement, args=parameters or [])


def first(spark: SparkSession, statement: str, parameters: list | None = None) -> dict | None:
    row = run(spark, statement, parameters).first()
    return row.asDict() if row else None
