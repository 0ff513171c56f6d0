"""Fixed schemas of the entities; sources are read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

USER = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("username", T.StringType()), T.StructField("password", T.StringType())]
)
NOTEBOOK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("create_time", T.TimestampNTZType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("notebook_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("create_time", T.TimestampNTZType()),
    ]
)
CHAT_MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("notebook_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("create_time", T.TimestampNTZType()),
    ]
)
METADATA = T.StructType([T.StructField("documentId", T.LongType()), T.StructField("documentTitle", T.StringType())])
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)
ENTITIES = {"users": USER, "notebooks": NOTEBOOK, "documents": DOCUMENT, "chat_messages": CHAT_MESSAGE, "vector_store": CHUNK}
