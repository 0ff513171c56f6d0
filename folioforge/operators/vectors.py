"""Vector collections: versions, upsert, deletes, and exact similarity search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.bloom import bloom_filter, might_contain

#: Query vectors that one pass over the collection answers; bounds what is sent to the workers.
QUERY_BLOCK = 4096
#: Scores held at once: 32 MB.
PRODUCTS = 4_000_000
_EARLIEST = -(2**62)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double, summed in index order; 0 for unequal lengths, null or zero vectors."""
    fold = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    x, y = a.cast("array<double>"), b.cast("array<double>")
    size = norm(x) * norm(y)
    sound = (F.size(x) == F.size(y)) & (size > 0)
    return F.coalesce(F.when(sound, fold(x, y) / F.when(size > 0, size)), F.lit(0.0))


def current_rows(store: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """(id, ...): of rows that share a key the one of highest order; null keys are left out.

    Keys are counted on their own; rows whose key occurs once, nearly all, are not shuffled, since a Bloom filter of the
    repeated keys shows they need not be.
    """
    rows = store.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.col(order).alias("_ord"), *[c.alias(n) for n, c in columns.items()]
    )
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = bloom_filter(repeated, F.col("id"), max(1024, store.count() // 8))
    again = might_contain(known, F.col("id"))
    newest = F.max_by(F.struct(*columns), F.coalesce(F.col("_ord"), F.lit(_EARLIEST))).alias("v")
    return rows.filter(~again).drop("_ord").unionByName(rows.filter(again).groupBy("id").agg(newest).select("id", "v.*"))


def upsert(store: DataFrame, batch: DataFrame, position: str = "pos") -> DataFrame:
    """store (id, ..., ord) with the rows of batch (id, ..., position): an id keeps its ord, new ids follow the last.

    Within the batch the last row of an id wins; a new id's ord is the first free one plus its first position (from 0),
    so order is kept without numbering the batch in one place. Rows without id (null or empty) or embedding are skipped.
    """
    fields = [c for c in store.columns if c != "ord"]
    wanted = batch.filter(F.coalesce(F.col("id"), F.lit("")) != "") .filter(F.col("embedding").isNotNull())
    last = (
        wanted.groupBy("id")
        .agg(
            F.max_by(F.struct(*[c for c in fields if c != "id"]), position).alias("v"),
            F.min(position).alias("first"),
        )
        .select("id", "v.*", "first")
    )
    kept = store.select("id", F.col("ord").alias("old"))
    matched = last.join(kept, "id", "left")
    top = store.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("top"))
    fresh = matched.filter(F.col("old").isNull()).join(F.broadcast(top)).select(*fields, (F.col("top") + F.col("first")).alias("ord"))
    replaced = matched.filter(F.col("old").isNotNull()).select(*fields, F.col("old").alias("ord"))
    return store.join(last.select("id"), "id", "left_anti").select(*fields, "ord").unionByName(replaced).unionByName(fresh)


def delete_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def delete_document(store: DataFrame, document: int) -> DataFrame:
    """Rows of other documents; a row without metadata goes too, one whose metadata lacks the id stays."""
    return store.filter(F.col("metadata").isNotNull() & ~F.col("metadata.documentid").eqNullSafe(F.lit(document)))


def delete_documents(store: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """delete_document for a whole table of documents."""
    gone = documents.select(F.col(key).alias("_gone")).filter(F.col("_gone").isNotNull()).distinct()
    return store.filter(F.col("metadata").isNotNull()).join(gone, F.col("metadata.documentid") == F.col("_gone"), "left_anti")


def similarity_search(rows: DataFrame, query: list[float], k: int = 5, only: Column | None = None, digits: int | None = None) -> DataFrame:
    """The k rows most similar to one vector, ties by ord; columns of rows and ``score``. An empty query gives none."""
    if not query:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    kept = rows if only is None else rows.filter(only)
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    kept = kept.withColumn("score", score if digits is None else F.round(score, digits))
    return kept.orderBy(F.desc("score"), "ord").limit(k)


def search_in_documents(rows: DataFrame, query: list[float], documents: DataFrame, key: str, k: int = 8, digits: int | None = None) -> DataFrame:
    """similarity_search among the chunks of given documents; no documents give no rows."""
    wanted = documents.select(F.col(key).alias("_doc")).distinct()
    return similarity_search(rows.join(wanted, F.col("document_id") == F.col("_doc"), "left_semi"), query, k, digits=digits)


def _partial(queries: list[int], matrix: np.ndarray, k: int, digits: int, exclude_self: bool):
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    safe = matrix / np.where(norms > 0, norms, 1)[:, None]
    schema = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array(queries, np.int64)
        for batch in batches:
            rows, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            good = np.nonzero(lengths == matrix.shape[1])[0]
            if len(good):
                flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = flat[vectors.offsets.to_numpy()[:-1][good][:, None] + np.arange(matrix.shape[1])]
                size = np.sqrt((x * x).sum(axis=1))
                x = x / np.where(size > 0, size, 1)[:, None]
            out_q, out_r, out_s = [], [], []
            # so many queries at once that their scores stay small
            step = max(1, PRODUCTS // max(1, len(rows)))
            for first in range(0, len(ids), step):
                own = ids[first : first + step]
                scores = np.zeros((len(own), len(rows)))
                if len(good):
                    scores[:, good] = safe[first : first + step] @ x.T
                scores = np.round(scores, digits) + 0.0
                if exclude_self:
                    scores[own[:, None] == rows[None, :]] = -np.inf
                for q, s in zip(own, scores):
                    least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                    pick = np.nonzero((s >= least) & (s > -np.inf))[0]
                    pick = pick[np.lexsort((rows[pick], -s[pick]))][:k]
                    out_q.append(np.full(len(pick), q))
                    out_r.append(rows[pick])
                    out_s.append(s[pick])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in (out_q, out_r, out_s)] if out_q else [[], [], []], schema=schema
            )

    return run


def search_many(
    rows: DataFrame, queries: DataFrame, key: str, k: int = 5, digits: int = 6, exclude_self: bool = False, block: int = QUERY_BLOCK
) -> DataFrame:
    """(query, row, score, place): the k most similar rows for each query vector, ties by key.

    Queries are taken in blocks of bounded size; each pass keeps k rows per query and batch, so only those are shuffled.
    """
    source = rows.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias("row"), F.col("embedding").cast("array<double>"))
    found, held = None, []

    def flush() -> None:
        nonlocal found, held
        if not held:
            return
        by_size: dict[int, list] = {}
        for q, v in held:
            by_size.setdefault(len(v), []).append((q, v))
        for pairs in by_size.values():
            matrix = np.array([v for _, v in pairs], np.float64)
            part = source.mapInArrow(_partial([q for q, _ in pairs], matrix, k, digits, exclude_self), "query long, row long, score double")
            found = part if found is None else found.unionByName(part)
        held = []

    for r in queries.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("long"), F.col("embedding").cast("array<double>")).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) >= block:
            flush()
    flush()
    if found is None:
        return rows.sparkSession.createDataFrame([], "query long, row long, score double, place int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
