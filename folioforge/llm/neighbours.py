"""The most similar vectors for every vector: an inverted multi-index joined with itself.

Vectors are normalised and cut into two halves, each quantised by its own k-means, so a pair of centroids is a cell.
For every vector the cells are visited in order of summed distance (the multi-sequence algorithm), and the entries of
the first ``probes`` cells are reranked by cosine. The join runs per first-half centroid: a vector travels once for
each first half among its cells, the second halves are walked inside that block by matrix products.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.bloom import bloom_filter, might_contain
from folioforge.session import cut

#: The index is fitted on at most this many vectors, chosen by a hash of their ids; all vectors are indexed.
SAMPLE = 20_000
#: Entries of a block beyond which it is parted, and vectors per cell that the number of centroids aims at.
BLOCK_ROWS = 50_000
CELL_ROWS = 100
#: Entries of one cell beyond which it is hot: entries and askers are then parted by a hash, and every part of the
#: entries meets every part of the askers in a task of its own.
HOT_ROWS = 20_000
#: Products held at once in a block.
CHUNK = 4_000_000
_SCALE = 32_767.0


# ---------------------------------------------------------------- rows


def gathered_copies(rows: DataFrame, neighbours: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members): rows of one and the same vector become one class, so a hot vector is compared once.

    A class lists enough of its rows to serve anyone as neighbours: the first ``neighbours`` ids of each of the first
    ``neighbours + 1`` documents. members has (id, doc, class) of all rows that share a vector.
    """
    marked = rows.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding"))
    shared = marked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = bloom_filter(shared, F.col("h"), max(1024, n // 8))
    maybe = might_contain(known, F.col("h"))
    alone = marked.filter(~maybe).select(
        "id", "doc", "embedding", F.lit(None).cast("array<struct<doc:bigint,id:string>>").alias("rows"), F.lit(False).alias("many")
    )
    copies = marked.filter(maybe)
    within = Window.partitionBy("h", "g", "doc").orderBy("id")
    per_doc = (
        copies.withColumn("r", F.row_number().over(within))
        .filter(F.col("r") <= neighbours)
        .groupBy("h", "g", "doc")
        .agg(F.min("id").alias("id"), F.collect_list("id").alias("ids"), F.first("embedding").alias("embedding"))
    )
    classes = (
        per_doc.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("id")))
        .filter(F.col("r") <= neighbours + 1)
        .groupBy("h", "g")
        .agg(
            F.min("id").alias("id"),
            F.first("embedding").alias("embedding"),
            F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("doc").alias("doc"), i.alias("id"))))).alias("rows"),
            F.when(F.count(F.lit(1)) == 1, F.first("doc")).alias("doc"),
        )
        .withColumn("many", F.lit(True))
    )
    members = copies.join(classes.select("h", "g", F.col("id").alias("class")), ["h", "g"]).select("id", "doc", "class")
    return alone.unionByName(classes.select("id", "doc", "embedding", "rows", "many")), members


# ---------------------------------------------------------------- index


@dataclass
class MultiIndex:
    """Centroids of the two halves, and into how many parts each first-half block is split by its second halves.

    hot gives for a cell (first, second) the parts of its entries, the parts of its askers and its first salt.
    """

    halves: tuple[np.ndarray, np.ndarray]
    salts: np.ndarray
    dim: int
    probes: int
    hot: dict[tuple[int, int], tuple[int, int, int]]

    def groups(self) -> int:
        return int(self.salts.sum()) + sum(e * q for e, q, _ in self.hot.values())

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        cut = self.dim // 2
        return [(c * c).sum(1) - 2 * (x @ c.T) for x, c in zip((unit[:, :cut], unit[:, cut:]), self.halves)]


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)
        sizes = np.bincount(nearest, minlength=len(centres))
        order = np.argsort(nearest, kind="stable")
        ends = np.cumsum(sizes)
        for j in np.nonzero(sizes)[0]:
            centres[j] = points[order[ends[j] - sizes[j] : ends[j]]].mean(axis=0)
    return centres.astype(np.float32)


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the rows that have a finite non-zero vector of length dim, and those vectors, normalised."""
    lengths = np.diff(column.offsets.to_numpy())
    valid = lengths == dim
    if column.null_count:
        valid &= ~column.is_null().to_numpy(zero_copy_only=False)
    rows = np.nonzero(valid)[0]
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    starts = column.offsets.to_numpy()[:-1][rows]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = values[starts[:, None] + np.arange(dim)]
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], (vectors[good] / norms[good][:, None]).astype(np.float32)


def fit_index(rows: DataFrame, n: int, dim: int, probes: int, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, hot_rows: int = HOT_ROWS) -> MultiIndex | None:
    """Centroids from a bounded sample; their number grows with the root of the rows, so that cells keep their size."""
    k = int(np.clip(round((n / cell_rows) ** 0.5), 2, 1024))
    limit = max(sample, 40 * k)
    picked = rows.select("id", "embedding").filter(F.col("id").isNotNull() & (F.size("embedding") == dim))
    if n > limit:
        picked = picked.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < int(limit / n * (1 << 30)))
    table = picked.select("embedding").limit(2 * limit).toArrow()
    units = [unit_vectors(c, dim)[1] for c in table.column("embedding").chunks]
    points = np.concatenate([np.empty((0, dim), np.float32), *units])
    if not len(points):
        return None
    cut = dim // 2
    index = MultiIndex((k_means(points[:, :cut], k), k_means(points[:, cut:], k, seed=1)), np.ones(k, int), dim, probes, {})
    kb = len(index.halves[1])
    a, b = nearest_cells(*index.distances(points), probes)
    rows_of = np.bincount(a[:, 0] * kb + b[:, 0], minlength=k * kb) * (n / len(points))
    askers_of = np.bincount((a * kb + b).ravel(), minlength=k * kb) * (n / len(points))
    is_hot = rows_of > hot_rows
    expected = np.where(is_hot, 0, rows_of)[: len(index.halves[0]) * kb].reshape(-1, kb).sum(1)
    index.salts = np.clip(np.ceil(expected / BLOCK_ROWS), 1, kb).astype(int)
    free = index.salts.copy()
    for c in np.nonzero(is_hot)[0]:
        first, entry_parts, asker_parts = int(c // kb), int(-(-rows_of[c] // hot_rows)), int(-(-askers_of[c] // (4 * hot_rows)))
        index.hot[first, int(c % kb)] = entry_parts, asker_parts, int(free[first])
        free[first] += entry_parts * asker_parts
    return index


def nearest_cells(first: np.ndarray, second: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``probes`` centroid pairs of least summed distance, in order.

    The multi-sequence walk: the frontier holds, for each first-half centroid in order of distance, the next second-half
    one; a pair is ready once the pair before it in its row and in the row above are taken. The frontier is kept as an
    array with one row per vector, its least entry is popped for all vectors at once.
    """
    n = len(first)
    a, b = (np.argsort(d, axis=1, kind="stable")[:, :probes] for d in (first, second))
    da, db = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
    steps = min(probes, a.shape[1] * b.shape[1])
    at = np.zeros((n, a.shape[1]), int)
    rows = np.arange(n)
    out_a, out_b = np.empty((n, steps), int), np.empty((n, steps), int)
    for step in range(steps):
        ready = at < b.shape[1]
        ready[:, 1:] &= at[:, :-1] > at[:, 1:]
        value = np.where(ready, da + np.take_along_axis(db, np.minimum(at, b.shape[1] - 1), 1), np.inf)
        i = value.argmin(axis=1)
        j = at[rows, i]
        out_a[:, step], out_b[:, step] = a[rows, i], b[rows, j]
        at[rows, i] += 1
    return out_a, out_b


# ---------------------------------------------------------------- join

_ROUTED = pa.schema(
    [
        ("block", pa.int32()), ("salt", pa.int32()), ("entry", pa.bool_()), ("id", pa.string()), ("doc", pa.int64()),
        ("rows", pa.list_(pa.struct([("doc", pa.int64()), ("id", pa.string())]))), ("many", pa.bool_()),
        ("vector", pa.binary()), ("cell", pa.int16()), ("probes", pa.list_(pa.int16())),
    ]
)
_ROUTED_DDL = (
    "block int, salt int, entry boolean, id string, doc long, rows array<struct<doc:bigint,id:string>>, many boolean, "
    "vector binary, cell short, probes array<short>"
)


def _route(index: MultiIndex, batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, units = unit_vectors(batch.column("embedding"), index.dim)
    if not len(rows):
        return pa.RecordBatch.from_pylist([], _ROUTED)
    first, second = index.distances(units)
    a, b = nearest_cells(first, second, index.probes)
    packed = np.round(units * _SCALE).astype(np.int16)
    n, t = a.shape
    owner, flat_a, flat_b, rank = np.repeat(np.arange(n), t), a.ravel(), b.ravel(), np.tile(np.arange(t), n)
    hot = np.zeros(len(owner), bool)
    if index.hot:
        codes = np.array([x * 65_536 + y for x, y in index.hot])
        hot = np.isin(flat_a * 65_536 + flat_b, codes)
    # one copy per distinct block and part of it
    x, y, who = flat_a[~hot], flat_b[~hot], owner[~hot]
    part = y % index.salts[x]
    order = np.lexsort((part, x, who))
    x, y, who, part, own = x[order], y[order], who[order], part[order], rank[~hot][order] == 0
    new = np.ones(len(who), bool)
    new[1:] = (x[1:] != x[:-1]) | (part[1:] != part[:-1]) | (who[1:] != who[:-1])
    begins = np.nonzero(new)[0]
    lengths = np.diff(np.r_[begins, len(who)])
    entry = np.logical_or.reduceat(own, begins) if len(begins) else np.zeros(0, bool)
    copies = [(who[begins], x[begins], part[begins], entry, lengths)]
    values = [y]
    if hot.any():
        ids = batch.column("id").take(pa.array(rows)).to_pylist()
        for i in np.nonzero(hot)[0].tolist():
            k, cell = int(owner[i]), (int(flat_a[i]), int(flat_b[i]))
            entries, askers, base = index.hot[cell]
            h = zlib.crc32(ids[k].encode("utf-8", "surrogatepass"))
            asks = base + np.arange(entries) * askers + h % askers
            copies.append((np.full(entries, k), np.full(entries, cell[0]), asks, np.zeros(entries, bool), np.ones(entries, int)))
            values.append(np.full(entries, cell[1]))
            if rank[i] == 0:
                lies = base + (h >> 8) % entries * askers + np.arange(askers)
                copies.append((np.full(askers, k), np.full(askers, cell[0]), lies, np.ones(askers, bool), np.zeros(askers, int)))
    who, block, salt, entry, lengths = map(np.concatenate, zip(*copies))
    values = np.concatenate(values)
    offsets = np.r_[0, np.cumsum(lengths)]
    source = pa.array(rows[who])
    size = index.dim * 2
    vectors = pa.Array.from_buffers(
        pa.binary(), len(who), [None, pa.py_buffer((np.arange(len(who) + 1) * size).astype(np.int32)), pa.py_buffer(packed[who].tobytes())]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block, pa.int32()), pa.array(salt, pa.int32()), pa.array(entry), batch.column("id").take(source),
            batch.column("doc").take(source), batch.column("rows").take(source).cast(_ROUTED.field("rows").type),
            batch.column("many").take(source), vectors, pa.array(b[:, 0][who], pa.int16()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int16())),
        ],
        schema=_ROUTED,
    )


_HITS = pa.schema(
    [
        ("query", pa.string()), ("doc", pa.int64()), ("many", pa.bool_()), ("similarity", pa.float64()),
        ("rows", pa.list_(pa.struct([("doc", pa.int64()), ("id", pa.string())]))),
    ]
)
_HITS_DDL = "query string, doc long, many boolean, similarity double, rows array<struct<doc:bigint,id:string>>"


def _prune(q: np.ndarray, e: np.ndarray, s: np.ndarray, qdoc: np.ndarray, edoc: np.ndarray, rank: np.ndarray, k: int):
    """Per query the best k entries; for a query of several documents the best k of each of the best k + 1 documents."""
    order = np.lexsort((rank[e], -s, q))
    q, e, s = q[order], e[order], s[order]
    doc = np.where(qdoc[q] < 0, edoc[e], 0)
    by = np.lexsort((np.arange(len(q)), doc, q))
    new = np.r_[True, (q[by][1:] != q[by][:-1]) | (doc[by][1:] != doc[by][:-1])]
    begins = np.nonzero(new)[0]
    place = np.arange(len(by)) - np.repeat(begins, np.diff(np.r_[begins, len(by)]))
    keep = np.sort(by[place < k])
    q, e, s = q[keep], e[keep], s[keep]
    new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
    begins = np.nonzero(new)[0]
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
    keep = place < np.where(qdoc[q] < 0, k * (k + 2), k)
    return q[keep], e[keep], s[keep]


def _join_block(table: pa.Table, dim: int, k: int, least: float) -> pa.Table:
    """All queries of a block against the entries of the cells they probe."""
    table = table.combine_chunks()
    n = table.num_rows
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.int16).reshape(n, dim).astype(np.float32)
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    entry = table.column("entry").to_numpy()
    doc = np.array([-1 if d is None else d for d in table.column("doc").to_pylist()], np.int64)
    ids = table.column("id").to_pylist()
    rank = np.empty(n, int)
    rank[sorted(range(n), key=ids.__getitem__)] = np.arange(n)
    cell = table.column("cell").to_numpy()
    probes = table.column("probes").combine_chunks()
    if isinstance(probes, pa.ChunkedArray):
        probes = probes.chunk(0)
    offsets = probes.offsets.to_numpy()
    asked, asker = probes.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(np.arange(n), np.diff(offsets))
    order = np.argsort(asked, kind="stable")
    asked, asker = asked[order], asker[order]
    at_entries = np.nonzero(entry)[0]
    at_entries = at_entries[np.argsort(cell[at_entries], kind="stable")]
    cells = cell[at_entries]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for c in np.unique(cells):
        lo, hi = np.searchsorted(cells, [c, c + 1])
        entries = at_entries[lo:hi]
        lo, hi = np.searchsorted(asked, [c, c + 1])
        askers = asker[lo:hi]
        for x in range(0, len(entries), 4096):
            part = entries[x : x + 4096]
            right = vectors[part].T
            step = max(1, CHUNK // len(part))
            for y in range(0, len(askers), step):
                some = askers[y : y + step]
                products = vectors[some] @ right
                i, j = np.nonzero(products >= least)
                if not len(i):
                    continue
                q, e, s = some[i], part[j], products[i, j].astype(np.float64)
                # a query of one document never meets rows of that document only
                other = (doc[q] < 0) | (doc[e] != doc[q])
                if not other.any():
                    continue
                found.append((q[other], e[other], np.minimum(s[other], 1.0)))
                held += int(other.sum())
                if held > 2_000_000:
                    found = [_prune(*map(np.concatenate, zip(*found)), doc, doc, rank, k)]
                    held = len(found[0][0])
    if not found:
        return _HITS.empty_table()
    q, e, s = _prune(*map(np.concatenate, zip(*found)), doc, doc, rank, k)
    many, rows = table.column("many").to_pylist(), table.column("rows")
    out_rows = []
    for x in e.tolist():
        own = rows[x].as_py() if many[x] else None
        out_rows.append(own if own else [{"doc": int(doc[x]), "id": ids[x]}])
    return pa.Table.from_pydict(
        {
            "query": [ids[x] for x in q.tolist()],
            "doc": [None if doc[x] < 0 else int(doc[x]) for x in q.tolist()],
            "many": [bool(many[x]) for x in q.tolist()],
            "similarity": s,
            "rows": out_rows,
        },
        _HITS,
    )


def nearest_vectors(
    rows: DataFrame,
    neighbours: int = 5,
    least: float = 0.9,
    dim: int = 64,
    probes: int = 8,
    sample: int = SAMPLE,
    fit_on: DataFrame | None = None,
    expected: int | None = None,
    cell_rows: int = CELL_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(id, neighbour, similarity, place): for each row its ``neighbours`` most similar rows of other documents.

    ``rows`` has id (string, unique), doc (long, not negative) and embedding. Rows with a null id or doc, or whose
    embedding is null, of another length, zero or not finite take no part. Only similarities of at least ``least``
    count; ties go to the smaller id. The index is fitted on at most ``sample`` vectors (more only for very many
    centroids) and holds every row; vectors travel as 16-bit fixed point, which changes a cosine by about 1e-5.
    An empty table gives no rows. ``fit_on`` may give rows (id, embedding) that are cheaper to read for the sample, and
    ``expected`` their rough number, if ``rows`` is not a plain table.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col("id").isNotNull() & (F.col("doc") >= 0) & (F.size("embedding") == dim))
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("doc").cast("long").alias("doc"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count() if expected is None else expected
    base = rows if fit_on is None else fit_on.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    index = fit_index(base, n, dim, probes, sample, cell_rows, hot_rows)
    if index is None:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, place int")
    classes, members = gathered_copies(rows, neighbours, n)
    shared = spark.sparkContext.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _route(shared.value, batch)

    # twice as many partitions as groups, so that a task holds about one block, whatever the number of rows
    tasks = int(np.clip(2 * index.groups(), 8, 100_000))
    routed = classes.select("id", "doc", "embedding", "rows", "many").mapInArrow(route, _ROUTED_DDL).repartition(tasks, "block", "salt")
    # only findings are left after this; both branches below read them
    hits = cut(routed.groupBy("block", "salt").applyInArrow(lambda t: _join_block(t, dim, neighbours, least), _HITS_DDL))

    candidate = F.struct((-F.col("similarity")).alias("far"), F.col("row.id").alias("id"), F.col("row.doc").alias("doc"))
    best = (
        hits.withColumn("row", F.explode("rows"))
        .groupBy("query", "doc", "many")
        .agg(F.array_sort(F.array_distinct(F.collect_list(candidate))).alias("found"))
    )
    alone = best.filter(~F.col("many")).select(F.col("query").alias("id"), "doc", "found")
    among = best.filter("many").select(F.col("query").alias("class"), "found").join(members, "class").select("id", "doc", "found")
    own = F.col("doc")
    top = alone.unionByName(among).select(
        "id", F.posexplode(F.slice(F.filter("found", lambda x: x["doc"] != own), 1, neighbours)).alias("place", "hit")
    )
    return top.select("id", F.col("hit.id").alias("neighbour"), (-F.col("hit.far")).alias("similarity"), F.col("place").cast("int").alias("place"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair of which one is among the neighbours of the other, once."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
