"""Evaluation passages in training text: winnowed fingerprints, joined, then extended to whole passages.

Of each window of ``w`` k-grams the smallest hash is kept, so any run of k + w - 1 shared tokens shares a fingerprint.
A filter of bounded size over the test fingerprints goes to the workers; what it lets pass of the corpus's fingerprints, a
small part, is joined with the test fingerprints, and documents whose hits line up are read again and extended to whole
passages. Two passes over the corpus, whatever the number of test items; the texts themselves are not shuffled.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.bits import code_filter
from folioforge.operators.bloom import bloom_filter, might_contain
from folioforge.session import cut

#: (k, w, seed, gap) for words and for characters of scripts without spaces; gap is how many altered tokens are bridged.
WORDS = (5, 4, 3, 6)
CHARACTERS = (8, 6, 4, 10)
#: Documents whose fingerprints are worked out at once.
TOGETHER = 256

#: Letters of other scripts that look like Latin ones, after NFKC and lower case.
_LOOKALIKES = str.maketrans("аеорсухіјѕһԁӏвкмнтαορνικυ", "aeopcyxijshdlbkmhtaopviku")
_FOREIGN = re.compile(r"[Ͱ-ӿԀ-ԯ]")
_LATIN_WORD = re.compile(r"[^\W_㐀-鿿぀-ヿ฀-๿]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower()
    return text.translate(_LOOKALIKES) if not text.isascii() and _FOREIGN.search(text) else text


def words_of(text: str) -> list[str]:
    return _LATIN_WORD.findall(text)


def characters_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = ((codes >= 0x3400) & (codes < 0xA000)) | ((codes >= 0x3041) & (codes < 0x30FF)) | ((codes >= 0xE00) & (codes < 0xE80))
    return codes[kept].astype(np.uint64)


class Codes(dict):
    """A stable number for each word, the same in every worker."""

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        if len(self) > 2_000_000:
            self.clear()
        self[word] = value = zlib.crc32(raw) | zlib.adler32(raw) << 32
        return value


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _BASE + tokens[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window of w, each once."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)[:, ::-1]
    at = np.arange(n - w + 1) + (w - 1 - windows.argmin(axis=1))
    return at[np.r_[True, at[1:] != at[:-1]]]


def passage_share(item: np.ndarray, text: np.ndarray, seed: int, gap: int) -> tuple[float, float]:
    """(share of the item that its best passage in the text spans, share of that span that agrees)."""
    n, m = len(item) - seed + 1, len(text) - seed + 1
    if n <= 0 or m <= 0:
        return 0.0, 0.0
    a, b = gram_hashes(item, seed), gram_hashes(text, seed)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    blocks: list[list[int]] = []
    live: dict[int, list[int]] = {}
    for q in np.nonzero(hi > lo)[0]:
        now: dict[int, list[int]] = {}
        for p in order[lo[q] : hi[q]].tolist():
            block = live.get(p - 1)
            if block and block[1] + block[2] - seed + 1 == q:
                block[2] += 1
            else:
                block = [p, int(q), seed]
                blocks.append(block)
            now[p] = block
        live = now
    blocks.sort(key=lambda x: (x[1], x[0]))
    best = (0, 0)
    chain: list[tuple[int, int]] = []
    first = 0
    for j, (p, q, size) in enumerate(blocks):
        top = (size, p)
        while blocks[first][1] + len(item) + gap < q:  # no block is longer than the item
            first += 1
        for i in range(first, j):
            pp, qq, ss = blocks[i]
            dp, dq = p - pp - ss, q - qq - ss
            if -seed < dp <= gap and -seed < dq <= gap and abs(dp - dq) <= 3:
                added = size + min(0, dp, dq)
                if added > 0 and chain[i][0] + added > top[0]:
                    top = (chain[i][0] + added, chain[i][1])
        chain.append(top)
        best = max(best, (top[0], p + size - top[1]))
    return best[1] / len(item), best[0] / max(1, best[1])


def tokens_of(text: str | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the words, characters of scripts without spaces) of a text."""
    plain = normalise(text) if text else ""
    words = words_of(plain)
    chars = characters_of(plain) if not plain.isascii() else np.empty(0, np.uint64)
    return np.fromiter((codes[w] for w in words), np.uint64, len(words)), chars


def item_tokens(text: str | None, codes: Codes) -> tuple[int, np.ndarray]:
    """(kind, tokens): 0 for words, 1 for characters, whichever the item is made of."""
    words, chars = tokens_of(text, codes)
    kind = int(len(chars) > 2 * len(words))
    return kind, chars if kind else words


def _short_code(hashes: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Grams of other sizes and of both kinds live in one table."""
    with np.errstate(over="ignore"):
        return (hashes + np.uint64(size * 2 + kind)) * np.uint64(0xD6E8FEB86659FD93)


_PRINTS = pa.schema([("code", pa.int64()), ("item_id", pa.int64()), ("kind", pa.int8()), ("place", pa.int32()), ("length", pa.int32()), ("size", pa.int8())])


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every gram of each item: a document's fingerprint then meets it wherever its windows fall. A short item is one gram."""
    codes = Codes()
    for batch in batches:
        parts: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind, own = item_tokens(text, codes)
            if not len(own):
                continue
            size = min((WORDS, CHARACTERS)[kind][0], len(own))
            h = _short_code(gram_hashes(own, size), size, kind)
            n = len(h)
            parts.append((h.view(np.int64), np.full(n, item), np.full(n, kind), np.arange(n), np.full(n, len(own)), np.full(n, size)))
        columns = map(np.concatenate, zip(*parts)) if parts else [[]] * len(_PRINTS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PRINTS)], schema=_PRINTS)


_MARKS = pa.schema([("doc_id", pa.int64()), ("code", pa.int64()), ("at", pa.int32())])


def _marks(ids: np.ndarray, texts: list[str | None], held, short: list[list[int]], codes: Codes) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, code, place) of the fingerprints of some documents that the filter holds."""
    both = [tokens_of(t, codes) for t in texts]
    for kind, (k, w, _, _) in enumerate((WORDS, CHARACTERS)):
        starts = np.cumsum([0, *(len(x[kind]) for x in both)])
        tokens = np.concatenate([np.empty(0, np.uint64), *(x[kind] for x in both)])
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        for size in [k, *short[kind]]:
            if len(tokens) < size:
                continue
            hashes = gram_hashes(tokens, size)
            across = owner[: len(hashes)] != owner[size - 1 :]
            if size == k:
                hashes[across] = np.uint64(2**64 - 1)
                picked = winnow(hashes, w)
                picked = picked[~across[picked]]
            else:
                picked = np.nonzero(~across)[0]
            code = _short_code(hashes[picked], size, kind)
            hit = held.holds(code)
            picked, code = picked[hit], code[hit]
            if size != k:
                # of a short item one place in a document is enough
                _, once = np.unique(np.stack([owner[picked].astype(np.int64), code.view(np.int64)]), axis=1, return_index=True)
                picked, code = picked[once], code[once]
            yield ids[owner[picked]], code.view(np.int64), picked - starts[owner[picked]]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of each candidate item that its best passage in the document spans."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64())])
    codes = Codes()
    for batch in batches:
        d, rows = batch.to_pydict(), []
        for doc, text, items in zip(d["doc_id"], d["text"], d["items"]):
            own = tokens_of(text, codes)
            for item in items:
                kind, tokens = item_tokens(item["text"], codes)
                k, _, seed, gap = (WORDS, CHARACTERS)[kind]
                if len(tokens) < k:
                    n = len(tokens)
                    windows = np.lib.stride_tricks.sliding_window_view(own[kind], n) if len(own[kind]) >= n else np.empty((0, n), np.uint64)
                    if (windows == tokens).all(1).any():
                        rows.append((doc, item["item_id"], 1.0))
                    continue
                share, agreed = passage_share(tokens, own[kind], seed, gap)
                if agreed >= 0.75:
                    rows.append((doc, item["item_id"], float(share)))
        columns = zip(*rows) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def candidate_pairs(source: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents and items that share fingerprints in line, over a seventh of the item at least."""
    sizes = prints.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).collect()  # a dozen rows at most
    short = [[r["size"] for r in sizes if r["kind"] == kind and r["size"] < (WORDS, CHARACTERS)[kind][0]] for kind in (0, 1)]
    held = code_filter(prints, "code", sum(r["n"] for r in sizes))
    shared = source.sparkSession.sparkContext.broadcast(held)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i in range(0, len(texts), TOGETHER):
                for columns in _marks(ids[i : i + TOGETHER], texts[i : i + TOGETHER], shared.value, short, codes):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MARKS)], schema=_MARKS)

    marks = source.filter(F.col("doc_id").isNotNull()).mapInArrow(mark, "doc_id long, code long, at int")
    hits = marks.join(prints, "code").withColumn("line", F.col("at") - F.col("place"))
    order = Window.partitionBy("doc_id", "item_id").orderBy("line", "place")
    k, gap = (F.when(F.col("kind") == 1, CHARACTERS[i]).otherwise(WORDS[i]) for i in (0, 3))
    new = F.coalesce(F.col("line") - F.lag("line").over(order) > gap, F.lit(True)).cast("int")
    spans = (
        hits.withColumn("new", new)
        .withColumn("run", F.sum("new").over(order))
        .groupBy("doc_id", "item_id", "run", "kind", "length")
        .agg((F.max("place") - F.min("place")).alias("reach"))
    )
    enough = F.col("reach") + k >= F.greatest(k + 1, 0.15 * F.col("length"))
    return spans.filter((F.col("length") < k) | enough).select("doc_id", "item_id").distinct()


def leaked_items(
    documents: DataFrame,
    eval_items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    share: float = 0.5,
) -> DataFrame:
    """(doc_id, item_id, share): the documents that hold at least ``share`` of an item as one passage.

    Words (characters in scripts without spaces) must come in their order; case, punctuation, blanks, look-alike letters
    and a few altered words between runs do not matter. Any shared run of 8 words or 13 characters is certain to be
    found; an item shorter than a fingerprint (5 words, 8 characters) is found where all of it stands in one run. Null or
    empty texts and items give nothing; repeated documents are reported under each id. Whole texts are searched, whatever
    their length, and any number of items.
    """
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = eval_items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).dropna().distinct()
    prints = cut(items.mapInArrow(_item_prints, "code long, item_id long, kind byte, place int, length int, size byte"))
    pairs = candidate_pairs(source, prints)
    # what a document may hold is bounded by its own length: each of its items stands in it for a good part
    wanted = cut(pairs.join(items, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "text")).alias("items")))
    known = bloom_filter(wanted, F.col("doc_id"), wanted.count())
    found = (
        source.filter(might_contain(known, F.col("doc_id")))
        .join(wanted, "doc_id")
        .select("doc_id", "text", "items")
        .mapInArrow(_passages, "doc_id long, item_id long, share double")
        .filter(F.col("share") >= share)
    )
    # an id may occur on several rows: its best passage counts
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
