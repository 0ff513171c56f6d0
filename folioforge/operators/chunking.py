"""Documents into chunks: a native sliding window, and a paragraph- and sentence-aware splitter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One Chinese character, a run of Latin word characters, a run of blanks, or one other character; lossless.
TOKEN_PATTERN = "[\\u4e00-\\u9fff]|[A-Za-z0-9_À-ɏ]+|[ \\t\\n\\r\\f]+|[^ \\t\\n\\r\\f]"
_TOKENS = re.compile(TOKEN_PATTERN)
_SENTENCE = re.compile(r"(?<=[。？！；\n])")
_PARAGRAPH = re.compile(r"\n\n+")

Tokenizer = Callable[[str], list[str]]
_tokenizers: dict[str, Tokenizer] = {}


def simple_tokens(text: str) -> list[str]:
    return _TOKENS.findall(text)


def register_tokenizer(name: str, tokenize: Tokenizer) -> None:
    """A tokenizer must be lossless: its tokens joined give the text."""
    _tokenizers[name] = tokenize


def tokenizer(name: str = "simple") -> Tokenizer:
    return _tokenizers[name]


register_tokenizer("simple", simple_tokens)
register_tokenizer("characters", list)


def tokens(c: Column) -> Column:
    """The simple tokenizer as a native expression."""
    return F.regexp_extract_all(c, F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def paragraphs(c: Column) -> Column:
    return F.split(c, "\n\n+")


def sentences(c: Column) -> Column:
    """Split after 。 ？ ！ ； and line ends; no empty tail."""
    return F.filter(F.split(c, "(?<=[。？！；\\n])"), lambda x: x != "")


def chunk_id(document: Column, ordinal: Column) -> Column:
    return F.format_string("doc:%d:chunk:%d", document.cast("long"), ordinal.cast("int"))


def sliding_chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(doc, ordinal, id, text): windows of ``size`` tokens, each ``overlap`` tokens into the one before.

    The last window is the first that reaches the end. Blank and null texts give none. Windows are cut inside the row,
    so nothing is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in [0, size)")
    stride = size - overlap
    n = F.size("toks")
    windows = F.greatest(F.lit(1), F.ceil((n - F.lit(overlap)) / F.lit(stride)).cast("int"))
    return (
        docs.filter(F.length(F.trim(F.col(text))) > 0)
        .select(F.col(key).alias("doc"), tokens(F.col(text)).alias("toks"))
        .select("doc", F.posexplode(F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.array_join(F.slice("toks", i * stride + 1, size), ""))).alias("ordinal", "text"))
        .select("doc", "ordinal", chunk_id(F.col("doc"), F.col("ordinal")).alias("id"), "text")
    )


class Piece(NamedTuple):
    """What is never divided: a short paragraph or a sentence of a long one, as tokens.

    gap: the tokens of the blank line below it. fresh: nothing from above may share a chunk with it.
    """

    tokens: list[str]
    gap: list[str]
    fresh: bool


def pieces(text: str, size: int, tokenize: Tokenizer) -> Iterator[Piece]:
    gap = tokenize("\n\n")
    for paragraph in _PARAGRAPH.split(text):
        whole = tokenize(paragraph)
        if len(whole) <= size:
            yield Piece(whole, gap, False)
        else:
            parts = [x for x in _SENTENCE.split(paragraph) if x]
            yield from (Piece(tokenize(x), [], i == 0) for i, x in enumerate(parts))


#: What a blank line counts for when a chunk is filled, however many tokens it has.
GAP_COUNT = 2


def chunk_spans(stream: list[str], parts: Iterator[Piece], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Lays the pieces end to end in ``stream`` and tells which range of it is each chunk.

    A chunk is full when the next piece would bring its count over ``size``; the next chunk then begins ``overlap`` tokens
    before its end, or where this one began. The gap below a piece that begins a chunk this way is left out.
    """
    begin = count = 0
    for piece in parts:
        end = len(stream)
        fresh_count = 0 if piece.fresh else count
        full = fresh_count + len(piece.tokens) > size
        if (piece.fresh or full) and begin < end:
            yield begin, end
        if piece.fresh:
            begin = end
        if full:
            begin = max(begin, end - overlap)
        stream += piece.tokens if full else piece.tokens + piece.gap
        count = len(stream) - begin if full else fresh_count + len(piece.tokens) + GAP_COUNT * bool(piece.gap)
    if begin < len(stream):
        yield begin, len(stream)


def split_semantic(text: str, size: int = 512, overlap: int = 50, tokenize: Tokenizer = simple_tokens) -> list[str]:
    """Paragraphs are gathered up to ``size`` tokens, longer ones by sentences; chunks overlap except where a long one begins.

    The bound is soft: a longer sentence stays whole, the overlap and the blank line after a paragraph come on top.
    """
    stream: list[str] = []
    spans = list(chunk_spans(stream, pieces(text, size, tokenize), size, overlap))
    return [chunk for chunk in ("".join(stream[a:b]) for a, b in spans) if chunk.strip()]


def semantic_chunks(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50, tokenizer_name: str = "simple", keep: list[str] | None = None) -> DataFrame:
    """(doc, ordinal, id, text, ...) by split_semantic, Arrow batches in and out, with the columns ``keep`` of the document.

    Blank and null texts give none.
    """
    tokenize = tokenizer(tokenizer_name)
    source = docs.select(F.col(key).cast("long"), F.col(text).cast("string"), *(keep or []))
    schema = pa.schema([("doc", pa.int64()), ("ordinal", pa.int32()), ("id", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, i, f"doc:{doc}:chunk:{i}", chunk, at)
                for at, (doc, whole) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                if whole and whole.strip()
                for i, chunk in enumerate(split_semantic(whole, size, overlap, tokenize))
            ]
            *columns, owners = zip(*rows) if rows else [[]] * 5
            own = pa.array(owners, pa.int64())
            kept = [batch.column(2 + j).take(own) for j in range(len(keep or []))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), *kept], names=[*schema.names, *(keep or [])])

    out = T.StructType([*T.StructType.fromDDL("doc long, ordinal int, id string, text string").fields, *source.schema.fields[2:]])
    return source.mapInArrow(run, out)


def chunk_counts(chunks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """docs with chunk_count set to the number of their chunks; documents without chunks keep what they had."""
    counts = chunks.groupBy(F.col("doc").alias(key)).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return docs.join(counts, key, "left").withColumn("chunk_count", F.coalesce("_n", "chunk_count")).drop("_n")
