"""A Bloom filter of 64-bit codes as an array: built by the executors, bounded in size, probed for many codes at once.

What it does not hold is certainly absent; what it holds is settled by whoever asks, with an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most: 8 MB, whatever it is built of. A fuller one lets more pass, which costs time only.
MAX_BITS = 1 << 26
_WORDS = pa.schema([("word", pa.int64()), ("bits", pa.int64())])


def places(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    size = np.uint64(bits)
    return [codes % size, (codes >> np.uint64(17)) % size, (codes >> np.uint64(34)) % size]


def _set_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
        word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
        order = np.argsort(word, kind="stable")
        word, bit = word[order], bit[order]
        if len(word):
            begins = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            yield pa.RecordBatch.from_pydict({"word": word[begins], "bits": np.bitwise_or.reduceat(bit, begins).view(np.int64)}, _WORDS)


@dataclass
class CodeFilter:
    words: np.ndarray
    bits: int

    def holds(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for at in places(codes, self.bits):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def code_filter(rows: DataFrame, code: str, items: int, per_item: int = 24, max_bits: int = MAX_BITS) -> CodeFilter:
    """Over the distinct codes (long, not null) of a column; only the filter's words reach the driver."""
    size = max(1 << 12, min(max_bits, 1 << int(np.ceil(np.log2(max(items, 1) * per_item)))))
    words = (
        rows.select(code)
        .mapInArrow(lambda it: _set_words(it, size), "word long, bits long")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    held = np.zeros(size >> 6, np.uint64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return CodeFilter(held, size)
