"""Models behind plain interfaces: embedders and language models are registered, with offline defaults.

A registered function gets a list of texts and returns as many vectors or texts. It runs on the workers in Arrow
batches, is called with at most ``BATCH`` texts, and is retried on connection errors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import trim
from folioforge.operators.context import cut_single

BATCH, ATTEMPTS, DELAY, FACTOR = 16, 3, 1.5, 1.5
#: What stands for a summary that was not made.
TOO_SHORT, FAILED, NO_CONTENT, GENERATING = "内容过短，无需摘要", "摘要生成失败，请点击重新生成", "文档内容为空，无需摘要", "摘要生成中..."
LEAST_LENGTH = 50

Embedder = Callable[[list[str]], list[list[float]]]
Model = Callable[[list[str]], list[str]]


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """The offline default: character trigrams hashed into ``dim`` places, normalised; the same everywhere."""
    out = []
    for text in texts:
        codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        signs = (h >> np.uint64(40) & np.uint64(1)).astype(np.float64) * 2 - 1
        v = np.bincount((h >> np.uint64(44)) % np.uint64(dim), signs, dim)
        n = np.sqrt((v * v).sum())
        out.append((v / n if n else v).tolist())
    return out


def first_sentences(texts: list[str], n: int = 200) -> list[str]:
    """The offline default of a language model: the beginning of what it was given."""
    return [t[:n] for t in texts]


_embedders: dict[str, Embedder] = {"hashed": hashed_embedding}
_models: dict[str, Model] = {"extract": first_sentences}


def register_embedder(name: str, embed: Embedder) -> None:
    _embedders[name] = embed


def register_llm(name: str, model: Model) -> None:
    _models[name] = model


def retried(call, argument, attempts: int = ATTEMPTS, delay: float = DELAY, factor: float = FACTOR):
    """call(argument), tried again after ``delay`` seconds, ``factor`` times longer each time (1: always the same, as for
    fetching files), on connection errors only."""
    for attempt in range(attempts):
        try:
            return call(argument)
        except (ConnectionError, TimeoutError):
            if attempt + 1 == attempts:
                raise
            time.sleep(delay * factor**attempt)
    return None


def _in_batches(call, texts: list[str], size: int) -> list:
    out: list = []
    for i in range(0, len(texts), size):
        out.extend(retried(call, texts[i : i + size]))
    return out


def embed(text: Column, name: str = "hashed", batch: int = BATCH) -> Column:
    """array<double> of each text; null for null."""
    call = _embedders[name]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            known = part.notna()
            vectors = iter(_in_batches(call, part[known].tolist(), batch))
            yield pd.Series([next(vectors) if k else None for k in known], dtype=object)

    return run(text)


def complete(prompt: Column, name: str = "extract", batch: int = BATCH, failure: str | None = None) -> Column:
    """The model's text for each prompt; if ``failure`` is given it stands for what could not be answered."""
    call = _models[name]

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[str | None] = []
            for i in range(0, len(part), batch):
                texts = part.iloc[i : i + batch]
                known = texts[texts.notna()].tolist()
                try:
                    answers = iter(retried(call, known) if known else [])
                except Exception:
                    if failure is None:
                        raise
                    answers = iter([failure] * len(known))
                out += [next(answers) if pd.notna(t) else None for t in texts]
            yield pd.Series(out, dtype=object)

    return run(prompt)


def summary_input(content: Column) -> Column:
    """What a summary is made from, cut to a limit; null where the content is too short for one."""
    return F.when(F.length(trim(content)) >= LEAST_LENGTH, cut_single(content))


def summarised(docs: DataFrame, content: str, name: str = "extract") -> DataFrame:
    """Adds ``summary``: made, or the fixed text for empty, too short or failed."""
    made = complete(summary_input(F.col(content)), name, failure=FAILED)
    return docs.withColumn(
        "summary",
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, NO_CONTENT).when(F.length(trim(F.col(content))) < LEAST_LENGTH, TOO_SHORT).otherwise(made),
    )


def summary_status(summary: Column) -> Column:
    """generating, failed, too_short, none or ready."""
    return (
        F.when(summary == GENERATING, "generating")
        .when(summary == FAILED, "failed")
        .when(summary == TOO_SHORT, "too_short")
        .when(summary.isNull() | (F.length(trim(summary)) == 0) | (summary == NO_CONTENT), "none")
        .otherwise("ready")
    )
