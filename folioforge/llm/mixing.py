"""Mixing sources to target weights: raking (iterative proportional fitting), then sampling by calibrated weights.

Sizes are tokens of a public tokenizer, counted where the texts are read. Only token totals per (source, language,
topic) cell reach the driver, MAX_CELLS at most: with more, the fit asks for coarser topics (``buckets``) and stops.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Targets may name at most MAX_SOURCES sources; the fit holds at most MAX_CELLS cells. More is an error, nothing is dropped.
MAX_SOURCES = 2_000
MAX_CELLS = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """A file of byte-pair ranks (base64 and rank per line) and the pattern that splits a text beforehand."""

    path: str | None = None
    pattern: str | None = None

    def encoder(self):
        import tiktoken

        path, pattern = self.path, self.pattern
        if path is None:
            import public_tokenizers as public

            path, pattern = public.path("byte_bpe_multi_50k.tiktoken"), pattern or public.PATTERN
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, text: str, keep: dict[str, Column], vocabulary: Vocabulary) -> DataFrame:
    """The columns of ``keep`` and ``tokens``, the size of the whole text; null counts 0. Texts stay in the task."""
    source = documents.select(*[c.alias(n) for n, c in keep.items()], F.col(text).cast("string").alias("_text"))
    schema = source.drop("_text").withColumn("tokens", F.lit(0).cast("long")).schema
    names = [f.name for f in schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            sizes = [_size(encoder, t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=names)

    return source.mapInArrow(count, schema)


def _size(encoder, text: str | None, piece: int = 100_000) -> int:
    """Very long texts are encoded in pieces cut at white space, so that no single call grows with the text."""
    if not text:
        return 0
    text = text.encode("utf-8", "replace").decode()
    if len(text) <= piece:
        return len(encoder.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + piece)
        if end < len(text):
            gap = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = gap if gap > at else end
        total += len(encoder.encode_ordinary(text[at:end]))
        at = end
    return total


@dataclass
class Plan:
    """Expected copies per document of each (source, language, topic) cell, and what each source reaches.

    residuals: what share of the mixture lies elsewhere than the language and the topic marginals ask for.
    """

    weights: list[tuple[str, str, str, float]]
    report: list[tuple[str, float, int, int, float, float, bool]]
    residuals: tuple[float, float] = (0.0, 0.0)


def rake(
    cells: list[tuple[str, str, int, int]],
    targets: list[tuple[str, float, int]],
    rounds: int = 200,
    tolerance: float = 1e-6,
) -> Plan:
    """Cells are (source, language, topic, tokens). Weights are fitted in turn to the three marginals.

    A source's marginal is its target share of T, the tokens of all sources with a target, or less where max_repeat
    times its tokens fall short. Language and topic marginals keep the corpus's own shares of what is mixed. No weight
    exceeds its source's max_repeat; the last step is the source's, so reached shares are exact up to the caps.
    """
    share = {s: max(0.0, a) for s, a, _ in targets}
    repeat = {s: max(0, r) for s, _, r in targets}
    cells = [c for c in cells if c[0] in share]
    tokens = np.array([c[3] for c in cells], float)
    total = tokens.sum()
    sources = sorted(share)
    ids = [{v: i for i, v in enumerate(sorted({c[k] for c in cells}))} for k in (1, 2)]
    by_source = np.array([sources.index(c[0]) for c in cells], int)
    by = [by_source, *[np.array([ids[k][c[k + 1]] for c in cells], int) for k in range(2)]]
    sizes = np.bincount(by_source, tokens, len(sources)) if len(cells) else np.zeros(len(sources))
    cap_of = np.array([repeat[s] for s in sources], float)
    wanted = np.array([share[s] for s in sources]) * total
    goal = np.minimum(wanted, cap_of * sizes)
    caps = cap_of[by_source] if len(cells) else np.zeros(0)
    weights = np.ones(len(cells))
    mixed = goal.sum()
    margins = [goal] + [np.bincount(b, tokens) / max(total, 1) * mixed for b in by[1:]] if len(cells) else [goal]

    def fit(group: np.ndarray, goals: np.ndarray) -> float:
        nonlocal weights
        now = np.bincount(group, weights * tokens, len(goals))
        factor = np.divide(goals, now, out=np.ones_like(goals), where=now > 0)
        weights = np.minimum(weights * factor[group], caps)
        return float(np.abs(now - goals).sum())

    def fit_sources() -> None:
        # what a cap cuts off is made up for by the source's other cells
        for _ in range(50):
            if fit(by_source, goal) <= 1e-9 * max(mixed, 1):
                return

    for _ in range(rounds if len(cells) else 0):
        before = weights.copy()
        for group, goals in list(zip(by, margins))[1:]:
            fit(group, goals)
        fit_sources()
        if np.abs(weights - before).max(initial=0) < tolerance:
            break
    reached = np.bincount(by_source, weights * tokens, len(sources)) if len(cells) else np.zeros(len(sources))
    short = cap_of * sizes < wanted
    report = [
        (s, share[s], int(repeat[s]), int(sizes[i]), float(reached[i]), float(reached[i] / reached.sum()) if reached.sum() else 0.0, bool(short[i]))
        for i, s in enumerate(sources)
    ]
    final = [np.abs(np.bincount(b, weights * tokens, len(m)) - m).sum() / 2 / max(mixed, 1e-9) for b, m in zip(by[1:], margins[1:])] if len(cells) else [0.0, 0.0]
    return Plan([(c[0], c[1], c[2], float(w)) for c, w in zip(cells, weights)], report, (float(final[0]), float(final[1])))


def _cell_columns(source: str, language: str, topic: str, buckets: int | None) -> dict[str, Column]:
    code = F.regexp_extract(F.lower(F.trim(F.col(language))), "^[a-z]{2}", 0)
    return {
        "source": F.col(source).cast("string"),
        "language": F.coalesce(F.nullif(code, F.lit("")), F.lit("??")),
        "topic": F.coalesce((F.col(topic) if buckets is None else F.pmod(F.xxhash64(F.col(topic)), F.lit(buckets))).cast("string"), F.lit("")),
    }


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.select("source", "target_share", "max_repeat").dropna().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    best: dict[str, tuple[float, int]] = {}
    for r in sorted(rows):
        best[r["source"]] = (float(r["target_share"]), int(r["max_repeat"]))
    return [(s, a, n) for s, (a, n) in best.items()]


def _named(documents: DataFrame, source: str, wanted: list[tuple[str, float, int]]) -> DataFrame:
    """Only the documents of sources with a target are read and measured."""
    return documents.filter(F.col(source).isin([s for s, _, _ in wanted])) if wanted else documents.limit(0)


def plan_mixture(sized: DataFrame, wanted: list[tuple[str, float, int]]) -> Plan:
    """The raked plan of documents with source, language, topic and tokens."""
    cells = sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).toArrow()
    if cells.num_rows > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic: give topics in buckets")
    return rake(sorted(zip(*(c.to_pylist() for c in cells.columns))), wanted)


REPORT = "source string, target_share double, max_repeat int, tokens long, mixed_tokens double, reached_share double, short boolean, language_residual double, topic_residual double"


def mixture_report(
    documents: DataFrame,
    targets: DataFrame,
    text: str = "text",
    source: str = "source",
    language: str = "lang",
    topic: str = "notebook_id",
    vocabulary: Vocabulary = Vocabulary(),
    buckets: int | None = None,
) -> DataFrame:
    """One row per source with a target: its tokens, what the mixture takes of it, the share reached, and whether
    max_repeat copies of it stay below its target (``short``). Documents of null or other sources take no part; a
    source without documents is short unless its target is 0; targets with a null field are left out; of targets named
    twice the largest holds. The residuals, the same in every row, tell what share of the mixture lies elsewhere than the
    corpus's own language and topic shares ask for; the caps and the sources go first. An empty corpus gives all shares 0.
    Topics are the values of ``topic``, or ``buckets`` of them by hash if there are too many to fit."""
    wanted = _targets(targets)
    sized = with_tokens(_named(documents, source, wanted), text, _cell_columns(source, language, topic, buckets), vocabulary)
    plan = plan_mixture(sized, wanted)
    return documents.sparkSession.createDataFrame([(*row, *plan.residuals) for row in plan.report], REPORT)


def mixture(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    language: str = "lang",
    topic: str = "notebook_id",
    vocabulary: Vocabulary = Vocabulary(),
    buckets: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document enters the mixture, documents with 0 copies left out.

    Copies are the whole part of the cell's weight, and one more with the probability of the rest, drawn from a hash of
    the id and the seed, so that a run repeats whatever the partitions. Never more than the source's max_repeat.
    """
    columns = {"doc_id": F.col(key).cast("long"), **_cell_columns(source, language, topic, buckets)}
    wanted = _targets(targets)
    sized = with_tokens(_named(documents, source, wanted), text, columns, vocabulary)
    plan = plan_mixture(sized, wanted)
    weights = documents.sparkSession.createDataFrame(plan.weights, "source string, language string, topic string, weight double")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # one row per cell: Spark sends it to all tasks if it is small, else it parts hot cells on the other side
    return (
        sized.join(weights, ["source", "language", "topic"])
        .withColumn("copies", (F.floor("weight") + (draw < F.col("weight") - F.floor("weight")).cast("int")).cast("int"))
        .filter("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )


def sampled_shares(mixed: DataFrame) -> DataFrame:
    """What a drawn mixture holds: (source, documents, tokens, share)."""
    sums = mixed.groupBy("source").agg(
        F.sum("copies").alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens")
    )
    whole = sums.agg(F.sum("tokens").alias("whole"))
    return sums.join(F.broadcast(whole)).select("source", "documents", "tokens", (F.col("tokens") / F.col("whole")).alias("share"))
