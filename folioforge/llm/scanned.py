"""Noise in text from scanned pages: page furniture, words split at line ends, misread characters, and their repair.

Furniture (``furniture``) and line joins are decided by boosted classifiers over pairs of lines; words (and Chinese characters in their
context) that the corpus does not know are looked up in an inverted index of character q-grams, and a boosted ranker
chooses among the candidates. All classifiers are trained here, on a bounded number of examples made by damaging
clean words and titles; the statistics they use cover all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.boosting import Boosted, boost
from folioforge.llm.furniture import Furniture, TitleIndex, _stops, _tidy, find_furniture, page_numbers, similarity, train_furniture  # noqa: F401
from folioforge.session import cut

#: Examples each classifier is trained on, and clean words they are made from, at most.
EXAMPLES = 6_000
TRAINING_WORDS = 4_000
#: Documents the furniture classifiers learn from, at most, chosen by a hash of their ids, and the longest that is taken;
#: their whole texts are laid out on pages. This bounds a sample for training only.
TRAINING_DOCUMENTS, TRAINING_LENGTH = 1_000, 20_000
#: Contents that are judged together, for the sake of the classifiers' speed.
TOGETHER = 128
#: Bits of the filter of known words and characters that is sent to the workers: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: A word is known if clean texts hold it this often; a character in its context likewise.
KNOWN = 3

#: What recognition takes for what, as (read, meant); both directions of each are tried.
CONFUSED = [
    ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("b", "h"), ("c", "e"), ("f", "t"), ("1", "l"), ("1", "i"),
    ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("l", "i"), ("n", "u"), ("y", "v"), ("q", "g"),
    ("h", "li"), ("m", "rn"), ("d", "cl"), ("ii", "ü"), ("u", "ü"), ("é", "e"), ("è", "e"), ("ö", "o"), ("ä", "a"), ("ü", "u"), ("a", "o"), ("t", "f"), ("ni", "m"), ("in", "m"),
]
_COST: dict[tuple[str, str], float] = {}
for _a, _b in CONFUSED:
    _COST[_a, _b] = 0.25
    _COST.setdefault((_b, _a), 0.4)

_TOKEN = re.compile(r"[^\W_㐀-鿿぀-ヿ฀-๿ऀ-ॿ]+")
_COMPOUND = re.compile(r"[^\W\d_㐀-鿿]+(?:-[^\W\d_㐀-鿿]+)+")
_HAN = re.compile(r"[㐀-鿿]")
_HYPHENS = "-­¬‐‑⁃"
_SPLIT_END = re.compile(rf"([^\W\d_㐀-鿿]+(?:-[^\W\d_㐀-鿿]+)*)([{_HYPHENS}])$")
_FIRST_WORD = re.compile(r"^[^\W\d_㐀-鿿]+(?:-[^\W\d_㐀-鿿]+)*")


# ---------------------------------------------------------------- what the corpus knows


def unit_code(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) | zlib.crc32(raw[::-1], 0x5BD1E995) << 32


def _triples(text: str) -> Counter:
    """Chinese characters in context, as strings of three; the ends of a run count as blanks."""
    counts: Counter = Counter()
    for run in re.findall(r"[㐀-鿿]+", text):
        padded = f" {run} "
        counts.update([padded[i : i + 3] for i in range(len(run))])
    return counts


def _count_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and characters in context of the clean texts and, kept apart, words inside the lines of scanned ones."""
    clean: Counter = Counter()
    scanned: Counter = Counter()

    def table() -> pa.RecordBatch:
        units = list(clean.keys() | scanned.keys())
        return pa.RecordBatch.from_pydict(
            {"unit": units, "clean": [clean[u] for u in units], "scanned": [scanned[u] for u in units]}, _UNITS
        )

    for batch in batches:
        for text, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                low = text.lower()
                clean.update(_TOKEN.findall(low))
                if "-" in low:
                    clean.update(_COMPOUND.findall(low))
                if not text.isascii():
                    clean.update(_triples(text))
            if content:
                for line in content.lower().split("\n"):
                    words = _TOKEN.findall(line)[1:-1]
                    if words:
                        scanned.update(words)
                        if "-" in line:
                            scanned.update(_COMPOUND.findall(line[1:-2]))
        if len(clean) + len(scanned) > 400_000:
            yield table()
            clean.clear()
            scanned.clear()
    if clean or scanned:
        yield table()


_UNITS = pa.schema([("unit", pa.string()), ("clean", pa.int64()), ("scanned", pa.int64())])


def unit_counts(documents: DataFrame, content: str, text: str) -> DataFrame:
    return (
        documents.select(F.col(text).cast("string").alias("t"), F.col(content).cast("string").alias("c"))
        .mapInArrow(_count_clean, "unit string, clean long, scanned long")
        .groupBy("unit")
        .agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))
    )


def _bit_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.array([unit_code(u) for u in batch.column(0).to_pylist()], np.uint64)
        places = np.concatenate([codes % np.uint64(bits), (codes >> np.uint64(17)) % np.uint64(bits), (codes >> np.uint64(34)) % np.uint64(bits)])
        word, bit = (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63))
        order = np.argsort(word, kind="stable")
        word, bit = word[order], bit[order]
        if len(word):
            begins = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            merged = np.bitwise_or.reduceat(bit, begins).view(np.int64)
            yield pa.RecordBatch.from_pydict({"word": word[begins], "bits": merged}, pa.schema([("word", pa.int64()), ("bits", pa.int64())]))


class KnownUnits:
    """A Bloom filter of fixed size; what it does not hold is certainly unknown, what it holds is settled by ``wrongly_held``."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __contains__(self, unit: str) -> bool:
        code = unit_code(unit)
        for place in (code % self.bits, (code >> 17) % self.bits, (code >> 34) % self.bits):
            if not int(self.words[place >> 6]) >> (place & 63) & 1:
                return False
        return True


def exactly_known(counts: DataFrame) -> DataFrame:
    return counts.filter((F.col("clean") >= KNOWN) | ((F.col("scanned") >= 40) & F.col("unit").rlike("-"))).select("unit")


def known_units(counts: DataFrame, bits: int = FILTER_BITS) -> KnownUnits:
    return unit_filter(exactly_known(counts), bits)


def unit_filter(wanted: DataFrame, bits: int = FILTER_BITS) -> KnownUnits:
    """Built by the executors; only the filter's words, at most bits / 64 of them, reach the driver."""
    n = wanted.count()
    size = max(1 << 16, min(bits, 1 << int(np.ceil(np.log2(max(n, 1) * 12)))))
    words = (
        wanted.mapInArrow(lambda it: _bit_words(it, size), "word long, bits long")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    held = np.zeros(size >> 6, np.uint64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return KnownUnits(held, size)


def _held_units(batches: Iterator[pa.RecordBatch], known: KnownUnits) -> Iterator[pa.RecordBatch]:
    """Words, and characters in the context of their line, that the filter holds; each once, as far as memory goes."""
    schema = pa.schema([("unit", pa.string())])
    seen: set[str] = set()
    for batch in batches:
        units: set[str] = set()
        for content in batch.column(0).to_pylist():
            text = content if content.isprintable() else "\n".join(map(_tidy, content.split("\n")))
            units.update(_TOKEN.findall(text.lower()))
            if not text.isascii():
                units.update(_triples(text))
        units -= seen
        seen |= units
        yield pa.RecordBatch.from_pydict({"unit": [u for u in units if u in known]}, schema)
        if len(seen) > 500_000:
            seen.clear()


def wrongly_held(documents: DataFrame, content: str, known: KnownUnits, counts: DataFrame) -> KnownUnits:
    """A filter of the units of the contents that ``known`` holds though the corpus does not know them, by an exact join.

    A unit of a line that ``known`` holds and this filter does not is certainly known; of one that both hold that is open.
    """
    shared = documents.sparkSession.sparkContext.broadcast(known)
    held = (
        documents.filter(F.col(content).isNotNull())
        .select(F.col(content).cast("string").alias("content"))
        .mapInArrow(lambda it: _held_units(it, shared.value), "unit string")
        .distinct()
    )
    return unit_filter(cut(held.join(exactly_known(counts), "unit", "left_anti")))


# ---------------------------------------------------------------- candidates and ranking


def confusion_distance(read: str, meant: str, limit: float = 2.0) -> float:
    """Edit distance in which what recognition usually confuses costs little."""
    n, m = len(read), len(meant)
    if abs(n - m) > 2:
        return limit
    inf = limit + 1
    table = [[inf] * (m + 1) for _ in range(n + 1)]
    table[0][0] = 0.0
    for i in range(n + 1):
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            now = table[i][j]
            if now > limit:
                continue
            if i < n and j < m and read[i] == meant[j]:
                table[i + 1][j + 1] = min(table[i + 1][j + 1], now)
            for a in (0, 1, 2, 3):
                if i + a > n:
                    break
                for b in (0, 1, 2, 3):
                    if j + b > m or a + b == 0:
                        continue
                    if a <= 1 and b <= 1:
                        cost = _COST.get((read[i : i + a], meant[j : j + b]), 1.0)
                    else:
                        cost = _COST.get((read[i : i + a], meant[j : j + b]), inf)
                    if now + cost < table[i + a][j + b]:
                        table[i + a][j + b] = now + cost
    return min(limit, table[n][m])


def word_features(read: str, meant: str, read_count: float, meant_count: float, shared: float) -> list[float]:
    return [
        confusion_distance(read, meant),
        float(len(read) - len(meant)),
        float(min(len(read), 12)),
        shared / max(1, len(meant)),
        np.log1p(meant_count),
        np.log1p(meant_count) - np.log1p(read_count),
        float(any(c.isdigit() for c in read) and not any(c.isdigit() for c in meant)),
        float(read[:1] == meant[:1]) + float(read[-1:] == meant[-1:]),
    ]


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 2] for i in range(len(padded) - 1)]


def train_words(words: list[tuple[str, int]], seed: int = 5) -> Boosted:
    """From clean words damaged by usual confusions, against other forms of words, pieces of words and unlike words.

    Some of the damaged words are rare ones; some words are read about as often as the candidate, hence no slips of it.
    """
    rng, counts = np.random.default_rng(seed), np.random.default_rng(seed + 1)
    words = [(w, n) for w, n in words if len(w) > 2 and not any(c.isdigit() for c in w)] or [("example", 50), ("sample", 40), ("samples", 30)]
    texts = [w for w, _ in words]
    x, y = [], []
    for i in range(EXAMPLES // 2):
        w, n = words[rng.integers(len(words))]
        bad = _damaged_word(w, rng)
        if bad != w:
            seen = float(rng.integers(1, max(2, n // 50 + 2)))
            if i % 4 == 0:
                seen, n = 1.0, int(counts.integers(KNOWN, 12))
            x.append(word_features(bad, w, seen, n, len(set(grams(bad)) & set(grams(w)))))
            y.append(1)
        kind = i % 3
        other, m = words[rng.integers(len(words))]
        if kind == 0:
            bad = w[: int(rng.integers(2, len(w)))] if rng.random() < 0.5 else w[int(rng.integers(1, len(w) - 1)) :]
            other, m = (w, n) if rng.random() < 0.5 else (other, m)
        elif kind == 1:
            bad = w + ["s", "n", "e", "en", "er", "es", "ed", "ly"][rng.integers(8)]
            other, m = w, n
        else:
            near = sorted(texts[:400], key=lambda t: -len(set(grams(t)) & set(grams(w))))[1:2] if i % 30 == 2 else [other]
            bad, other = w, near[0]
        read = float(rng.integers(1, 30))
        if i % 4 == 1:
            bad, other, m = _damaged_word(w, counts) if counts.random() < 0.5 else _other_letter(w, counts), w, n
            read = float(max(6, n * np.exp(counts.uniform(-1.6, 1.6))))
        if bad != other:
            x.append(word_features(bad, other, read, m, len(set(grams(bad)) & set(grams(other)))))
            y.append(0)
    return boost(np.array(x), np.array(y))


def _other_letter(word: str, rng: np.random.Generator) -> str:
    at = int(rng.integers(len(word)))
    return word[:at] + "aeinorst"[rng.integers(8)] + word[at + 1 :]


def _damaged_word(word: str, rng: np.random.Generator) -> str:
    options = [(a, b) for a, b in CONFUSED if b in word]
    if options and rng.random() < 0.9:
        read, meant = options[rng.integers(len(options))]
        places = [m.start() for m in re.finditer(re.escape(meant), word)]
        at = places[rng.integers(len(places))]
        return word[:at] + read + word[at + len(meant) :]
    at = int(rng.integers(len(word)))
    return word[:at] + "1l0oi5c"[rng.integers(7)] + word[at + 1 :]


def join_features(joined: float, hyphened: float, left: float, right: float, a: str, b: str, mark: str) -> list[float]:
    return [
        np.log1p(joined), np.log1p(hyphened), np.log1p(joined) - np.log1p(hyphened), np.log1p(left), np.log1p(right),
        float(len(a)), float(len(b)), float(mark != "-"), float("-" in a or "-" in b),
    ]


def train_joins(words: list[tuple[str, int]], compounds: list[tuple[str, int]], seed: int = 9) -> Boosted:
    """From words cut anywhere against compounds cut at their own hyphen."""
    rng = np.random.default_rng(seed)
    count = dict(words)
    words = [(w, n) for w, n in words if len(w) > 4 and "-" not in w] or [("example", 50), ("sentence", 40)]
    compounds = compounds or [("read-only", 40), ("step-by-step", 30), ("follow-up", 20)]
    x, y = [], []
    for _ in range(EXAMPLES // 2):
        w, n = words[rng.integers(len(words))]
        at = int(rng.integers(2, len(w) - 1))
        a, b = w[:at], w[at:]
        rare = n if rng.random() < 0.85 else 0
        x.append(join_features(rare, 0, count.get(a, 0), count.get(b, 0), a, b, "-­¬"[rng.integers(3)]))
        y.append(1)
        w, n = compounds[rng.integers(len(compounds))]
        cuts = [i for i, c in enumerate(w) if c == "-"]
        at = cuts[rng.integers(len(cuts))]
        a, b = w[:at], w[at + 1 :]
        known = n if rng.random() < 0.85 else 0
        x.append(join_features(0, known, count.get(a, n if "-" not in a else 0), count.get(b, n if "-" not in b else 0), a, b, "-"))
        y.append(0)
    return boost(np.array(x), np.array(y))


# ---------------------------------------------------------------- reading the pages


@dataclass
class Body:
    """The body lines of a document: their numbers (from 1), their text, and whether each begins a paragraph."""

    numbers: list[int]
    lines: list[str]
    starts: list[bool]


def body_lines(raw: list[str], kinds: dict[int, str]) -> Body:
    body = Body([], [], [])
    blank = True
    for i, line in enumerate(raw):
        if i in kinds:
            continue
        bare = _tidy(line)
        if not bare:
            blank = True
            continue
        body.numbers.append(i + 1)
        body.lines.append(bare)
        body.starts.append((blank and (len(body.lines) < 2 or _stops(body.lines[-2]))) or line[:1] in "　")
        blank = False
    return body


def _inspect(
    raw: list[str], kinds: dict[int, str], known: KnownUnits, open_: KnownUnits, cache: dict[str, bool]
) -> list[tuple[int, str, str, str, str, int]]:
    """(line, kind, a, b, c, at): header and page_number as found; word (b: code of its line), han and split as questions to the corpus.

    ``at`` is the place of a character in its line, without outer blanks.

    Words and characters that the corpus may know after all are among the questions; ``unknown_words`` and
    ``unknown_characters`` take them out.
    """
    out = [(i + 1, kind, "", "", "", -1) for i, kind in kinds.items()]
    body = body_lines(raw, kinds)

    def is_known(unit: str) -> bool:
        hit = cache.get(unit)
        if hit is None:
            if len(cache) > 500_000:
                cache.clear()
            hit = cache[unit] = unit in known and unit not in open_
        return hit

    cached = cache.get
    after_split = False
    text, owner, column = [], [], []
    for j, line in enumerate(body.lines):
        number, code = body.numbers[j], ""
        end = _SPLIT_END.search(line) if line[-1] in _HYPHENS and j + 1 < len(body.lines) else None
        first = _FIRST_WORD.match(body.lines[j + 1]) if end else None
        split = bool(end and first and first.group(0)[:1].islower())
        if split:
            out.append((number, "split", end.group(1).lower(), first.group(0).lower(), end.group(2), -1))
        low = line.lower()
        tokens = _TOKEN.findall(low)
        for word in tokens[int(after_split) : len(tokens) - int(split)]:
            hit = cached(word)
            if hit or hit is None and (len(word) < 3 or is_known(word)):
                continue
            if len(word) >= 3 and any(map(str.isalpha, word)):
                code = code or f"{unit_code(line):x}"
                out.append((number, "word", word, code, "", -1))
        after_split = split
        if not line.isascii():
            if body.starts[j]:
                text.append("\n")
                owner.append(number)
                column.append(-1)
            text.append(line)
            owner.extend([number] * len(line))
            column.extend(range(len(line)))
    joined = "".join(text)
    if _HAN.search(joined):
        for m in re.finditer(r"[㐀-鿿]+", joined):
            begin, run = m.start(), f"  {m.group(0)}  "
            n = m.end() - begin
            miss = [not (is_known(u) if (hit := cached(u)) is None else hit) for u in (run[p + 1 : p + 4] for p in range(n))]
            for p in range(n - 1):
                if owner[begin + p] != owner[begin + p + 1]:
                    # what spans two lines was not settled beforehand
                    miss[p] = miss[p + 1] = True
            # a character is in doubt if no triple that holds it is known
            for p in range(n):
                if miss[p] and (p == 0 or miss[p - 1]) and (p == n - 1 or miss[p + 1]):
                    out.append((owner[begin + p], "han", run[p : p + 2], run[p + 2], run[p + 3 : p + 5], column[begin + p]))
    return out


def unknown_words(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, ...): without the words that the corpus knows."""
    known = exactly_known(counts).withColumnRenamed("unit", "a")
    return words.join(words.select("a").distinct().join(known, "a", "left_anti"), "a")


def unknown_characters(han: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, c, ...): without the characters of which the corpus knows a string of three that holds them."""
    asked = han.select("a", "b", "c").distinct()
    known = exactly_known(counts)
    for unit in (F.concat("a", "b"), F.concat(F.substring("a", 2, 1), "b", F.substring("c", 1, 1)), F.concat("b", "c")):
        asked = asked.withColumn("unit", unit).join(known, "unit", "left_anti").drop("unit")
    return han.join(asked, ["a", "b", "c"])


_FOUND = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("at", pa.int32())])
_FOUND_DDL = "doc_id long, line_no int, kind string, a string, b string, c string, at int"


def _best_words(batches: Iterator[pa.RecordBatch], ranker: Boosted) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.string()), ("meant", pa.string()), ("p", pa.float64())])
    for batch in batches:
        d = batch.to_pydict()
        x = [
            word_features(read, meant, seen, clean, len(set(grams(read)) & set(grams(meant))))
            for read, meant, seen, clean in zip(d["a"], d["meant"], d["seen"], d["clean"])
        ]
        p = ranker.probability(np.array(x)) if x else []
        yield pa.RecordBatch.from_pydict({"a": d["a"], "meant": d["meant"], "p": p}, schema)


#: q of the index's grams, and how many of a word's rarest grams are looked up: one more than a misread character damages.
Q, LOOKUPS = 3, 6


def _placed_grams(c: Column) -> Column:
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) + 3 - Q, F.lit(1))), lambda i: F.substring(padded, i, Q)))


def corrected_words(questions: DataFrame, counts: DataFrame, ranker: Boosted) -> DataFrame:
    """(a, meant, p): for each unknown word its best candidate by the ranker, retrieved through an inverted index.

    A misread character (read as one, two or three) damages at most five of a word's trigrams, so one of any six is
    intact: only the six rarest of a word are looked up, which keeps to the short lists of the index. Grams must stand
    at about the same place and lengths must be close. How often a word was seen counts distinct lines (b: the code of
    a line), so copies of a content add nothing; what that says against a candidate is left to the ranker.
    """
    asked = questions.select("a", "b").distinct().groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("seen"))
    words = counts.filter((F.col("clean") >= KNOWN) & F.col("unit").rlike(r"^[^ \-]{3,}$") & ~F.col("unit").rlike("[0-9\\u3400-\\u9fff]"))
    index = words.select(F.col("unit").alias("meant"), F.col("clean").cast("double").alias("clean"), _placed_grams(F.col("unit")).alias("place", "gram"))
    lists = index.groupBy("gram").agg(F.count(F.lit(1)).alias("entries"))
    rarest = Window.partitionBy("a").orderBy("entries", "place")
    lookups = (
        asked.select("a", "seen", _placed_grams(F.col("a")).alias("place", "gram"))
        .join(lists, "gram", "left")
        .withColumn("entries", F.coalesce("entries", F.lit(0)))
        .withColumn("r", F.row_number().over(rarest))
        .filter((F.col("r") <= LOOKUPS) & (F.col("entries") > 0))
        .select("a", "seen", "gram", F.explode(F.array(*[F.col("place") + d for d in (-2, -1, 0, 1, 2)])).alias("place"))
    )
    pairs = (
        lookups.join(index, ["gram", "place"])
        .filter(F.abs(F.length("a") - F.length("meant")) <= 2)
        .select("a", "meant", "seen", "clean")
        .distinct()
    )
    scored = pairs.mapInArrow(lambda it: _best_words(it, ranker), "a string, meant string, p double")
    best = Window.partitionBy("a").orderBy(F.desc("p"), "meant")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def sign_features(ways: float, weight: float, contexts: float, read_count: float, meant_count: float) -> list[float]:
    """In how many of three ways the candidate fits, how well known they are, how many contexts ask for the same, how common both are."""
    return [ways, weight, np.log1p(contexts), np.log1p(read_count), np.log1p(meant_count)]


def train_signs(triples: list[tuple[str, int]], seed: int = 11) -> Boosted:
    """From known contexts whose middle was replaced (the right candidate against the others), and from contexts put together at random."""
    rng = np.random.default_rng(seed)
    triples = [(t, n) for t, n in triples if len(t) == 3] or [("文档标", 50), ("档标签", 50), ("标签更", 20), ("签更新", 20), ("会议记", 30), ("议记录", 30)]
    known = dict(triples)
    single: Counter = Counter()
    ending: dict[str, list[str]] = {}
    starting: dict[str, list[str]] = {}
    for t, n in triples:
        single[t[1]] += n
        ending.setdefault(t[1:], []).append(t)
        starting.setdefault(t[:2], []).append(t)
    signs = list(single)
    x, y = [], []

    def add(before: str, after: str, right: str | None, read: str) -> None:
        for sign in {right or signs[0], *(signs[k] for k in rng.integers(0, len(signs), 12))}:
            fits = [known.get(before + sign, 0), known.get(before[1] + sign + after[0], 0), known.get(sign + after, 0)]
            ways = sum(n > 0 for n in fits)
            if ways >= 2:
                often = 1 + int(rng.geometric(0.1)) if sign == right else 1
                x.append(sign_features(ways, float(np.log1p(fits).sum()), often, single[read] * (rng.random() < 0.3), single[sign]))
                y.append(int(sign == right))

    for _ in range(EXAMPLES // 2):
        t = triples[rng.integers(len(triples))][0]
        left, right = ending.get(t[:2], [" " + t[:2]]), starting.get(t[1:], [t[1:] + " "])
        before = left[rng.integers(len(left))][:2]
        add(before, t[2] + right[rng.integers(len(right))][2], t[1], signs[rng.integers(len(signs))])
        a, b = triples[rng.integers(len(triples))][0], triples[rng.integers(len(triples))][0]
        add(a[1:], b[:2], None, signs[rng.integers(len(signs))])
    if not x or len(set(y)) < 2:
        x += [sign_features(3, 9, 5, 0, 50), sign_features(2, 3, 1, 50, 50)]
        y += [1, 0]
    return boost(np.array(x), np.array(y))


def corrected_characters(questions: DataFrame, counts: DataFrame, ranker: Boosted) -> DataFrame:
    """(a, b, c, meant): characters in doubt for which another one is known in the same place, the best by the ranker.

    The index goes from the characters around a gap to those that fill it: both neighbours, or the two before, or the
    two after; a candidate must be found in at least two of these ways.
    """
    triples = counts.filter((F.col("clean") >= KNOWN) & (F.length("unit") == 3) & F.substring("unit", 2, 1).rlike(r"[㐀-鿿]"))
    place = lambda i: F.substring("unit", i, 1)
    index = triples.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("way"), F.concat(place(1), F.lit("?"), place(3)).alias("key"), place(2).alias("meant")),
                F.struct(F.lit(1).alias("way"), F.concat(place(1), place(2), F.lit("?")).alias("key"), place(3).alias("meant")),
                F.struct(F.lit(2).alias("way"), F.concat(F.lit("?"), place(2), place(3)).alias("key"), place(1).alias("meant")),
            )
        ).alias("e"),
        "clean",
    ).select("e.*", "clean")
    asked = questions.select("a", "b", "c").distinct()
    keys = asked.select(
        "a", "b", "c",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("way"), F.concat(F.substring("a", 2, 1), F.lit("?"), F.substring("c", 1, 1)).alias("key")),
                F.struct(F.lit(1).alias("way"), F.concat(F.col("a"), F.lit("?")).alias("key")),
                F.struct(F.lit(2).alias("way"), F.concat(F.lit("?"), F.col("c")).alias("key")),
            )
        ).alias("e"),
    ).select("a", "b", "c", "e.*")
    found = (
        keys.join(index, ["way", "key"])
        .filter(F.col("meant") != F.col("b"))
        .groupBy("a", "b", "c", "meant")
        .agg(F.countDistinct("way").cast("double").alias("ways"), F.sum(F.log1p("clean")).alias("weight"))
        .filter(F.col("ways") >= 2)
    )
    usual = found.groupBy("b", "meant").agg(F.count(F.lit(1)).cast("double").alias("contexts"))
    single = triples.groupBy(place(2).alias("sign")).agg(F.sum("clean").cast("double").alias("n"))
    scored = (
        found.join(usual, ["b", "meant"])
        .join(single.withColumnsRenamed({"sign": "b", "n": "read_count"}), "b", "left")
        .join(single.withColumnsRenamed({"sign": "meant", "n": "meant_count"}), "meant", "left")
        .fillna(0.0, ["read_count", "meant_count"])
        .select("a", "b", "c", "meant", "ways", "weight", "contexts", "read_count", "meant_count")
        .mapInArrow(lambda it: _best_signs(it, ranker), "a string, b string, c string, meant string, p double")
    )
    order = Window.partitionBy("a", "b", "c").orderBy(F.desc("p"), "meant")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1 and p > 0.5").select("a", "b", "c", "meant")


def _best_signs(batches: Iterator[pa.RecordBatch], ranker: Boosted) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "c", "meant"]
    schema = pa.schema([(n, pa.string()) for n in names] + [("p", pa.float64())])
    for batch in batches:
        d = batch.to_pydict()
        x = [sign_features(*row) for row in zip(d["ways"], d["weight"], d["contexts"], d["read_count"], d["meant_count"])]
        yield pa.RecordBatch.from_pydict({n: d[n] for n in names} | {"p": ranker.probability(np.array(x)) if x else []}, schema)


def _judge_splits(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32())])
    for batch in batches:
        d = batch.to_pydict()
        if not d["doc_id"]:
            yield pa.RecordBatch.from_pydict({"doc_id": [], "line_no": []}, schema)
            continue
        x = np.array([join_features(*row) for row in zip(d["joined"], d["hyphened"], d["left"], d["right"], d["a"], d["b"], d["c"])])
        keep = model.probability(x) > 0.5
        yield pa.RecordBatch.from_pydict(
            {"doc_id": np.array(d["doc_id"])[keep].tolist(), "line_no": np.array(d["line_no"])[keep].tolist()}, schema
        )


@dataclass
class Reader:
    """What has been learned of a corpus: unit counts, the filter of known units and the four classifiers."""

    counts: DataFrame
    known: KnownUnits
    furniture: Furniture
    ranker: Boosted
    signs: Boosted
    joins: Boosted


def training_pages(documents: DataFrame, key: str, text: str, title: str) -> list[tuple[str | None, str]]:
    """(title, text) of at most TRAINING_DOCUMENTS documents, the same whatever the partitions."""
    n = documents.count()
    rank = F.pmod(F.xxhash64(F.lit(13), F.col(key)), F.lit(1 << 30))
    whole = F.col(text).cast("string")
    some = documents.filter((F.length(whole) > 0) & (F.length(whole) <= TRAINING_LENGTH))
    if n > 4 * TRAINING_DOCUMENTS:
        some = some.filter(rank < int(4 * TRAINING_DOCUMENTS / n * (1 << 30)))
    rows = some.select(rank.alias("r"), F.col(title).cast("string").alias("title"), whole.alias("text")).orderBy("r", "title", "text").limit(TRAINING_DOCUMENTS)
    return list(dict.fromkeys((r["title"], r["text"]) for r in rows.collect()))


def learn_reader(documents: DataFrame, content: str = "content", text: str = "text", title: str = "title", key: str = "doc_id") -> Reader:
    """Counts over all documents; the classifiers are trained on at most EXAMPLES examples made from bounded samples."""
    counts = cut(unit_counts(documents, content, text))
    words = counts.filter((F.col("clean") >= KNOWN) & F.col("unit").rlike(r"^\p{L}{2,}$") & ~F.col("unit").rlike("[\\u3400-\\u9fff]"))
    top = words.orderBy(F.desc("clean"), "unit").limit(TRAINING_WORDS).collect()
    compounds = (
        counts.withColumn("n", F.col("clean") + F.col("scanned")).filter(F.col("unit").rlike("-") & (F.col("n") >= 5))
        .orderBy(F.desc("n"), "unit").limit(TRAINING_WORDS).collect()
    )
    inside = (F.length("unit") == 3) & F.col("unit").rlike(r"^.[㐀-鿿].$")
    contexts = counts.filter((F.col("clean") >= KNOWN) & inside).orderBy(F.desc("clean"), "unit").limit(TRAINING_WORDS).collect()
    sample = training_pages(documents, key, text, title)
    pairs = [(r["unit"], r["clean"]) for r in top]
    return Reader(
        counts,
        known_units(counts),
        train_furniture([t for t, _ in sample if t], [x for _, x in sample]),
        train_words(pairs),
        train_signs([(r["unit"], r["clean"]) for r in contexts]),
        train_joins(pairs, [(r["unit"], r["n"]) for r in compounds]),
    )


def page_noise(
    documents: DataFrame, key: str = "doc_id", content: str = "content", text: str = "text", title: str = "title", reader: Reader | None = None
) -> DataFrame:
    """(doc_id, line_no, defect, a, b, at): every disturbed line, with the word or character read and the one meant.

    defect is ``header``, ``page_number``, ``split_word`` (a, b: the two parts) or ``misread`` (a: as read, b: as
    meant; at: the place of a Chinese character in its line without outer blanks, else -1). Lines end at newline only and count from 1. Null and empty contents give no rows; pages without noise give
    none; ids that repeat are treated row by row. Whole contents are read.
    """
    reader = reader or learn_reader(documents, content, text, title, key)
    open_units = wrongly_held(documents, content, reader.known, reader.counts)
    shared = documents.sparkSession.sparkContext.broadcast((reader.known, open_units, reader.furniture))

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_, model = shared.value
        cache: dict[str, bool] = {}
        for batch in batches:
            pages = [(k, t.split("\n")) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t]
            rows = []
            for at in range(0, len(pages), TOGETHER):
                some = pages[at : at + TOGETHER]
                for (k, raw), (kinds, _) in zip(some, model.of([raw for _, raw in some])):
                    rows += [(k, *found) for found in _inspect(raw, kinds, known, open_, cache)]
            columns = list(zip(*rows)) if rows else [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    found = cut(
        documents.filter(F.col(content).isNotNull())
        .select(F.col(key).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"))
        .mapInArrow(inspect, _FOUND_DDL)
    )
    counts = reader.counts
    furniture = found.filter(F.col("kind").isin("header", "page_number")).select(
        "doc_id", "line_no", F.col("kind").alias("defect"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "at"
    )

    words = unknown_words(found.filter("kind = 'word'"), counts)
    fixed = corrected_words(words, counts, reader.ranker).filter("p > 0.5")
    misread = words.select("doc_id", "line_no", "a", "at").join(fixed, "a").select("doc_id", "line_no", F.lit("misread").alias("defect"), "a", F.col("meant").alias("b"), "at")

    han = unknown_characters(found.filter("kind = 'han'"), counts)
    signs = corrected_characters(han, counts, reader.signs)
    misread_signs = han.join(signs, ["a", "b", "c"]).select("doc_id", "line_no", F.lit("misread").alias("defect"), F.col("b").alias("a"), F.col("meant").alias("b"), "at")

    splits = found.filter("kind = 'split'")
    total = (F.col("clean") + F.col("scanned")).cast("double")
    def seen(name: str, unit):  # noqa: E306
        own = counts.select(F.col("unit").alias(name + "_unit"), total.alias(name))
        return own, unit

    asked = splits.select("a", "b", "c").distinct()
    for name, unit in (
        ("joined", F.concat("a", "b")), ("hyphened", F.concat("a", F.lit("-"), "b")), ("left", F.col("a")), ("right", F.col("b")),
    ):
        own, at = seen(name, unit)
        asked = asked.withColumn(name + "_unit", at).join(own, name + "_unit", "left").drop(name + "_unit").fillna(0.0, [name])
    questions = splits.select("doc_id", "line_no", "a", "b", "c").join(asked, ["a", "b", "c"])
    model = reader.joins
    judged = questions.mapInArrow(lambda it: _judge_splits(it, model), "doc_id long, line_no int").withColumn("defect", F.lit("split_word"))
    judged = judged.join(splits.select("doc_id", "line_no", "a", "b"), ["doc_id", "line_no"]).select("doc_id", "line_no", "defect", "a", "b", F.lit(-1).alias("at"))
    return furniture.unionByName(misread).unionByName(misread_signs).unionByName(judged).distinct()


def _repair(content: str, noise: list[dict]) -> str:
    """The paragraphs of one document as continuous text."""
    raw = content.split("\n")
    furniture = {x["line_no"] - 1: x["defect"] for x in noise if x["defect"] in ("header", "page_number")}
    misread: dict[int, list[tuple[int, str, str]]] = {}
    split: dict[int, str] = {}
    for x in noise:
        if x["defect"] == "misread":
            misread.setdefault(x["line_no"], []).append((x["at"], x["a"], x["b"]))
        elif x["defect"] == "split_word":
            split[x["line_no"]] = x["a"]
    body = body_lines(raw, furniture)
    out: list[str] = []
    glue = ""
    for number, line, starts in zip(body.numbers, body.lines, body.starts):
        # characters at their places first, which keeps the length of the line; then words
        for at, read, meant in sorted(misread.get(number, []), reverse=True):
            if at >= 0:
                line = line[:at] + meant + line[at + 1 :]
            else:
                line = re.sub(rf"(?<![^\W_]){re.escape(read)}(?![^\W_])", lambda m, to=meant: _same_case(m.group(0), to), line, flags=re.I)
        if out and not starts:
            out[-1] += glue + line
        else:
            out.append(line)
        if number in split:
            out[-1] = out[-1][:-1]
            glue = ""
        elif out[-1][-1:] in _HYPHENS and re.search(r"\w[" + _HYPHENS + "]$", out[-1]):
            glue = ""
        else:
            glue = "" if _HAN.match(out[-1][-1:]) or out[-1][-1:] in "，。、；：？！）”" else " "
    return "\n\n".join(out)


def _same_case(read: str, meant: str) -> str:
    if read.isupper() and len(read) > 1:
        return meant.upper()
    return meant.capitalize() if read[:1].isupper() else meant


def repaired_pages(
    documents: DataFrame, key: str = "doc_id", content: str = "content", text: str = "text", title: str = "title", reader: Reader | None = None
) -> DataFrame:
    """(doc_id, repaired): contents as paragraphs, without furniture, split words joined, misread characters replaced.

    Contents without noise only have their lines joined. Null contents give no row. Documents must have distinct ids.
    """
    noise = page_noise(documents, key, content, text, title, reader)
    per_document = noise.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "defect", "a", "b", "at")).alias("noise"))
    pages = documents.filter(F.col(content).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            yield pa.RecordBatch.from_pydict(
                {"doc_id": d["doc_id"], "repaired": [_repair(c, n or []) for c, n in zip(d["content"], d["noise"])]},
                pa.schema([("doc_id", pa.int64()), ("repaired", pa.string())]),
            )

    return pages.join(per_document, "doc_id", "left").select("doc_id", "content", "noise").mapInArrow(repair, "doc_id long, repaired string")
