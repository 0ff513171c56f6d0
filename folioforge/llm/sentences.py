"""Sentence boundaries across languages and scripts.

Each run of text between hard breaks is cut by a semi-Markov dynamic program: candidate ends come from punctuation,
line ends and (Thai) spaces, and the program chooses the whole spans whose joint score is best. A span is scored by
its length, by the word that opens it, by the word that closes it, and by whether its quotation marks and brackets
balance. Which words open and which never close a sentence is learned from the line starts and line ends of the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.languages import is_function_word
from folioforge.session import cut

#: Abbreviations that a name, number or further word must follow.
NEVER_LAST = frozenset(
    "dr prof mr mrs ms st mme mlle sr sra srta dra hr fr vs cf fig figs sec ch vol no nos nr abb tab vgl bzw ca approx env aprox "
    "pág págs núm art ed eds al ver véase e.g i.e z.b d.h u.a p.ex p.ej resp gen sen rep jan feb apr aug sept oct nov dec "
    "डॉ श्री".split()
)
#: How often a token must occur before its statistics count, and the share of uses that makes a closing or opening word.
LEAST, CLOSES, OPENS = 25, 0.03, 0.03
#: How many tokens of each kind the model keeps, the most frequent first; bounds what is sent to the workers.
MODEL_SIZE = 20_000

_MARK = re.compile(r"[^\S\n]*(?:\d{1,3}[.)、]|[-*•·‣–]|#{1,6}|\d{1,2}(?:\.\d{1,3})+\.?|[（(]\d{1,3}[)）])[^\S\n]+\S")
_STOPS = ".!?…。！？।．｡‼⁉؟॥"
_WIDE = "。！？｡．‼⁉।॥"
_QUOTE = re.compile("[“”„«»「」『』\"（）()\\[\\]【】]")
_OPENING, _CLOSING = "“„«「『（([【", "”»」』）)]】"
_CAND = re.compile(rf"[{_STOPS}]+(?:[   ]?»|[”’」』）)\]】\"“*_])*|\n+|(?<=[^\s])[  　\t]+(?=[฀-๿])")
_ASIAN = re.compile(r"[ऀ-෿฀-໿　-ヿ㐀-鿿가-힯＀-￯]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_WITH_STOPS = re.compile(r"[぀-ヿ㐀-鿿，、；：]")
_TOKEN_BEFORE = re.compile(r"[^\s“”„«»「」\"（）()\[\]【】/]+$")
_WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
_THAI = re.compile(r"[฀-๿]{1,5}")
_CLOSED = re.compile(rf"[{_STOPS}:：](?:[   ]?»|[”’“」』）)\]】\"*_])*$")


@dataclass
class Model:
    """abbreviations never end a sentence; starters and (in lower case) openers begin one; inner words never do."""

    abbreviations: frozenset[str] = NEVER_LAST
    openers: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    inner: frozenset[str] = frozenset()


def _opening_word(text: str, at: int) -> str:
    thai = _THAI.match(text, at)
    if thai:
        return thai.group(0)[:4]
    word = _WORD.match(text, at)
    return word.group(0) if word else ""


class Marks:
    """Where the quotation marks and brackets of a block stand, so that no candidate has to look back over all of it."""

    def __init__(self, text: str, begin: int, end: int):
        self.at: dict[str, list[int]] = {}
        for m in _QUOTE.finditer(text, begin, end):
            self.at.setdefault(m.group(0), []).append(m.start())

    def before(self, mark: str, end: int) -> int:
        """How many there are before ``end``."""
        return bisect_left(self.at.get(mark, ()), end)

    def last(self, mark: str, end: int) -> int:
        n = self.before(mark, end)
        return self.at[mark][n - 1] if n else -1


def _boundary(text: str, begin: int, cand: re.Match, end: int, model: Model, one_case: bool, marks: Marks) -> tuple[float, int, int] | None:
    """(score, end of the left span, begin of the right one) of a candidate; None if it is none."""
    mark = cand.group(0)
    left = cand.end()
    first = mark[0]
    if first == "\n":
        return _line_end(text, begin, cand, end, model, one_case)
    if first in "  　\t":
        return _thai_space(text, cand, model)
    # which of the closing marks belong here: “ and \" close only what they opened
    while left > cand.start() + 1 and text[left - 1] in "“\"":
        if text[left - 1] == "“" and marks.before("„", cand.start()):
            break
        if text[left - 1] == '"' and marks.before('"', left) % 2 == 0:
            break
        left -= 1
    right = left
    while right < end and text[right].isspace():
        right += 1
    if right >= end:
        return None
    spaced, after, last = right > left, text[right], text[left - 1]
    stop = mark.rstrip("”’」』）)]】\"“*_   »")
    dots = stop.strip("….") == "" and len(stop) > 1 or stop == "…"
    wide = any(c in _WIDE for c in stop) or (dots and bool(_CJK.match(text, right)))
    score = 1.5 if stop == "." else 2.0
    low = ""
    if after in ",;:，；：、)）]】»”」』%":
        return None
    if last in "”」』“\"»" and left - cand.start() > len(stop):
        opening = {"”": "“", "」": "「", "』": "『", "“": "„", '"': '"', "»": "«"}[last]
        at = marks.last(opening, left - 1)
        before = text[max(begin, at - 8) : at].rstrip() if at >= 0 else ""
        if _ASIAN.match(text, right) or wide:
            # said after the quotation: what it is part of goes on, unless a colon introduced it
            if not before.endswith(("：", ":")) and after not in _OPENING and "\n" not in text[left:right]:
                return (-3.0, left, right)
            score += 1
    elif last in "）)】]" and (_ASIAN.match(text, right) or wide):
        at = max(marks.last("（", left), marks.last("(", left))
        before = text[max(begin, at - 8) : at].rstrip() if at >= 0 else ""
        if before and before[-1] not in _STOPS + _CLOSING:
            return (-3.0, left, right)
    elif last in "”’」』）)]】\"»" and not spaced and not wide:
        return None
    if not spaced and not wide and not after.isupper() and after not in "“„«「（(\"¿¡":
        if stop == "." or not _CJK.match(text, right):
            return None
    if stop == ".":
        token = _TOKEN_BEFORE.search(text, max(begin, cand.start() - 40), cand.start())
        word = token.group(0) if token else ""
        low = word.lower().lstrip("¿¡'’-")
        if low in model.abbreviations or (len(low) == 1 and low.isalpha() and not _CJK.match(low)):
            score -= 6
        if not spaced:
            # a lost space: letters before, a word that opens sentences after
            if not (len(low) > 1 and low.isalpha() and after.isupper() and (len(low) > 2 or _opening_word(text, right) in model.starters)):
                return None if not _CJK.match(text, cand.start() - 1) else (score, left, right)
    opener = _opening_word(text, right if after not in "“„«「『（([\"¿¡'" else right + 1)
    if one_case:
        inner = opener.capitalize() in model.inner or (dots and opener.lower() in model.inner)
    else:
        inner = opener in model.inner
    if after.islower() and not one_case:
        if opener in model.openers:
            score += 1.5
        elif not dots and opener.capitalize() in model.starters and (stop != "." or len(low) > 3 and low not in model.abbreviations):
            # a passage put in lower case: an ordinary word, a stop, and a word that opens sentences elsewhere
            score += 0.5
        else:
            score -= 4
    elif inner and (stop == "." or dots):
        score -= 4
    else:
        score += 1
    return (score, left, right)


def _line_end(text: str, begin: int, cand: re.Match, end: int, model: Model, one_case: bool) -> tuple[float, int, int] | None:
    """A line that ends without a stop: a heading above its text, or a wrapped line."""
    left, right = cand.start(), cand.end()
    while left > begin and text[left - 1].isspace():
        left -= 1
    while right < end and text[right].isspace():
        right += 1
    if right >= end or left <= begin or _CLOSED.search(text, max(begin, left - 8), left):
        return None
    if _ASIAN.match(text[left - 1]) and _ASIAN.match(text[right]):
        return (-4.0, left, right)  # kept in one block only where the line is wrapped
    start = text.rfind("\n", begin, left) + 1 or begin
    line = text[start:left].strip()
    above = text[max(begin, start - 12) : start].rstrip()
    if above and not _CLOSED.search(above, max(0, len(above) - 8)):
        return (-4.0, left, right)
    opener = _opening_word(text, right if text[right] not in "“„«「『（([\"¿¡'" else right + 1)
    if not one_case and (line[:1].islower() or text[right].islower() and opener not in model.openers):
        return (-4.0, left, right)
    closing = line.rsplit(None, 1)[-1].lower()
    if len(line) > 52 or line[-1:] in ",;–-" or is_function_word(closing) or (opener in model.inner and not one_case):
        return (-4.0, left, right)
    return (2.0, left, right)


def _thai_space(text: str, cand: re.Match, model: Model) -> tuple[float, int, int]:
    """Thai writes a space between sentences, but also around numbers and foreign words."""
    opener = _opening_word(text, cand.end())
    score = -4.0 if opener in model.inner else 1.5
    return (score if not text[cand.start() - 1].isdigit() else score - 3, cand.start(), cand.end())


#: Shorter spans are unlikely; each character over the usual length costs a little.
SHORT, USUAL, LONGER = 4, 400, 0.001


def _length(n: int) -> float:
    if n < SHORT:
        return -1.5
    return 0.0 if n < USUAL else -LONGER * (n - USUAL)


#: From so many candidates on, spans are not tried one by one.
FEW = 13


def _every_span(found: list[tuple[float, int, int]], begin: int, depths: list[int] | None) -> list[int]:
    """For each end, from 1, before which end its span begins in the best division: all spans are tried."""
    best, back = [0.0], [0]
    for j, (score, left, _) in enumerate(found, 1):
        top, arg = -1e9, 0
        for i in range(j - 1, -1, -1):
            span_at = found[i - 1][2] if i else begin
            value = best[i] + _length(left - span_at)
            if depths and depths[j] != depths[i]:
                value -= 4
            if value > top:
                top, arg = value, i
        best.append(top + score)
        back.append(arg)
    return back


def _many_spans(found: list[tuple[float, int, int]], begin: int, depths: list[int] | None) -> list[int]:
    """The same in linear time: of spans of usual length, and of long ones, only the best beginning of each depth is tried.

    Ends rise from candidate to candidate, so beginnings pass from short to usual to long spans in order.
    """
    starts = [begin, *(right for _, _, right in found)]
    best, back = [0.0], [0]
    usual: dict[int | None, deque[int]] = {}  # depth (None: any) -> beginnings, best first, later ones behind
    far: dict[int | None, int] = {}  # depth -> the best beginning of long spans
    passed = gone = 0
    for j, (score, left, _) in enumerate(found, 1):
        while passed < j and left - starts[passed] >= SHORT:
            for depth in (None, depths[passed]) if depths else (None,):
                queue = usual.setdefault(depth, deque())
                while queue and best[queue[-1]] <= best[passed]:
                    queue.pop()
                queue.append(passed)
            passed += 1
        while gone < passed and left - starts[gone] >= USUAL:
            for depth in (None, depths[gone]) if depths else (None,):
                held = far.get(depth)
                if held is None or best[gone] + LONGER * starts[gone] >= best[held] + LONGER * starts[held]:
                    far[depth] = gone
            gone += 1
        tried = list(range(j - 1, passed - 1, -1))
        for depth in (None, depths[j]) if depths else (None,):
            queue = usual.get(depth)
            while queue and queue[0] < gone:
                queue.popleft()
            if queue:
                tried.append(queue[0])
            if depth in far:
                tried.append(far[depth])
        top, arg = -1e9, 0
        for i in sorted(tried, reverse=True):
            value = best[i] + _length(left - starts[i])
            if depths and depths[j] != depths[i]:
                value -= 4
            if value > top:
                top, arg = value, i
        best.append(top + score)
        back.append(arg)
    return back


def _cut(text: str, begin: int, end: int, model: Model, one_case: bool, out: list[tuple[int, int]]) -> None:
    """The best spans of text[begin:end] by dynamic programming over candidate ends."""
    found = []
    marks = Marks(text, begin, end)
    for cand in _CAND.finditer(text, begin, end):
        scored = _boundary(text, begin, cand, end, model, one_case, marks)
        if scored:
            found.append(scored)
    if not found:
        out.append((begin, end))
        return
    depths = None
    if marks.at:
        depths, depth, at, straight = [0], 0, begin, 0
        german = "„" in text[begin:end]
        for _, left, right in [*found, (0.0, end, end)]:
            for m in _QUOTE.finditer(text, at, left):
                c = m.group(0)
                if c == '"':
                    straight ^= 1
                elif c == "“" and german and depth > 0:
                    depth -= 1
                elif c in _OPENING:
                    depth += 1
                else:
                    depth -= 1
            at = max(at, left)
            depths.append(depth + straight)
    n = len(found)
    back = (_every_span if n < FEW else _many_spans)([*found, (0.0, end, end)], begin, depths)
    # a boundary is taken only if it pays: compare with running on
    ends, j = [], n + 1
    while j:
        ends.append(j)
        j = back[j]
    at = begin
    for j in reversed(ends):
        left, right = (found[j - 1][1], found[j - 1][2]) if j <= n else (end, end)
        if left > at:
            out.append((at, left))
        at = right


#: A line of Chinese or Japanese (whose sentences end with a stop, unlike Thai) that is so long, and nearly as long as
#: any around it, is wrapped and no heading.
WRAPPED = 12


def _widths(lines: list[str]) -> list[int]:
    """For each line the length of the longest of the lines around it, up to the next blank ones."""
    out = [0] * len(lines)
    first = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            longest = max((len(x.strip()) for x in lines[first:i]), default=0)
            out[first:i] = [longest] * (i - first)
            first = i + 1
    return out


def _runs_on(last: str, first: str, length: int, widest: int) -> bool:
    return bool(_WITH_STOPS.match(last) and _WITH_STOPS.match(first)) and length >= WRAPPED and length >= 0.9 * widest


def split_sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, heading or list item, in code points, without outer white space."""
    out: list[tuple[int, int]] = []
    begin = end = -1
    at = 0
    # in a text of one case, case says nothing about where sentences begin
    one_case = text[1:] == text[1:].lower() or text == text.upper()
    lines = text.split("\n")
    widest = _widths(lines) if len(lines) > 1 and _ASIAN.search(text) else None
    for number, line in enumerate(lines):
        start, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare:
            if begin >= 0:
                _cut(text, begin, end, model, one_case, out)
                begin = -1
            continue
        left = start + line.index(bare[0])
        right = left + len(bare)
        open_line = begin >= 0 and not _CLOSED.search(text, max(begin, end - 8), end)
        mark = _MARK.match(line)
        if mark and open_line and bare[0].isdigit() and not _ASIAN.match(line, mark.end() - 1):
            # a number at the start of a wrapped line
            mark = None if end - max(begin, text.rfind("\n", begin, end) + 1) > 52 else mark
        if mark:
            if begin >= 0:
                _cut(text, begin, end, model, one_case, out)
                begin = -1
            out.append((left, right))
            continue
        if begin >= 0 and (_ASIAN.match(text[end - 1]) or _ASIAN.match(bare[0])) and not (
            open_line and _runs_on(text[end - 1], bare[0], len(lines[number - 1].strip()), widest[number])
        ):
            _cut(text, begin, end, model, one_case, out)
            begin = -1
        if begin < 0:
            begin = left
        end = right
    if begin >= 0:
        _cut(text, begin, end, model, one_case, out)
    return out


# ---------------------------------------------------------------- the model

_DOTTED = re.compile(r"([^\s“”„«»\"（）()\[\]]{1,24})\.(?:([^\S\n]+)[“„«\"(¿¡]?([^\W_]+(?:['’.\-][^\W_]+)*)|\s*$|\s*\n)")
_THAI_SPACE = re.compile(r"[  　]([฀-๿]{1,4})")
_START = re.compile(rf"(?:^|\n[^\S\n]*\n\s*|[{_STOPS}][”»\")’]?[^\S\n]*\n)[^\S\n]*[“„«\"(¿¡]?([^\W_]+(?:['’.\-][^\W_]+)*)")
_THAI_START = re.compile(r"(?:^|\n)([฀-๿]{1,4})")


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            for word, space, follower in _DOTTED.findall(text):
                counts["mid" if space else "end", word.lower()] += 1
                if follower:
                    counts["after", follower] += 1
            for word in _START.findall(text):
                counts["start", word] += 1
            if "฀" <= max(text[:200]) <= "๿" or re.search(r"[฀-๿]", text):
                for word in _THAI_SPACE.findall(text):
                    counts["after", word] += 1
                for word in _THAI_START.findall(text):
                    counts["start", word] += 1
        if len(counts) > 200_000:
            yield _observed(counts)
            counts.clear()
    if counts:
        yield _observed(counts)


def _observed(counts: Counter) -> pa.RecordBatch:
    kinds, words = zip(*counts)
    return pa.RecordBatch.from_pydict({"kind": kinds, "word": words, "n": list(counts.values())}, OBSERVED)


OBSERVED = pa.schema([("kind", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def learn_model(documents: DataFrame, text: str = "text", size: int = MODEL_SIZE) -> Model:
    """Statistics over all documents; the model holds at most ``size`` words of each kind, the most frequent."""
    seen = cut(
        documents.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(_observe, "kind string, word string, n long")
        .groupBy("word")
        .agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("mid", "end", "after", "start")])
    )
    share = lambda a, b: F.col(a) / (F.col(a) + F.col(b))
    lists = {
        "abbreviations": seen.filter((F.col("mid") >= LEAST) & (share("end", "mid") < CLOSES) & F.col("word").rlike(r"\p{L}")).withColumn("n", F.col("mid")),
        "openers": seen.filter((F.col("start") >= LEAST) & (share("start", "after") >= OPENS)).filter(F.col("word").rlike(r"^\p{Ll}")).withColumn("n", F.col("start")),
        "starters": seen.filter((F.col("start") >= LEAST) & (share("start", "after") >= OPENS)).filter(F.col("word").rlike(r"^\p{Lu}")).withColumn("n", F.col("start")),
        "inner": seen.filter((F.col("after") >= LEAST) & (share("start", "after") < OPENS / 3)).withColumn("n", F.col("after")),
    }
    chosen = None
    for kind, words in lists.items():
        part = words.orderBy(F.desc("n"), "word").limit(size).select(F.lit(kind).alias("kind"), "word")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = chosen.collect()
    pick = lambda kind: frozenset(r["word"] for r in rows if r["kind"] == kind)
    return Model(NEVER_LAST | pick("abbreviations"), pick("openers"), pick("starters"), pick("inner"))


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos), one row per sentence of every document.

    Positions are 0-based code points of the text, the end exclusive. All but white space is covered. Null and blank
    texts give no rows; a text of any length is cut block by block; rows that repeat an id are cut each by itself.
    """
    learned = model or learn_model(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(learned)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keys: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                for a, b in split_sentences(t, model):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["doc_id", "start_pos", "end_pos"],
            )

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        spans, "doc_id long, start_pos int, end_pos int"
    )
