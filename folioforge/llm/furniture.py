"""Running headers, footers and page numbers in text taken from pages: found by classifiers over pairs of lines.

A line is judged together with its counterpart (the line of another page that is most like it) and with the lines above
and below. A first boosted classifier sees the lines alone; a second one also sees what the first says of the counterpart,
of the neighbours and of lines with the same title. Both are trained on pages laid out here from clean texts, whose
furniture is known. Page numbers are told by their form and by counting on from page to page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from folioforge.llm.boosting import Boosted, boost

_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")

_DIGITS = "0-9lIOoi|"
_PAGE_NUMBER = re.compile(
    rf"^(?P<open>[-–—~\[(<·•*]*)\s*(?P<word>(?:page|p\.|seite|página|pág\.|第)\s*)?(?P<n>[{_DIGITS}]{{1,5}}|[ivxlcdm]{{1,8}})"
    rf"(?:\s*(?P<of>/|of|von|de|sur)\s*(?P<m>[{_DIGITS}]{{1,5}}))?\s*(?P<unit>[页頁])?\s*(?P<close>[-–—~\])>·•*]*)$",
    re.I,
)
_AS_DIGITS = str.maketrans("lIOoi|", "110011")
_EDGE_NUMBER = re.compile(rf"^[{_DIGITS}]{{1,4}}(?: [.01])?\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}(?:[.01] )?[{_DIGITS}]{{1,4}}$")
_STOPS = frozenset(".!?。！？…．,，、;；:：”“»）)]")
_INNER_STOP = re.compile(r"[。！？，；：、]|[.!?,;:](?=\s)")
_NUMERIC = re.compile(r"^[\W\d]+$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_SEPARATED = re.compile(r"^(.{2,}?)\s*[·|•–—-]\s+(.{2,})$")


def _roman(text: str) -> int | None:
    total = 0
    values = [_ROMAN[c] for c in text.lower()]
    for a, b in zip(values, values[1:] + [0]):
        total += -a if a < b else a
    return total


def page_numbers(lines: list[str]) -> dict[int, int]:
    """Line -> page: lines that hold nothing but a page number. A bare number needs others that count on with it."""
    found: list[tuple[int, int, tuple, bool]] = []
    for i, line in enumerate(lines):
        m = _PAGE_NUMBER.match(line)
        if not m:
            continue
        raw = m["n"]
        plain = raw.translate(_AS_DIGITS)
        style = (m["open"], (m["word"] or "").strip().lower(), m["of"] or "", m["unit"] or "", m["close"])
        sure = bool(m["of"] and m["m"] or m["word"] and (m["unit"] or m["word"]) or (m["open"] and m["close"]))
        if not any(c.isdigit() for c in raw) and re.fullmatch(r"[ivxlcdm]+", raw, re.I):
            found.append((i, _roman(raw), (*style, "roman"), sure))
        if plain.isdigit() and (any(c.isdigit() for c in raw) or sure or len(raw) <= 3):
            found.append((i, int(plain), (*style, ""), sure))
    # the longest run that counts up by one, page after page, in one style
    pages: dict[int, int] = {}
    styles: dict[tuple, list] = {}
    for f in found:
        styles.setdefault(f[2], []).append(f)
    for own in styles.values():
        best: list[tuple[int, int]] = []
        at: dict[int, int] = {}  # page -> where its longest run so far ends
        for j, (line, n, _, _) in enumerate(own):
            top = (1, -1)
            for before in (n - 1, n - 2):
                i = at.get(before)
                if i is not None and line - own[i][0] >= 3 and best[i][0] + 1 > top[0]:
                    top = (best[i][0] + 1, i)
            best.append(top)
            if n not in at or top[0] >= best[at[n]][0]:
                at[n] = j
        j = max(range(len(own)), key=lambda k: best[k][0])
        chain = []
        while j >= 0:
            chain.append(own[j])
            j = best[j][1]
        if len(chain) >= 2 or (chain[0][3] and chain[0][1] <= 5000) or (chain[0][1] == 1 and chain[0][0] >= len(lines) - 2):
            if len(chain) == 1 and not chain[0][3] and len(found) > 1:
                continue
            for line, n, _, _ in chain:
                if pages.get(line) is None:
                    pages[line] = n
            if chain[0][3]:
                # in a style that only page numbers have, misread ones belong too
                for line, n, _, sure in own:
                    if sure:
                        pages.setdefault(line, n)
    return pages


def _tidy(line: str) -> str:
    return (line if line.isprintable() else _CONTROL.sub("", line)).strip()


def _has_edge_number(line: str) -> bool:
    return ("  " in line or "\t" in line) and bool(_EDGE_NUMBER.search(line))


def _bare_title(line: str) -> str:
    if "  " in line or "\t" in line:
        line = " ".join(_EDGE_NUMBER.sub("", line).split())
    return line.casefold()


def _stops(line: str) -> bool:
    return line[-1:] in _STOPS


def similarity(a: str, b: str) -> float:
    """Share of equal characters at equal places, allowing one place of shift; for short lines of about equal length."""
    if a == b:
        return 1.0
    if not a or not b or abs(len(a) - len(b)) > 3:
        return 0.0
    n = max(len(a), len(b))
    from_left = sum(x == y for x, y in zip(a, b))
    from_right = sum(x == y for x, y in zip(reversed(a), reversed(b)))
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    mixed = first + next((i for i, (x, y) in enumerate(zip(a[first:][::-1], b[first:][::-1])) if x != y), min(len(a), len(b)) - first)
    return max(from_left, from_right, min(mixed, min(len(a), len(b)))) / n


class TitleIndex:
    """Titles by pieces, so that one that is similar is found for certain, without comparing all.

    Of a title of n characters at most n // 5 may differ from a similar one, so of one piece more than that (two at least,
    as a lone insertion may fall inside one) some piece is intact, at its place from the left or from the right. All
    titles that share a piece are compared, many at once where many do; the latest similar one counts.
    """

    MANY = 24

    def __init__(self) -> None:
        self.same: dict[str, object] = {}
        self.by: dict[tuple[int, int, str], list[int]] = {}
        self.titles: list[tuple[str, object]] = []
        self.codes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sizes: dict[int, int] = {}

    @staticmethod
    @lru_cache(4096)
    def pieces(n: int) -> tuple[tuple[int, int], ...]:
        parts = max(n // 5, 1) + 1
        return tuple((n * i // parts, n * (i + 1) // parts) for i in range(parts) if n * i // parts < n * (i + 1) // parts)

    def add(self, title: str, value: object = True) -> None:
        known = title in self.same
        self.same[title] = value
        if known:
            return
        n, at = len(title), len(self.titles)
        self.titles.append((title, value))
        row = self.sizes.get(n, 0)
        self.sizes[n] = row + 1
        codes, ids = self.codes.get(n) or (np.zeros((4, n), np.uint32), np.zeros(4, np.int64))
        if row == len(ids):
            codes, ids = np.concatenate([codes, np.zeros_like(codes)]), np.concatenate([ids, np.zeros_like(ids)])
        codes[row], ids[row] = _code_points(title), at
        self.codes[n] = codes, ids
        for begin, end in self.pieces(n):
            self.by.setdefault((n, begin, title[begin:end]), []).append(at)

    def find(self, title: str) -> object | None:
        if title in self.same:
            return self.same[title]
        m = len(title)
        best = -1
        for n in range(max(1, m - 3), m + 4):
            if n not in self.sizes:
                continue
            few: set[int] = set()
            many = False
            for begin, end in self.pieces(n):
                for shift in {0, m - n}:
                    if begin + shift < 0:
                        continue
                    hits = self.by.get((n, begin, title[begin + shift : end + shift]))
                    if hits and hits[-1] > best:
                        many = many or len(hits) > self.MANY
                        few.update(hits[-self.MANY :])
            for at in sorted(few, reverse=True):
                if at <= best:
                    break
                if similarity(title, self.titles[at][0]) >= 0.8:
                    best = at
                    break
            if many:
                best = max(best, self._latest(title, n))
        return self.titles[best][1] if best >= 0 else None

    def _latest(self, title: str, n: int) -> int:
        """The latest similar one of all titles of n characters: ``similarity`` for many at once."""
        codes, ids = (x[: self.sizes[n]] for x in self.codes[n])
        own = _code_points(title)
        short = min(n, len(own))
        left = codes[:, :short] == own[:short]
        right = codes[:, ::-1][:, :short] == own[::-1][:short]
        first = np.where(left.all(1), short, left.argmin(1))
        last = np.where(right.all(1), short, right.argmin(1))
        equal = np.maximum(np.maximum(left.sum(1), right.sum(1)), np.minimum(first + last, short))
        found = ids[equal / max(n, len(own)) >= 0.8]
        return int(found.max()) if len(found) else -1


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


# ---------------------------------------------------------------- pairs of lines


class Sheet:
    """The lines of one content, what can be furniture among them, and the counterpart of each such line."""

    def __init__(self, raw: list[str]):
        self.lines = lines = [_tidy(x) for x in raw]
        self.pages = pages = page_numbers(lines)
        self.solid = solid = [i for i, x in enumerate(lines) if x]
        self.candidates: list[int] = []
        self.fed: set[int] = set()
        if not solid:
            return
        lengths = sorted(len(lines[i]) for i in solid)
        self.width = max(1, lengths[int(len(lengths) * 0.95)] if len(lengths) > 2 else lengths[-1])
        self.fed = {i for i in solid if "\x0c" in raw[i]}  # a form feed begins a page
        self.above = dict(zip(solid[1:], solid))
        self.below = dict(zip(solid, solid[1:]))
        edges = {solid[0], solid[-1], *self.fed}
        for i in pages:
            edges.update((self.above.get(i, -1), self.below.get(i, -1)))
        for i in solid:
            line = lines[i]
            if i in pages or _stops(line) or _NUMERIC.match(line):
                continue
            if len(line) < 0.85 * self.width or i in edges or _has_edge_number(line):
                self.candidates.append(i)
        self.edges = edges
        self.bare = {i: _bare_title(lines[i]) for i in self.candidates}
        self.index, self.group = TitleIndex(), {}
        self.members: list[list[int]] = []
        self.labels: dict[str, list[int]] = {}
        self.titles: dict[int, str] = {}
        for i in self.candidates:
            g = self.index.find(self.bare[i])
            if g is None:
                g = len(self.members)
                self.members.append([])
            self.index.add(self.bare[i], g)
            self.members[g].append(i)
            self.group[i] = g
            m = _SEPARATED.match(lines[i])
            if m:
                self.titles[i] = _bare_title(m.group(2))
                self.labels.setdefault(m.group(1).casefold(), []).append(i)
        self.label_of = {i: own for own in self.labels.values() for i in own}
        self.numbered = sum(_has_edge_number(lines[i]) for i in self.candidates)
        self.inner = sum(self._lone(i) and i != solid[0] and self._open_above(i) for i in self.candidates)

    def counterpart(self, i: int) -> int | None:
        own = self.members[self.group[i]]
        if len(own) < 2:
            return None
        at = bisect_left(own, i)
        near = own[max(0, at - 1) : at] + own[at + 1 : at + 2]
        return min(near, key=lambda j: abs(i - j))

    def _lone(self, i: int) -> bool:
        return len(self.lines[i]) < 0.75 * self.width and not self.lines[i][:1].islower()

    def _open_above(self, i: int) -> bool:
        return i > 0 and bool(self.lines[i - 1]) and i - 1 not in self.pages and not _stops(self.lines[i - 1])

    def pair_features(self) -> list[list[float]]:
        """One row per candidate: the line, its counterpart, how alike and how far apart they are, and what is around them."""
        if not self.candidates:
            return []
        lines, pages, edges = self.lines, self.pages, self.edges
        out = []
        some = (float(min(len(self.solid), 60)), float(min(len(pages), 8)), float(min(len(self.fed), 8)), float(min(self.numbered, 8)), float(min(self.inner, 8)))
        for i in self.candidates:
            line, j = lines[i], self.counterpart(i)
            up, down = self.above.get(i, -1), self.below.get(i, -1)
            label = self.label_of.get(i, ())
            out.append(
                [
                    similarity(self.bare[i], self.bare[j]) if j is not None else 0.0,
                    float(min(abs(i - j), 60)) if j is not None else 0.0,
                    float(min(len(self.members[self.group[i]]), 8)),
                    float(j is not None and j in edges),
                    len(line) / self.width,
                    float(min(len(line), 60)),
                    float(_has_edge_number(line)) + 2.0 * float(j is not None and _has_edge_number(lines[j])),
                    float(line[:1].islower()),
                    float(i in self.fed) + 2.0 * float(down in self.fed),
                    float(i == self.solid[0]) + 2.0 * float(i == self.solid[-1]),
                    float(up in pages) + 2.0 * float(down in pages),
                    float(self._open_above(i)),
                    float(up >= 0 and not _stops(lines[up])) + 2.0 * float(lines[down][:1].islower() if down >= 0 else 0),
                    float(i > 0 and not lines[i - 1]) + 2.0 * float(i + 1 < len(lines) and not lines[i + 1]),
                    float(bool(_INNER_STOP.search(line))),
                    float(min(len(label), 8)),
                    float(bool(label) and self.index.find(self.titles[i]) is not None),
                    *some,
                ]
            )
        return out

    def context_features(self, first: np.ndarray) -> list[list[float]]:
        """What the first classifier says of the line, its counterpart, its neighbours, and of lines of the same title or label."""
        p = dict(zip(self.candidates, first.tolist()))
        found = TitleIndex()
        sure = [i for i in self.candidates if p[i] > 0.5]
        for i in sure:
            found.add(self.bare[i])
            if i in self.titles:
                found.add(self.titles[i])
        at = lambda i: 1.0 if i in self.pages else p.get(i, 0.0)
        count = float(min(len(sure), 8))
        best: dict[int, float] = {}
        for g, own in enumerate(self.members):
            best[g] = max(p[i] for i in own)
        out = []
        for i in self.candidates:
            label = self.label_of.get(i, ())
            out.append(
                [
                    p[i],
                    best[self.group[i]],
                    at(self.above.get(i, -1)),
                    at(self.below.get(i, -1)),
                    float(found.find(self.bare[i]) is not None),
                    max((p[k] for k in label[:64]), default=0.0),
                    float(i in self.titles and found.find(self.titles[i]) is not None),
                    count - float(p[i] > 0.5),
                ]
            )
        return out


@dataclass
class Furniture:
    """The two classifiers; ``of`` judges the lines of many contents at once."""

    first: Boosted
    second: Boosted

    def of(self, contents: list[list[str]]) -> list[tuple[dict[int, str], dict[int, int]]]:
        """Per content ({line: 'header' or 'page_number'}, {line: page})."""
        sheets = [Sheet(raw) for raw in contents]
        kinds = [dict.fromkeys(s.pages, "page_number") for s in sheets]
        pairs = [s.pair_features() for s in sheets]
        own = [k for k, x in enumerate(pairs) if x]
        if own:
            table = np.array([row for k in own for row in pairs[k]])
            p = self.first.probability(table)
            ends = np.cumsum([len(pairs[k]) for k in own])
            parts = np.split(p, ends[:-1])
            context = np.array([row for k, part in zip(own, parts) for row in sheets[k].context_features(part)])
            q = 0.8 * self.second.probability(np.hstack([table, context])) + 0.2 * p > 0.5
            for k, part in zip(own, np.split(q, ends[:-1])):
                for i, yes in zip(sheets[k].candidates, part):
                    if yes:
                        kinds[k][i] = "header"
        return [(kind, s.pages) for kind, s in zip(kinds, sheets)]


def find_furniture(raw: list[str], model: Furniture) -> tuple[dict[int, str], dict[int, int]]:
    """({line: 'header' or 'page_number'}, pages) of one document's lines."""
    return model.of([raw])[0]


# ---------------------------------------------------------------- pages to learn from

#: Pages are laid out from so many texts at most, and each classifier sees at most so many of their lines.
LAYOUTS, LAYOUT_LINES = 1_400, 24_000
_NUMBERS = ["{n}", "{n}", "- {n} -", "– {n} –", "[{n}]", "({n})", "Page {n} of {m}", "{n}/{m}", "Seite {n}", "第 {n} 页", "第{n}页", "p. {n}", "roman"]
_SEPARATORS = [" - ", " | ", " · ", " – ", " — ", " • "]


def _in_roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def wrapped(paragraph: str, full: int, ragged: float = 0.0, rng: np.random.Generator | None = None) -> list[str]:
    """Lines of about ``full`` characters, of which a share ``ragged`` is shorter; broken at blanks where there are any near."""
    out, at = [], 0
    while len(paragraph) - at > full:
        width = int(rng.integers(full // 3, full + 1)) if ragged and rng.random() < ragged else full
        gap = paragraph.rfind(" ", at + width // 2, at + width + 1)
        end = gap if gap > at else at + width
        out.append(paragraph[at:end].strip())
        at = end
    out.append(paragraph[at:].strip())
    return [x for x in out if x]


def _misprinted(title: str, rng: np.random.Generator) -> str:
    if rng.random() < 0.15 and len(title) > 4:
        i = int(rng.integers(len(title)))
        return title[:i] + "01. "[rng.integers(4)] + title[i + 1 :]
    return title


def laid_out(title: str, text: str, others: list[str], rng: np.random.Generator) -> tuple[list[str], dict[int, str]]:
    """(lines, {line: kind}): a text on pages, with the furniture of a style drawn at random, or none."""
    wide = sum(c > "\u2e80" for c in text) * 3 > len(text)
    width = int(rng.integers(14, 46) if wide else rng.integers(30, 84))
    spaced, cells = rng.random() < 0.5, rng.random() < 0.3
    ragged = float(rng.choice([0.0, 0.0, 0.0, 0.2]))
    body: list[str] = []
    for paragraph in text.split("\n"):
        if not paragraph.strip():
            continue
        if rng.random() < 0.04:
            body.append(others[rng.integers(len(others))])
        body += wrapped(paragraph.strip(), width, ragged, rng)
        if cells and rng.random() < 0.25:
            body += [str(rng.integers(1990, 2030)), f"{rng.uniform(1, 900):.1f}", f"{rng.integers(1, 100)} %"][: int(rng.integers(1, 4))]
        if spaced and rng.random() < 0.5:
            body.append("")
    brief = rng.random() < 0.2  # a few lines that are no page
    if brief:
        at = int(rng.integers(len(body)))
        body = body[at : at + int(rng.integers(1, 7))]
    count = 1 if brief or rng.random() < 0.05 else int(rng.integers(2, 7))
    height = max(4, -(-len(body) // count))
    pages = [body[i : i + height] for i in range(0, len(body), height)] or [[]]
    plain = brief or rng.random() < 0.1
    headed, footed, numbered = (not plain and rng.random() < r for r in (0.6, 0.4, 0.75))
    style = _NUMBERS[rng.integers(len(_NUMBERS))]
    first = int(rng.integers(1, 200)) if rng.random() < 0.4 else 1
    edge = headed and rng.random() < 0.35  # the page number stands beside the title
    numbered = numbered and not (edge and rng.random() < 0.6)
    upper, skips, feeds, airy, on_top = (rng.random() < r for r in (0.35, 0.4, 0.5, 0.15, 0.1))
    swaps = rng.random() < 0.35  # another title on every second page
    footer = None
    if footed:
        label, other = others[rng.integers(len(others))], others[rng.integers(len(others))]
        label = " ".join(label.split()[:2]) if " " in label else label[:5]
        footer = (label or "Draft") + _SEPARATORS[rng.integers(len(_SEPARATORS))] + other
    lines: list[str] = []
    kinds: dict[int, str] = {}

    def put(line: str, kind: str) -> None:
        kinds[len(lines)] = kind
        lines.append(line)

    for p, page in enumerate(pages):
        n, begin = first + p, len(lines)
        number = _in_roman(n) if style == "roman" else style.format(n=n, m=first + len(pages) - 1)
        if numbered and on_top:
            put(number, "page_number")
        if headed and not (skips and p == 0):
            own = others[0] if swaps and p % 2 else title
            own = _misprinted(own.upper() if upper and rng.random() < 0.5 else own, rng)
            if edge:
                own = f"{n}    {own}" if p % 2 else f"{own}    {n}"
            put(own, "header")
            if airy:
                lines.append("")
        lines += page
        if airy and footer:
            lines.append("")
        if footer:
            put(_misprinted(footer, rng), "header")
        if numbered and not on_top:
            put(number, "page_number")
        if feeds and p and begin < len(lines):
            lines[begin] = "\x0c" + lines[begin]
        elif airy:
            lines.append("")
    return lines, kinds


def train_furniture(titles: list[str], texts: list[str], seed: int = 3) -> Furniture:
    """From texts laid out on pages (at most LAYOUTS), with titles as headers; the second classifier learns on other pages."""
    rng = np.random.default_rng(seed)
    titles = [" ".join(t.split()) for t in titles if t and t.strip()] or ["Title of a document", "另一个标题"]
    texts = [x for x in texts if x and x.strip()] or ["A line of running text that goes on. " * 40, "一行正文的内容，继续下去。" * 60]
    tables: list[tuple[np.ndarray, np.ndarray, list[Sheet]]] = []
    for half in range(2):
        rows, marks, sheets = [], [], []
        for k in range(LAYOUTS // 2):
            text = texts[(2 * k + half) % len(texts)]
            enough = int(rng.integers(300, 2500))
            while len(text) < enough:
                text += "\n" + texts[rng.integers(len(texts))]
            others = [titles[rng.integers(len(titles))] for _ in range(60)]
            lines, kinds = laid_out(titles[rng.integers(len(titles))], text, others, rng)
            sheet = Sheet(lines)
            pairs = sheet.pair_features()
            if pairs:
                sheets.append(sheet)
                rows += pairs
                marks += [float(kinds.get(i) == "header") for i in sheet.candidates]
            if len(rows) >= LAYOUT_LINES // 2:
                break
        tables.append((np.array(rows), np.array(marks), sheets))
    first = boost(tables[0][0], tables[0][1], trees=40, depth=4, bins=64, ridge=8.0)
    table, marks, sheets = tables[1]
    ends = np.cumsum([len(s.candidates) for s in sheets])[:-1]
    context = np.array([row for s, part in zip(sheets, np.split(first.probability(table), ends)) for row in s.context_features(part)])
    return Furniture(first, boost(np.hstack([table, context]), marks, trees=40, depth=4, bins=64, ridge=8.0))
