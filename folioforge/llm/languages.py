"""Which language a short text is in: by script first, then by function words of the languages in Latin script."""

from __future__ import annotations

import re
from collections import Counter

#: Frequent function words. A word counts for each language that has it, less the more languages do.
FUNCTION_WORDS = {
    "en": "the and of to is was were that also with for on what does how why list please a in an at by from this be are "
    "it not which when after before without between under during whenever although because can you explain main",
    "de": "der die das des und ist den dem im am wie warum mit auf nach in ein eine nicht von zu bei für über aus zum zur "
    "vor seit trotz wegen ohne während wenn was bitte zusammen ich kann es sowie außerhalb innerhalb",
    "fr": "le la les du de des et en est dans pour sur tandis que une un quoi quel à au aux par avec sans avant après "
    "depuis pendant malgré selon entre chaque l d s il elle je ne pas cette ce vous",
    "es": "el la los las del de y en es por para mientras que con una un qué a al sin según antes después desde durante "
    "entre cada hay se lo su como más esta este no puedo",
    "it": "il lo la gli le di e è in per che con una un non del della dei nel sono",
    "pt": "o a os as do da dos das e em é por para que com uma um não no na são",
}
_BY_WORD: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in set(_words.split()):
        _BY_WORD.setdefault(_word, []).append(_language)

_SCRIPTS = [
    ("ja", re.compile(r"[぀-ヿ]")),
    ("th", re.compile(r"[฀-๿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("ko", re.compile(r"[가-힣]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
]
_HAN = re.compile(r"[㐀-鿿]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_MARKS = {"de": re.compile(r"[äöüß]"), "fr": re.compile(r"[àâçèêëîïôùûœ]|\b[ldsqcnj]['’]"), "es": re.compile(r"[ñ¿¡áíóú]")}


def is_function_word(word: str) -> bool:
    return word in _BY_WORD


def scores(words: list[str]) -> Counter:
    found: Counter = Counter()
    for word in words:
        languages = _BY_WORD.get(word)
        if languages:
            for language in languages:
                found[language] += 1 / len(languages)
    return found


def language_of(text: str) -> tuple[str, float]:
    """(language, lead): lead is how far it is ahead of the next one, in function words; ("", 0) if nothing is known."""
    lower = text.lower()
    latin = _LATIN.findall(lower)
    if text and max(text) > "\u036f":
        han = len(_HAN.findall(text))
        letters = sum(map(len, latin))
        for name, script in _SCRIPTS:
            n = len(script.findall(text))
            if n and n * 4 >= letters + (han if name != "ja" else 0):
                return name, float(n)
        if han and han * 3 >= letters:
            return "zh", float(han)
    found = scores(latin)
    if not lower.isascii() or "'" in lower:
        for name, mark in _MARKS.items():
            n = len(mark.findall(lower))
            if n:
                found[name] += min(1.5, 0.5 * n)
    if not found:
        return "", 0.0
    (best, first), *rest = found.most_common(2)
    second = rest[0][1] if rest else 0.0
    if first < 1 or first - second < 0.5:
        return "", 0.0
    return best, first - second
