"""Broken prompt and response pairs: each useless answer with its kind of defect.

Responses are sorted by text and neighbours compared, which finds shortened versions; lengths at which unfinished
answers pile up are length limits; copy, refusal and language rules then apply, one defect per answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.languages import language_of
from folioforge.llm.messages import LONG_SESSION, in_sessions, says_something, sliced
from folioforge.session import cut

# ---------------------------------------------------------------- pairs


def answer_pairs(chat: DataFrame, long_session: int = LONG_SESSION) -> DataFrame:
    """(message_id, question, answer): user messages that say something and the assistant row directly after each.

    System rows are left out, exact repeats count once. Rows of null session, of unreadable role or of a question that
    says nothing give no pair; they still stand between their neighbours, as do rows without id, which give none either.
    Rows without time come first.
    """
    rows = sliced(in_sessions(chat).filter(F.col("role") != "system"), chat, long_session)
    order = Window.partitionBy("session", "slice").orderBy(F.col("at"), F.col("id"), F.col("context").desc(), "role", "content")
    same = F.lit(True)
    for c in ("at", "id", "role", "content"):
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    rows = rows.withColumn("again", (F.row_number().over(order) > 1) & same).filter(~F.col("again"))
    return (
        rows.withColumn("before", F.lag(F.struct("role", "content")).over(order))
        .filter(~F.col("context") & (F.col("role") == "assistant") & (F.col("before.role") == "user"))
        .select(F.col("id").alias("message_id"), F.col("before.content").alias("question"), F.col("content").alias("answer"))
        .filter(says_something(F.col("question")) & F.col("message_id").isNotNull())
    )


# ---------------------------------------------------------------- refusals

#: How a refusal is put, by language. Only the first person declines; a system that cannot do a thing is a subject.
REFUSALS = re.compile(
    "|".join(
        [
            r"\b(?:i|we) (?:can['’]?t|cannot|can not|won['’]?t|will not|must not|may not|am not able to|are not able to|am unable to|"
            r"are unable to|do not feel able to|don['’]t feel able to|have to decline|must decline|decline to|refuse to|prefer not to|"
            r"['’]?d rather not)\b",
            r"\b(?:i['’]m|i am|we['’]re) (?:not able|unable|not allowed|not permitted) to\b",
            r"\bnot possible for (?:me|us) to\b",
            r"\bi['’]d rather not\b",
            r"\b(?:kann|darf|möchte|werde|will|muss) ich\b[^.!?]*\b(?:nicht|nichts|keine?n?|ablehnen)\b",
            r"\bich (?:kann|darf|möchte|werde|will)\b[^.!?]*\b(?:nicht|nichts|keine?n?)\b",
            r"\bich (?:muss|lehne)\b[^.!?]*\b(?:ablehnen|ab)\b",
            r"\b(?:mir|uns) (?:leider )?nicht möglich\b",
            r"\bje (?:ne (?:peux|puis|souhaite|suis|dois)\b[^.!?]*\bpas|préfère ne pas|refuse|dois (?:refuser|décliner))\b",
            r"\b(?:m['’]est|nous est) impossible\b",
            r"\b(?:no (?:puedo|podemos|debo|me es posible|estoy (?:autorizad|en condiciones))|debo (?:rechazar|declinar)|me niego|prefiero no|me es imposible)",
            r"我(?:们)?(?:暂时)?(?:不能|无法|不便|不可以|没法|没有办法|不会|拒绝|必须拒绝)",
            r"恕(?:我)?(?:不能|无法|难)",
            r"(?:请求|问题|要求)我(?:没有办法|无法|不能|没法)",
            r"(?:お答え|お手伝い|対応|提供)(?:することは)?(?:でき(?:ません|ない)|いたしかね)",
            r"(?:ผม|ฉัน|ดิฉัน|เรา)?ไม่สามารถ(?:ตอบ|ช่วย)",
            r"मैं[^।]*(?:नहीं (?:कर|दे|बता) सकत|असमर्थ)",
        ]
    ),
    re.I,
)
#: Apologies that may stand beside a refusal.
APOLOGIES = re.compile(
    r"^\W*(?:(?:i['’]m|i am|we['’]re) (?:very |really )?(?:sorry|afraid)|sorry|apologies|my apologies|unfortunately|leider|tut mir leid|es tut mir leid|"
    r"entschuldigung|désolée?|je suis désolée?|malheureusement|lo siento|lamentablemente|perdón|抱歉|很抱歉|对不起|很遗憾|非常抱歉|"
    r"申し訳(?:ありません|ございません)(?:が)?|すみません|ขออภัย|क्षमा करें)\W*$",
    re.I,
)
_BUT = re.compile(r"(?:\b(?:but|however|aber|jedoch|mais|cependant|pero|sin embargo)\b|但是|不过|可是|但)(.{25,})", re.I | re.S)
_SENTENCE = re.compile(r"[^.!?。！？।\n]+[.!?。！？।]*")


#: Every refusal holds one of these, in lower case; most answers hold none and need no pattern.
REFUSAL_STEMS = (
    "can't", "can’t", "cant ", "cannot", "can not", "won't", "won’t", "wont ", "will not", "must not", "may not", "able to", "feel able",
    "decline", "refuse", "prefer not", "rather not", "possible for", "not allowed", "not permitted", " ich ", "ich kann", "ich darf", "ich möchte",
    "ich werde", "ich will", "ich muss", "ich lehne", "nicht möglich", "je ne ", "je préfère", "je dois", "impossible", "no pued", "no podemos",
    "no debo", "no me es", "no estoy", "debo ", "me niego", "prefiero no", "me es imposible", "我", "恕", "でき", "いたしかね", "ไม่สามารถ", "मैं",
)


#: A run without a stop that is longer than this is no sentence that only declines.
LONGEST_SENTENCE = 1000


def is_refusal(answer: str) -> bool:
    """Declines and gives no answer: every sentence declines or apologises, and nothing substantial follows a 'but'."""
    low = answer.lower()
    if not any(stem in low for stem in REFUSAL_STEMS):
        return False
    for m in _SENTENCE.finditer(answer):
        sentence = m.group(0)
        if not re.search(r"\w", sentence) or APOLOGIES.match(sentence):
            continue
        if len(sentence) > LONGEST_SENTENCE:
            return False
        hit = REFUSALS.search(sentence)
        if not hit or _BUT.search(sentence, hit.end()):
            return False
    return bool(REFUSALS.search(answer))


# ---------------------------------------------------------------- copies

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
#: How many words (or characters of a script without spaces) a label before the question may have.
COPY_EXTRA = 4


def in_order(q: list[str], a: list[str]) -> int:
    """How many words of q stand in a in the same order: the longest common subsequence, all places of q at once as bits."""
    least = min(len(q), len(a))
    head = next((i for i in range(least) if q[i] != a[i]), least)
    tail = next((i for i in range(least - head) if q[-1 - i] != a[-1 - i]), least - head)
    same, q, a = head + tail, q[head : len(q) - tail], a[head : len(a) - tail]
    places: dict[str, int] = {}
    for i, word in enumerate(q):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(q)) - 1
    free = full
    for word in a:
        hit = free & places.get(word, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return same + len(q) - free.bit_count()


def is_copy(question: str, answer: str) -> bool:
    """Gives back the question and adds nothing but a label: at least 0.8 of its words in order, at most COPY_EXTRA others."""
    q = _TOKEN.findall(question.lower())
    if not q:
        return False
    words = set(q)
    allowed = COPY_EXTRA + 2 * (len(q[0]) == 1 and not q[0].isascii())
    a, extra = [], 0
    for m in _TOKEN.finditer(answer.lower()):
        # most answers have too many other words early on
        a.append(m.group(0))
        extra += a[-1] not in words
        if extra > allowed:
            return False
    if q == a:
        return True
    if len(words.intersection(a)) < 0.7 * len(words):
        return False
    common = sum((Counter(q) & Counter(a)).values())
    if common < 0.8 * len(q) or in_order(q, a) < 0.8 * len(q):
        return False
    rounds = max(1, round((len(a) - extra) / len(q)))
    return abs(len(a) - extra - rounds * len(q)) <= max(allowed, len(q) // 3) and extra <= max(2, len(q) // 2)


# ---------------------------------------------------------------- languages

#: Names of languages as a request may put them.
LANGUAGE_NAMES = {
    "zh": "chinese|chinesisch|chinois|chino|中文|汉语|漢語|中国語|จีน|चीनी",
    "en": "english|englisch|anglais|inglés|ingles|英文|英语|英語|อังกฤษ|अंग्रेज़ी",
    "de": "german|deutsch|allemand|alemán|aleman|德文|德语|ドイツ語|เยอรมัน|जर्मन",
    "fr": "french|französisch|français|francais|francés|frances|法文|法语|フランス語|ฝรั่งเศส|फ़्रेंच",
    "es": "spanish|spanisch|espagnol|español|espanol|西班牙文|西班牙语|西文|スペイン語|สเปน|स्पेनिश",
    "ja": "japanese|japanisch|japonais|japonés|日文|日语|日本語|ญี่ปุ่น|जापानी",
    "hi": "hindi|印地语|印地文|ヒンディー語|ฮินดี|हिन्दी|हिंदी",
    "th": "thai|thailändisch|thaï|tailandés|泰文|泰语|タイ語|ไทย|थाई",
}
_ASKS = {
    k: re.compile("|".join(rf"\b{n}\b" if n[0] < "\u0250" else n for n in v.split("|")), re.I) for k, v in LANGUAGE_NAMES.items()
}
_QUOTED = re.compile(r"“[^”“]*[”“]|„[^“”]*[“”]|«[^»]*»|「[^」]*」|\"[^\"\n]*\"|```.*?(?:```|$)|\n---\n.*", re.S)
_MARKS = "“„«「\"`-"


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if any(mark in text for mark in _MARKS) else text


def is_wrong_language(question: str, answer: str) -> bool:
    """In another language than the question, which does not ask for that. Quotations, code and citations don't count."""
    own = _unquoted(answer)
    got, lead = language_of(own)
    own_script = got in ("zh", "ja", "th", "hi", "ko", "ru", "ar")
    if not got or (lead < 1 and not own_script):
        return False
    head = _unquoted(question)
    asked, sure = language_of(head)
    if not asked or asked == got or (not own_script and lead < 1.5 and sure < 3) or (sure < 1 and not own_script):
        return False
    if got == "zh" and asked == "ja" or got == "ja" and asked == "zh":
        return got == "ja" or not re.search(r"[぀-ヿ]", own)
    return not any(p.search(head) for k, p in _ASKS.items() if k == got)


# ---------------------------------------------------------------- truncation

_CLOSERS = "\"'”“’»」』）)\\]】〕*_ \\u00a0\\u3000\\u200b"
_FINISHED = re.compile(rf"(?:[.!?。！？…।．‼⁉؟]|\.\.\.)[{_CLOSERS}]*$")
_HANGING = re.compile(r"[,，、;；:：—–\-(（\[【{]\s*$")
_INNER_STOP = re.compile(r"[.!?。！？…।．][”“»」』）)\]]*(?:\s+\S|(?<=[。！？…．”」）])\S)")
_FINISHED_INSIDE = re.compile(r"[.!?…](?=\s)|[。！？।．]")
_OPEN = {"（": "）", "(": ")", "【": "】", "[": "]", "「": "」", "『": "』", "«": "»"}
_WORD = r"[^\W\d_㐀-鿿぀-ヿ฀-๿]+"
_LAST_WORD = re.compile(rf"({_WORD})\s*$")
_LAST_HAN = re.compile(r"([㐀-鿿]{2})\s*$")
#: A word (or pair of Chinese characters) ends a clause: punctuation or a line end follows.
_UNITS = re.compile(rf"({_WORD})(\s?[.,;:!?…»”)\]。，；：！？、）」]|\s*\n)?")
_HAN_UNITS = re.compile(r"(?=([㐀-鿿]{2})([.,;:!?…»”)\]。，；：！？、）」』】]|\s*\n)?)")
#: Below this share of its uses at the end of a clause, a word is one after which nobody stops.
STOP_SHARE = 0.02


def _unclosed(text: str) -> bool:
    if text.count("```") % 2:
        return True
    for opening, closing in _OPEN.items():
        at = text.rfind(opening)
        if at >= 0 and text.find(closing, at) < 0 and not _FINISHED_INSIDE.search(text, at):
            return True
    return False


def ending_of(answer: str) -> tuple[str, str]:
    """(state, unit): ``open`` breaks off for certain, ``done`` does not; ``ask`` depends on the last unit's usual place."""
    text = answer.rstrip()
    if _unclosed(text):
        return "open", ""
    if text.endswith("```") or _FINISHED.search(text):
        return "done", ""
    if _HANGING.search(text):
        return "open", ""
    last = text.rsplit("\n", 1)[-1]
    plain = last if last != text else ""
    word = _LAST_HAN.search(last) or _LAST_WORD.search(last)
    unit = word.group(1).lower() if word else ""
    if not plain and not re.search(r"\[\d+\]\s*$", text) and _INNER_STOP.search(text):
        return "open", unit
    return ("ask", unit) if unit else ("done", "")


_JUDGED = pa.schema(
    [("message_id", pa.int64()), ("defect", pa.string()), ("state", pa.string()), ("unit", pa.string()), ("answer", pa.string()), ("length", pa.int32())]
)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers with a defect, and those whose ending is open or in doubt; the rest end here."""
    for batch in batches:
        out = []
        d = batch.to_pydict()
        for message_id, question, answer, says in zip(d["message_id"], d["question"], d["answer"], d["says"]):
            if not says:
                out.append((message_id, "empty", "done", "", None, 0))
            elif is_refusal(answer):
                out.append((message_id, "refusal", "done", "", None, 0))
            elif is_copy(question, answer):
                out.append((message_id, "copy", "done", "", None, 0))
            elif is_wrong_language(question, answer):
                out.append((message_id, "wrong_language", "done", "", None, 0))
            else:
                state, unit = ending_of(answer)
                if state != "done":
                    out.append((message_id, None, state, unit, (bare := answer.rstrip()), len(bare)))
        columns = list(zip(*out)) if out else [[]] * len(_JUDGED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _JUDGED)], schema=_JUDGED)


_UNIT_COUNTS = pa.schema([("unit", pa.string()), ("uses", pa.int64()), ("stops", pa.int64())])


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def table() -> pa.RecordBatch:
        uses: Counter = Counter()
        stops: Counter = Counter()
        for (unit, mark), n in counts.items():
            unit = unit.lower()
            uses[unit] += n
            if mark:
                stops[unit] += n
        return pa.RecordBatch.from_pydict({"unit": list(uses), "uses": list(uses.values()), "stops": [stops[u] for u in uses]}, _UNIT_COUNTS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            # what ends the text is neither counted as a stop nor as a use in mid-clause
            text = text.rstrip()
            cut_at = len(text)
            while cut_at and text[cut_at - 1].isalpha():
                cut_at -= 1
            body = text[:cut_at] if len(text) - cut_at <= 40 else re.sub(r"[^。！？，、；.!?,]{1,12}$", "", text)
            counts.update(_UNITS.findall(body))
            if not body.isascii():
                counts.update(_HAN_UNITS.findall(body))
        if len(counts) > 300_000:
            yield table()
            counts.clear()
    if counts:
        yield table()


def unit_statistics(pairs: DataFrame) -> DataFrame:
    """(unit, uses, stops): how often each last word occurs in answers, and how often a clause ends after it."""
    return (
        pairs.filter("says")
        .select("answer")
        .mapInArrow(_count_units, "unit string, uses long, stops long")
        .groupBy("unit")
        .agg(F.sum("uses").alias("uses"), F.sum("stops").alias("stops"))
    )


#: What an ending may add to a text that was cut: marks that stand for the rest.
_REST = " \t\r\n\u00a0\u3000.…-–—"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted texts of one partition: each text whose common prefix with the next different one is all of it; edges are passed on."""
    held: str | None = None
    part = None
    first = True
    for batch in batches:
        out = []
        for text, part in zip(batch["answer"], batch["part"]):
            if text == held:
                continue
            if first:
                out.append((part, "head", text, False))
                first = False
            if held is not None and text.startswith(held):
                out.append((part, "short", held, text[len(held)].isalpha() and held[-1:].isalpha()))
            held = text
        yield pd.DataFrame(out, columns=["part", "kind", "answer", "inside_word"])
    if held is not None:
        yield pd.DataFrame([(part, "tail", held, False)], columns=["part", "kind", "answer", "inside_word"])


def shortened_versions(pairs: DataFrame) -> DataFrame:
    """(answer, inside_word): answers that another answer continues; inside_word if they end within a word of it.

    Marks that stand for what is left out do not count as text. If any text starts with this one, the next different text
    in sorted order does, so only neighbours are compared. Texts are spread by range; the last text of a range is compared
    with the first of the next through their edges.
    """
    ordered = (
        pairs.filter("says")
        .select(F.rtrim(F.rtrim("answer"), F.lit(_REST)).alias("answer"))
        .filter(F.length("answer") > 0)
        .groupBy("answer")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("answer")
        .repartitionByRange("answer")
        .sortWithinPartitions("answer")
        .withColumn("part", F.spark_partition_id())
    )
    found = cut(ordered.mapInPandas(_neighbours, "part int, kind string, answer string, inside_word boolean"))
    # one head and one tail per partition: empty partitions are bridged by order, not by number
    edges = found.filter(F.col("kind") != "short").withColumn(
        "next", F.lead(F.struct("kind", "answer")).over(Window.partitionBy(F.lit(0)).orderBy("part", "kind"))
    )
    bridged = edges.filter((F.col("kind") == "tail") & F.col("next.answer").startswith(F.col("answer"))).select(
        "answer",
        F.expr("substring(next.answer, length(answer) + 1, 1) rlike '\\\\p{L}' and answer rlike '\\\\p{L}$'").alias("inside_word"),
    )
    return found.filter(F.col("kind") == "short").select("answer", "inside_word").unionByName(bridged)


def length_limits(judged: DataFrame, answers: DataFrame | None = None, factor: float = 4.0, deviations: float = 8.0) -> DataFrame:
    """(length): lengths at which answers without an ending pile up, against the lengths around them.

    A pile is ``factor`` times what is usual, and further above it than chance explains: by so many standard
    ``deviations`` of a count. Give each text once: copies of one answer are no limit. With ``answers`` (length of every
    answer, each text once), the share without an ending must be twice what it is around: where short answers never have
    one, their usual length is no limit.
    """
    unfinished = F.col("state").isin("ask", "open")
    near = F.array(*[F.col("length") + d for d in (-3, -2, -1, 1, 2, 3)])

    def counted(rows: DataFrame, name: str) -> DataFrame:
        own = rows.groupBy("length").agg(F.count(F.lit(1)).alias(name))
        around = own.select(F.explode(near).alias("length"), name).groupBy("length").agg((F.sum(name) / 6).alias(f"{name}_near"))
        return own.join(around, "length", "left").fillna(0.0, [f"{name}_near"])

    sizes = counted(judged.filter(unfinished), "n")
    expected = F.col("n_near")
    pile = (F.col("n") > factor * expected) & (F.col("n") - expected > deviations * F.sqrt(expected + 1))
    found = sizes.filter(pile)
    if answers is not None:
        share, usual = F.col("n") / F.col("every"), F.col("n_near") / F.greatest(F.col("every_near"), F.lit(1e-9))
        found = found.join(counted(answers, "every"), "length").filter(share > 2 * F.least(usual, F.lit(1.0)))
    return found.select("length")


def truncations(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """(message_id, evidence) of the answers that break off, by the first evidence that holds.

    ``prefix``: the sorted neighbour continues the answer within a word (one that ends with a word may be a short answer);
    ``limit``: it has no ending and the length at which such answers pile up; ``ending``: it stops inside a
    bracket, code block or clause, or its last sentence alone has no ending; ``unit``: its last word is one after which
    clauses in these answers never end. Answers with a finished ending never count.
    """
    open_ones = judged.filter(F.col("defect").isNull() & (F.col("state") != "done"))
    bare = open_ones.withColumn("answer", F.rtrim(F.col("answer"), F.lit(_REST)))
    versions = shortened_versions(pairs)
    inside = bare.join(versions.filter("inside_word").select("answer").distinct(), "answer", "left_semi").select("message_id")
    texts = open_ones.groupBy(F.xxhash64("answer").alias("h")).agg(F.first("state").alias("state"), F.first("length").alias("length"))
    lengths = pairs.filter("says").select(F.rtrim("answer").alias("a")).groupBy(F.xxhash64("a").alias("h")).agg(F.first(F.length("a")).alias("length"))
    at_limit = open_ones.join(length_limits(texts, lengths), "length", "left_semi").select("message_id")
    ending = open_ones.filter(F.col("state") == "open").select("message_id")
    doubtful = open_ones.filter(F.col("state") == "ask")
    rare = (
        doubtful.select("unit").distinct().join(unit_statistics(pairs), "unit", "left")
        .filter(F.coalesce(F.col("stops"), F.lit(0)) < STOP_SHARE * F.coalesce(F.col("uses"), F.lit(0)) + 1e-9)
        .select("unit")
    )
    by_unit = doubtful.join(rare, "unit", "left_semi").select("message_id")
    found = None
    for rank, (name, rows) in enumerate([("prefix", inside), ("limit", at_limit), ("ending", ending), ("unit", by_unit)]):
        part = rows.select("message_id", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("e"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("message_id").agg(F.min("e").alias("e")).select("message_id", F.col("e.name").alias("evidence"))


def judged_pairs(chat: DataFrame, long_session: int = LONG_SESSION) -> tuple[DataFrame, DataFrame]:
    """(pairs, judged): the pairs, and of answers with a defect or without an ending what is to be said of them."""
    pairs = cut(answer_pairs(chat, long_session).withColumn("says", says_something(F.col("answer"))))
    return pairs, cut(pairs.mapInArrow(_judge, "message_id long, defect string, state string, unit string, answer string, length int"))


def broken_pairs(chat: DataFrame, long_session: int = LONG_SESSION) -> DataFrame:
    """(message_id, defect) of each answer that is useless, one defect each.

    ``empty``, ``refusal``, ``copy``, ``wrong_language`` or ``truncated``, in this order of precedence; ``truncations``
    says what makes an answer truncated. A single sentence or a heading without a full stop alone is not. Null contents
    are empty; empty tables give no rows.
    """
    pairs, judged = judged_pairs(chat, long_session)
    sure = judged.filter(F.col("defect").isNotNull()).select("message_id", "defect")
    return sure.unionByName(truncations(pairs, judged).select("message_id", F.lit("truncated").alias("defect"))).distinct()
