"""Sentence units of documents in many languages and scripts, by cascading tables of break and no-break rules.

A text is cut into blocks at blank lines. A line that is a heading, list item, log, settings or chat line is one unit.
In prose every mark that may end a sentence is a position to decide: a rule is a pair of patterns, one for the text up
to the position and one for the text after it, and says break or no break. Rules stand in tables, one per language, in
order; for a position the tables are tried in cascade (those of the block's script, the document's language first, then
the other Latin ones, then the common table) and the first rule that matches decides. Quotations and brackets are found first; no
position inside one is a candidate. The language tables are chosen per block, since documents mix languages and their label may
be missing or wrong.

Defined results: null and blank texts have no units; a unit ends at its last character that is not white space; signs
without letters or digits (such as a smiley after the full stop) belong to the unit before them in the block; a text
without any mark is one unit; repeated documents give repeated rows; texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.runtime import map_batches


@dataclass(frozen=True)
class Rule:
    """Break or no break where ``before`` matches the text up to the position and ``after`` the text behind it."""

    breaks: bool
    before: re.Pattern
    after: re.Pattern


def _rules(*rows: tuple[bool, str, str]) -> tuple[Rule, ...]:
    """Abbreviations count in either case and with up to three blanks inside; what follows is matched as it stands."""
    wide = lambda p: p.replace(r"\s?", r"\s{0,3}")
    return tuple(Rule(b, re.compile(f"(?:{wide(before)})$", re.I), re.compile(after)) for b, before, after in rows)


_W = r"(?<!\w)"
_ANY = r"(?=\s)"
_LOW = r"\s+[\"'“„«(\[]?[a-zß-öø-ÿа-яёα-ωά-ώ]"
_UP = r"\s+[\"'“„«(\[]?[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ]"
_NUM = r"\s+[(\[]?[\d§]"
_CLOSER = r"(?:[\"'”“’»›)\]）」』】》〉]|\s[»›])"
_CLOSE, _CLOSED = _CLOSER + "*", _CLOSER + "+"

#: Ordered rules per language: (breaks, pattern before, pattern after). The abbreviations are fixed values.
TABLES: dict[str, tuple[Rule, ...]] = {
    "en": _rules(
        (False, _W + r"(?:Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|Messrs|Gen|Col|Capt|Lt|Sgt|Rev|Hon|Gov|Pres|Fr|Mt)\.", _ANY),
        (False, _W + r"(?:[Nn]os?|[Ff]igs?|[Ss]ecs?|[Vv]ols?|[Cc]h|pp?|[Aa]rts?|v|vs|[Ee]qs?|[Pp]ar|ver|op|ed|Ex)\.", _NUM),
        (False, _W + r"(?:e\.\s?g|i\.\s?e|cf|viz|vs|incl|excl|approx|resp|ca|esp)\.", _ANY),
        (False, _W + r"(?:a\.\s?m|p\.\s?m|etc|U\.\s?S|U\.\s?K|E\.\s?U|U\.\s?N|U\.\s?S\.\s?A|secs?|mins?|hrs?|max|est|al|Inc|Ltd|Co|Corp|dept|ext|temp|avg|std|no|v)\.", _LOW),
    ),
    "de": _rules(
        (False, _W + r"(?:z|d|u|o|i|s|v|m|n)\.", r"\s*[A-Za-zÄÖÜäöü]\."),
        (False, _W + r"(?:z\.\s?B|d\.\s?h|u\.\s?a|u\.\s?U|o\.\s?ä|i\.\s?d\.\s?R|i\.\s?A|v\.\s?a|m\.\s?E|s\.\s?o|s\.\s?u)\.", _ANY),
        (False, _W + r"(?:Abschn|Nr|Art|Abb|Kap|Bd|S|Str|Tab|Ziff|Abs|Anm|Rn)\.", _NUM),
        (False, _W + r"(?:bzw|ca|ggf|inkl|vgl|Vgl|evtl|sog|bspw|Hr|Fr|Dr|Prof|St|zzgl|exkl|gem|lt|Dipl|Ing)\.", _ANY),
        (False, _W + r"(?:usw|etc|ff?|Sek|Min|Std|Mio|Mrd|Tsd|max|min)\.", _LOW),
        (False, r"(?:^|[\s(])\d{1,2}\.", r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Jahrhundert|Stufe|Mal)\b"),
        (False, r"(?:^|[\s(])\d{1,2}\.", r"\s+(?:bis|und|oder)\s"),
    ),
    "fr": _rules(
        (False, _W + r"c\.\s?-à-\s?d\.", _ANY),
        (False, _W + r"(?:M|MM|Mme|Mlle|Dr|Pr|Me|Mgr|St|Ste)\.", _ANY),
        (False, _W + r"(?:art|pp?|fig|chap|vol|n|no|cf|env|éd|tél|av|apr|sect|réf|ch|al|etc|min|sec|max|ex)\.", r"(?:" + _LOW + r"|" + _NUM + r")"),
        (False, _W + r"p\.", r"\s*ex\."),
    ),
    "es": _rules(
        (False, _W + r"(?:Sr|Sra|Sres|Srta|Dr|Dra|D|Dña|Ud|Uds|Vd|Lic|Ing|Prof|Profa|Gral)\.", _ANY),
        (False, _W + r"p\.", r"\s*ej\."),
        (False, _W + r"p\.\s?ej\.", _ANY),
        (False, _W + r"EE\.", r"\s*UU\."),
        (False, _W + r"(?:EE\.\s?UU|[Pp]ágs?|núms?|[Aa]rts?|[Ff]igs?|caps?|vols?|tel|aprox|máx|mín|etc|seg|min|hab|av|pp?)\.", r"(?:" + _LOW + r"|" + _NUM + r")"),
    ),
    "ru": _rules(
        (False, _W + r"т\.", r"\s*[едпкно]\."),
        (False, _W + r"т\.\s?[екно]\.", _ANY),
        (False, _W + r"(?:т\.\s?[дп]|др|пр)\.", _LOW),
        (False, _W + r"(?:[Рр]ис|[Сс]м|[Сс]тр|[Гг]л|[Сс]т|п|пп|[Тт]абл|№|[Чч]|[Сс]р|[Рр]азд|[Пп]рил)\.", r"(?:" + _LOW + r"|" + _NUM + r")"),
        (False, _W + r"(?:гг?|тыс|млн|млрд|руб|коп|сек|мин|ч|макс|ред|изд|напр|прибл|ок|им|ул|проф|акад|д|кв)\.", r"(?:" + _LOW + r"|" + _NUM + r")"),
    ),
    "el": _rules(
        (False, _W + r"(?:π\.\s?χ|κ\.\s?ά|κ\.\s?τ\.\s?λ|δηλ|βλ|Δρ|δρ|Καθ|κ|κα)\.", _ANY),
        (False, _W + r"(?:[Σσ]ελ|αρ|[Άά]ρθ|κεφ|[Εε]ικ|παρ|[Ππ]ίν|τ)\.", r"(?:" + _LOW + r"|" + _NUM + r")"),
        (False, _W + r"(?:κ\.λπ|κλπ|δευτ|λεπ|περ|τηλ|χιλ|εκ)\.", _LOW),
        (True, r"[;;]", r"\s|$"),
    ),
    "ar": _rules((False, _W + r"(?:د|أ|م|ص|ج|ط|هـ|ق|ت|أ\.\s?د)\.", _ANY), (True, r"؟", r"")),
    "hi": _rules((False, r"(?<![ऀ-ॣ])(?:डॉ|श्री|प्रो|पं|सु|कु|मि|रु|नं|सं|डा|इं)\.", _ANY), (True, r"[।॥]", r"")),
    "th": _rules((False, r"(?:พ|ศ|น|ดร|นาย|เลข|ค|จ|อ|ต)\.", r"")),
    "zh": _rules(
        (False, r"[。！？!?…][”’」』]+", r"\s?(?:然后|后来|随后|就|便|并|而|且|再|又|但|却|说|道|地|的|是|之类|这|，|。|、|；|,)"),
        (False, r"(?:…+|\.{3,})", r"\S"),
        (True, r"[。！？｡][」』”’）)】]*", r""),
    ),
    "ja": _rules(
        (False, r"[。！？!?…][」』”’]+", r"\s?(?:と|って|という|の|が|を|は|に|も|で|など|や|から|まで|へ|、|。|だ)"),
        (False, r"(?:…+|\.{3,})", r"\S"),
        (True, r"[。！？｡][」』”’）)】]*", r""),
    ),
    "common": _rules(
        (False, r"(?:…+|\.{3,})" + _CLOSE, _LOW),
        (False, r"[.!?…]" + _CLOSED, _LOW),
        (False, r"(?:^|[\s(«„“\"\[])(?-i:[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω])\.", r"\s+[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω]"),
        (False, r"[;;]", r""),
        (True, r"[.!?…。！？｡؟۔।॥]" + _CLOSE, r"\s|$"),
        (True, r"[。！？｡؟।॥]" + _CLOSE, r""),
    ),
}

#: Tables of each script by the names of its blocks of code points, in the order of test.
SCRIPTS = (
    (re.compile(r"[\u3040-\u30ff]"), ("ja", "zh")),
    (re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]"), ("zh", "ja")),
    (re.compile(r"[\u0e00-\u0e7f]"), ("th",)),
    (re.compile(r"[\u0900-\u097f]"), ("hi",)),
    (re.compile(r"[\u0600-\u06ff]"), ("ar",)),
    (re.compile(r"[\u0400-\u04ff]"), ("ru",)),
    (re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]"), ("el",)),
)
_NOT_LATIN = re.compile(r"[\u0370-\u1fff\u3040-\u9fff]")
LATIN = ("en", "de", "fr", "es")
_LATIN_LETTER = re.compile(r"[A-Za-z\u00c0-\u024f]")
#: A block is in a script of its own if one in so many of its letters is; technical prose is full of Latin names.
FOREIGN_SHARE = 8
#: A block with Chinese characters is Japanese if it has at least one kana for so many of them.
HAN_PER_KANA = 10

_LINE = re.compile(r"\r\n|[\n\r  \x85\x0b\x0c]")
_LIST = re.compile(r"\s*(?:[-*•‣◦▪·+–—]|\d{1,3}[.)]|\(\d{1,3}\)|[a-z]\))\s+\S")
_TYPED = re.compile(
    r"\s*(?:#{1,6}\s+\S|={3,}\s*$|-{3,}\s*$"
    r"|\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\]?\s+\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\b"
    r"|export\s+[\w.\-]+\s*=|[\w\-]+(?:\.[\w\-]+)+\s*(?:=|:\s)|[\w.\-]+=\S|--?[\w\-]+=\S"
    r"|\[\d{1,2}:\d{2}(?::\d{2})?\]\s)"
)

_OPENER = re.compile(r"[\"“„«‹「『《(（\[【]")
_QUOTED = re.compile(
    r"„[^„“”]*[“”]|“[^“”]*”|«[^«»]*»|‹[^‹›]*›|「[^「」]*」|『[^『』]*』|《[^《》]*》|(?<!\w)\"[^\"]*\"(?!\w)"
    r"|\((?:[^()]|\([^()]*\))*\)|（(?:[^（）]|（[^（）]*）)*）|\[[^\[\]]*\]|【[^【】]*】"
)
_SOLID = "。！？｡؟।॥"
#: Runs of marks: with white space behind them, or in scripts with marks of their own anywhere. Runs are taken whole.
_MARK = re.compile(r"[.!?…;](?<![.!?…;][.!?…;])[.!?…;]*+" + _CLOSE + r"+(?=\s|\Z)")
_ANY_MARK = re.compile(r"[.!?…;;۔。！？｡؟।॥](?<![.!?…;;۔。！？｡؟।॥]{2})[.!?…;;۔。！？｡؟।॥]*+" + _CLOSE + "+")
_THAI_GAP = re.compile(r"(?<=[\u0e01-\u0e3a\u0e40-\u0e4e])\s+(?=[\u0e01-\u0e3a\u0e40-\u0e4e])")
_TAIL = re.compile(r"[^\W\d_]+\Z")
#: Characters before a mark that rules may look at: the longest rule, with its word boundary, has fewer.
_BEFORE = 28
_MOST_KNOWN = 200_000


def typed(line: str, above_is_prose: bool) -> bool:
    """Whether a line is a heading, list item, log, settings or chat line; a list does not begin inside prose."""
    return bool(_TYPED.match(line)) or not above_is_prose and bool(_LIST.match(line))


class Cascade:
    """Rule tables in the order in which they are tried, with what is known of the words before a mark."""

    def __init__(self, names: tuple[str, ...]) -> None:
        self.special = tuple(rule for n in names for rule in TABLES[n])
        self.rules = self.special + TABLES["common"]
        self.latin = names[0] in LATIN
        self.known: dict[str, bool] = {}

    def plain(self, word: str) -> bool:
        """Whether no rule of a language concerns a full stop after ``word`` (of four letters on: one-word rules only)."""
        if word not in self.known:
            if len(self.known) > _MOST_KNOWN:
                self.known.clear()
            self.known[word] = not any(r.before.search(f" {word}.") for r in self.special if not r.breaks)
        return self.known[word]

    def decides(self, text: str, start: int, at: int) -> bool:
        """The first rule that matches decides; none means no break. Text in capitals is read as small letters."""
        before = text[max(start, at - _BEFORE) : at]
        if before[-1:] == "." and at < len(text) and before[-2:-1].isalpha():
            word = _TAIL.search(before[:-1])[0]
            if len(word) >= 4 and len(word) < len(before) - 1 and self.plain(word):
                return True
        last, following = before[-12:], text[at : at + 12]
        if last.isupper() and following.isupper() and sum(map(str.isalpha, last)) > 3 and sum(map(str.isalpha, following)) > 1:
            text, at, before = text[at : at + 40].lower(), 0, before.lower()
        follows: dict[re.Pattern, bool] = {}  # few patterns stand behind many rules
        for rule in self.rules:
            fits = follows.get(rule.after)
            if fits is None:
                fits = follows[rule.after] = bool(rule.after.match(text, at))
            if fits and rule.before.search(before):
                return rule.breaks
        return False


@cache
def _cascade(names: tuple[str, ...]) -> Cascade:
    return Cascade(names)


def cascade_for(block: str, lang: str | None) -> Cascade:
    """The cascade for one block: the tables of the script that most of its letters outside Latin belong to, unless these
    are few among its letters; among the Latin ones the document's label comes first."""
    found = None if block.isascii() else _NOT_LATIN.search(block)
    if found:
        outside = len(block) - len(block.encode("ascii", "ignore"))
        first = next((i for i, (pattern, _) in enumerate(SCRIPTS) if pattern.match(found[0])), None)
        counts = [0] * len(SCRIPTS)
        if first is not None:
            counts[first] = len(SCRIPTS[first][0].findall(block))
        if first in (0, 1):
            counts[1 - first] = len(SCRIPTS[1 - first][0].findall(block))
        if 2 * sum(counts) <= outside:  # several scripts
            counts = [len(pattern.findall(block)) for pattern, _ in SCRIPTS]
        kana, han = counts[0], counts[1]
        if kana or han:
            counts[0], counts[1] = (kana + han, 0) if kana * HAN_PER_KANA >= han else (0, kana + han)
        most = max(counts)
        if most and (2 * most > len(block) or most * FOREIGN_SHARE >= len(_LATIN_LETTER.findall(block))):
            return _cascade((*SCRIPTS[counts.index(most)][1], *LATIN))
    label = (lang or "").strip().lower()[:2]
    return _cascade(tuple(dict.fromkeys((label, *LATIN) if label in LATIN else LATIN)))


def prose_ends(text: str, lang: str | None) -> list[int]:
    """Offsets behind the sentences of one block of prose."""
    cascade = cascade_for(text, lang)
    spans = [m.span() for m in _QUOTED.finditer(text)] if _OPENER.search(text) else []
    if cascade.latin:
        marks = [m.span() for m in _MARK.finditer(text)]
    else:
        marks = [m.span() for m in _ANY_MARK.finditer(text) if m.end() == len(text) or text[m.end()].isspace() or any(c in _SOLID for c in m[0])]
        marks = sorted([*marks, *((m.start(), m.start()) for m in _THAI_GAP.finditer(text))])
    ends, start, s = [], 0, 0
    for a, b in marks:
        while s < len(spans) and spans[s][1] <= a:
            s += 1
        if s < len(spans) and spans[s][0] < a:
            opened, closed = spans[s]
            if b < closed or text[opened] in "([（【" and text[start:opened].strip():
                continue
        if a == b or cascade.decides(text, start, b):
            ends.append(b)
            start = b
    return ends


def _last(text: str, end: int) -> int:
    while end and text[end - 1].isspace():
        end -= 1
    return end


def unit_ends(text: str, lang: str | None = None) -> list[int]:
    """Places (from 1) of the last characters of all units."""
    out: list[int] = []
    at, prose_start, prose_end, above_is_prose = 0, None, 0, False

    def flush() -> None:
        nonlocal prose_start
        if prose_start is None:
            return
        block = text[prose_start:prose_end]
        kept = [_last(block, e) for e in prose_ends(block, lang)]
        kept = [e for e in kept if e]
        final = _last(block, len(block))
        if not kept or kept[-1] < final:
            if kept and not any(c.isalnum() for c in block[kept[-1] : final]):
                kept[-1] = final
            else:
                kept.append(final)
        out.extend(prose_start + e for e in dict.fromkeys(kept))
        prose_start = None

    while at <= len(text):
        m = _LINE.search(text, at)
        end, following = (m.start(), m.end()) if m else (len(text), len(text) + 1)
        line = text[at:end]
        if not line.strip():
            flush()
            above_is_prose = False
        elif typed(line, above_is_prose):
            flush()
            out.append(at + _last(line, len(line)))
            above_is_prose = False
        else:
            if prose_start is None:
                prose_start = at
            prose_end, above_is_prose = end, True
        at = following
    flush()
    return out


def sentence_units(documents: DataFrame) -> DataFrame:
    """``doc_id, end_pos``: one row per unit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = [], []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                ends = unit_ends(text, lang)
                ids.extend([doc_id] * len(ends))
                places.extend(ends)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64())], names=["doc_id", "end_pos"])

    picked = documents.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return map_batches(picked.filter(F.col("text").isNotNull()), run, "doc_id bigint, end_pos bigint")
