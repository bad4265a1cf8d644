"""Sentence boundaries by cascading rule tables.

A unit is what stands between blank lines. In it every terminal mark (with the closing marks and emoji after it) is a
place where a sentence may end; in Thai text every blank is one. Tables of ordered rules are mapped to languages by
patterns, and all tables whose pattern fits the unit's language apply one after another: enclosures, list marks, the
language's own table, names, the common one. The first rule whose two patterns match the text before and after the
place, each as far as it reaches, decides between break and no break.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Abbreviations by language. "title" ones stand before a name, "number" ones before a number, "inner" ones
# before anything, "last" ones may also close a sentence, which then goes on with a capital letter or a figure.
ABBREVIATIONS = {
    "en": {
        "title": "dr prof mr mrs ms st gen col capt lt sgt rev hon gov sen rep messrs mt ft",
        "number": "no nos fig figs sec secs ch vol p pp art eq ref approx ca",
        "inner": "e.g i.e cf vs viz al approx inc ltd co corp dept est",
        "last": "etc a.m p.m jr sr u.s u.k ph.d",
    },
    "de": {
        "title": "dr prof hr hrn fr frl st ing dipl",
        "number": "nr nrn abb bd tab s kap abs art ziff ca",
        "inner": "z.b d.h u.a bzw vgl ca evtl ggf inkl sog z b d h u a i usw.-",
        "last": "usw etc u.s.w",
    },
    "fr": {
        "title": "m mm mme mmes mlle dr pr me st ste mgr",
        "number": "p pp art no n° fig vol chap env",
        "inner": "cf ex p.ex c.-à-d env av apr",
        "last": "etc",
    },
    "es": {
        "title": "sr sra srta sres dr dra d dña ud uds lic ing prof",
        "number": "núm pág págs p art fig vol cap aprox n.º",
        "inner": "ej p.ej cf p aprox",
        "last": "etc",
    },
    "ru": {
        "title": "проф акад им гр тов г ул пл св д-р доц",
        "number": "стр рис табл гл см №  п с т",
        "inner": "см ср напр т.е т.к т т.н",
        "last": "др пр т.п т.д п д",
    },
    "el": {
        "title": "κ κα κος καθ δρ αγ",
        "number": "σελ σ αρ εικ κεφ",
        "inner": "π.χ βλ δηλ πρβλ λ.χ",
        "last": "κ.λπ κλπ κτλ",
    },
    "hi": {"title": "डॉ डा प्रो श्री पं", "number": "सं पृ क्र", "inner": "उदा", "last": ""},
    "ar": {"title": "د أ م أ.د", "number": "ص رقم ج", "inner": "", "last": "إلخ"},
    "am": {"title": "ዶ/ር ፕ/ር አ/አ", "number": "", "inner": "", "last": ""},
}
# Frequent words that tell languages in the Latin alphabet apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it by at as on for with no each our one while but or this",
    "de": "der die das und den bei im von zu seit nach laut am eine ein gegen während jede etwa oder mit ist",
    "fr": "le la les de des un une et en du est que près cette chaque environ mais chez selon dans tandis qui",
    "es": "el la los las de una un y en con según cerca aquella cada unas pero porque por qué sobre",
}
# German months, after the day's full stop.
GERMAN_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Jun Jul Aug Sept Sep Okt Nov Dez"

#: Signs that close a sentence wherever they stand, and those that need a blank or the unit's end after them.
FULL_WIDTH = "。！？｡．"
NEEDS_BLANK = ".!?…‼⁇⁈⁉।॥؟۔።፧፨"
CLOSERS = "\"'”’»›)]}」』）】》〉〕］｝“‘"
#: Without blanks a quotation mark that may also open one opens the next sentence.
CLOSERS_WIDE = "\"'”’»›)]}」』）】》〉〕］｝"
EMOJI = r"(?:[\p{Extended_Pictographic}\p{RI}--[\d#*©®™‼⁉]][︎️\U0001F3FB-\U0001F3FF]*(?:‍\p{Extended_Pictographic}[︎️\U0001F3FB-\U0001F3FF]*)*)"
INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠㅤﾠ]")
_EMOJI_BEFORE = regex.compile(rf"(?r)(?:\s*{EMOJI})+", regex.V1)
_V1 = regex.V1

UNIT_END = regex.compile(r"(?:\r\n|[\n\r ])\s*?(?:\r\n|[\n\r ])\s*", _V1)
LINE_START = r"(?:\A|\n)\s*"
LIST_SIGN = r"(?:[-–—*•·‣▪]|[(（]?(?:\p{Nd}{1,3}|\p{Ll}|[ivxIVX]{1,4})[.)）]|[一二三四五六七八九十]{1,3}、)"
LIST_NUMBER = r"[(（]?(?:\p{Nd}{1,3}|\p{Ll}|[ivxIVX]{1,4})\."
SPACE_PLACE = regex.compile(rf"[{regex.escape(NEEDS_BLANK)}{FULL_WIDTH}]+(?:[{regex.escape(CLOSERS)}*_~`]|(?<=[!?…»])\s(?=»))*(?:[^\S\n]*{EMOJI})*(?=\s|\Z)|[{FULL_WIDTH}]+[{regex.escape(CLOSERS_WIDE)}]*(?:[^\S\n]*{EMOJI})*", _V1)
GREEK_PLACE = regex.compile(rf"(?:{SPACE_PLACE.pattern})|[;;][{regex.escape(CLOSERS)}]*(?:[^\S\n]*{EMOJI})*(?=\s|\Z)", _V1)
THAI_PLACE = regex.compile(r"[^\S\r\n]+", _V1)


@dataclass(frozen=True)
class Rule:
    """What must stand right before and right after a place, and whether a sentence ends there.

    before is matched backwards from the place; None matches anything. An enclosing rule holds only inside quotations
    and brackets.
    """

    name: str
    before: regex.Pattern | None
    after: regex.Pattern
    ends: bool
    enclosing: bool = False


@dataclass(frozen=True)
class Table:
    """Rules for the languages that a pattern fits. No rule matches where ``any_before`` doesn't (None: some may)."""

    languages: regex.Pattern
    rules: tuple[Rule, ...]
    any_before: regex.Pattern | None


def rule(name: str, before: str, after: str, ends: bool, enclosing: bool = False) -> tuple[str, Rule]:
    return before, Rule(name, regex.compile(rf"(?r)(?:{before})", _V1) if before else None, regex.compile(after, _V1), ends, enclosing)


def table_of(languages: str, rules: list[tuple[str, Rule]]) -> Table:
    parts = [before for before, _ in rules]
    together = regex.compile("(?r)" + "|".join(f"(?:{x})" for x in parts), _V1) if all(parts) and len(parts) > 1 else None
    return Table(regex.compile(languages), tuple(r for _, r in rules), together)


OPENERS = r"[\"'“‘„«‹(\[{「『（【《〈¿¡*_~`#]"
CAPITAL = rf"\s*{OPENERS}*\s?[\p{{Lu}}\p{{Lt}}]"
FIGURE = rf"\s*{OPENERS}*\p{{N}}"
CLOSED = rf"[{regex.escape(CLOSERS)}*_~`]*"
WORD_START = r"(?<![\p{L}\p{M}\p{N}.])(?<!\p{N}\s)"  # after a number it would be a unit


def _any_of(words: str) -> str:
    return "(?:" + "|".join(regex.escape(w).replace(r"\.", r"\.\s?") for w in sorted(set(words.split()), key=lambda w: (-len(w), w))) + ")"


def _language_rules(lang: str) -> list[tuple[str, Rule]]:
    a, rules = ABBREVIATIONS[lang], []
    if lang == "de":
        rules.append(rule("day of a month", r"(?<!\p{N})\p{Nd}{1,2}\.", rf"\s+(?:{'|'.join(GERMAN_MONTHS.split())})\b", False))
        rules.append(rule("z. B.", rf"(?i:{WORD_START}(?:z\.\s?b|d\.\s?h|u\.\s?a|i\.\s?d|v\.\s?a|o\.\s?ä))\.", r"\s", False))
        rules.append(rule("z.", rf"{WORD_START}[zduivo]\.", r"\s+[\p{L}]{1,2}\.", False))
    if lang == "fr":
        rules.append(rule("p. ex.", rf"{WORD_START}p\.", r"\s+ex\.", False))
    if lang == "es":
        rules.append(rule("p. ej.", rf"{WORD_START}p\.", r"\s+ej\.", False))
    if lang == "ru":
        rules.append(rule("т. п. before a capital", rf"{WORD_START}т\.\s*[пд]\.", CAPITAL, True))
        rules.append(rule("в 1961 г.", r"(?i:(?<!\p{L})в)\s+\p{Nd}+\s*г{1,2}\.", r"\s+\S", False))
        rules.append(rule("до 1988 г.", r"\p{Nd}\s*г{1,2}\.", CAPITAL, True))
        rules.append(rule("т.", rf"(?i:{WORD_START}т)\.", r"\s+[пдекн]\.", False))
    if a["last"]:
        rules.append(rule("abbreviation that may be last", rf"(?i:{WORD_START}{_any_of(a['last'])})\.{CLOSED}", rf"{CAPITAL}|{FIGURE}", True))
        rules.append(rule("abbreviation that goes on", rf"(?i:{WORD_START}{_any_of(a['last'])})\.", r"\s+\S", False))
    if a["number"]:
        rules.append(rule("abbreviation before a number", rf"(?i:{WORD_START}{_any_of(a['number'])})\.", r"\s+[(\[]?(?:\p{N}|[IVXLC]+\b)", False))
    if a["inner"]:
        rules.append(rule("abbreviation inside", rf"(?i:{WORD_START}{_any_of(a['inner'])})\.", r"\s+\S", False))
    if a["title"]:
        rules.append(rule("title", rf"(?i:{WORD_START}{_any_of(a['title'])})\.", r"\s+\S", False))
    return rules


#: The cascade: tables in the order in which they apply, by the languages they are for.
TABLES = [
    table_of(".*", [rule("inside a quotation or bracket", "", "", False, enclosing=True)]),
    table_of("(?!th).*", [rule("number of a list", rf"{LINE_START}{LIST_NUMBER}", r"[^\S\n]\s*\S", False)]),
    table_of("th", [
        rule("start of the unit", r"\A\s*", "", False),
        rule("mark of a list", rf"{LINE_START}{LIST_SIGN}", r"\s", False),
        rule("within a number", r"[\p{Nd}\p{No}]", r"[^\S\r\n]+[\p{Nd}\p{No}]", False),
        rule("emoji of the sentence", "", rf"\s+{EMOJI}", False),
        rule("nothing follows", "", r"[^\S\r\n]+\Z", False),
        rule("blank", "", r"[^\S\r\n]+", True),
    ]),
    *[table_of("latin|" + lang if lang in FUNCTION_WORDS else lang, _language_rules(lang)) for lang in ABBREVIATIONS if _language_rules(lang)],
    table_of("(?!th).*", [rule("initial of a name", r"(?<![\p{L}\p{M}\p{N}°'’])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}", False)]),
    table_of("(?!th).*", [
    rule("full-width mark closed by a quote that goes on", rf"[{FULL_WIDTH}][”’」』》〉\"]+", r"[^\s\"“‘「『《〈(（]", False),
    rule("full-width mark", rf"[{FULL_WIDTH}]\P{{L}}*?", r"", True),
    rule("nothing follows", r"", r"\s*\Z", True),
    rule("quote in capitals that goes on", r"[.!?…][\"'”’»›“]+", r"\s+\p{Lu}{2,}(?![\p{Ll}])", False),
    rule("capital letter", r"", CAPITAL, True),
    rule("opening quote", r"", r"\s+[\"“„«「『‹]", True),
    rule("figure", r"", FIGURE, True),
    rule("opening bracket or list sign", r"", r"\s+(?:[(\[]\S|[-–—•]\s)", True),
    rule("small letter", r"", rf"\s*{OPENERS}*\s?\p{{Ll}}", False),
    rule("quote that goes on in a script without capitals", rf"[{regex.escape(NEEDS_BLANK)}][\"'”’»›“]+", r"\s+\p{Lo}", False),
    rule("letter without case, or a sign", r"", r"\s+\S", True),
    ]),
]


@lru_cache(maxsize=64)
def tables_of(lang: str) -> tuple[Table, ...]:
    """The tables that apply to a language, in order; Latin letters of no known language get those of all known ones."""
    return tuple(t for t in TABLES if t.languages.fullmatch(lang))


_SCRIPTS = [
    ("th", r"\p{Thai}"), ("zh", r"\p{Han}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"),
    ("am", r"\p{Ethiopic}"), ("el", r"\p{Greek}"), ("ru", r"\p{Cyrillic}"), ("latin", r"\p{Latin}"),
]
_ASKED = {w: [lang for lang in FUNCTION_WORDS if w in FUNCTION_WORDS[lang].split()] for words in FUNCTION_WORDS.values() for w in words.split()}
_LATIN_WORD = regex.compile(r"\p{Latin}+")


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """Of every code point, the place of its script in the list above from 1 on; 0 for others."""
    whole = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for k, (_, pattern) in enumerate(_SCRIPTS):
        out[[ord(c) for c in regex.findall(pattern, whole)]] = k + 1
    return out


def language_of(text: str, default: str = "latin") -> str:
    """The language whose rules hold for a text: by its script, Latin ones by their function words."""
    if text.isascii():
        script = "latin"
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.bincount(_script_of()[points], minlength=len(_SCRIPTS) + 1)[1:].tolist()
        counts = {lang: n for (lang, _), n in zip(_SCRIPTS, found)}
        if counts["ja"] * 8 > counts["zh"]:
            counts["ja"] += counts["zh"]
        script = max(counts, key=lambda k: counts[k])
        if not counts[script]:
            return default
    if script != "latin":
        return script
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    seen = Counter(_LATIN_WORD.findall(text.lower()))
    for w in seen.keys() & _ASKED.keys():
        for lang in _ASKED[w]:
            votes[lang] += seen[w]
    best = max(votes, key=lambda k: votes[k])
    return best if votes[best] and sorted(votes.values())[-2] < votes[best] else default


_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "‘": "’"}
_SIGNS = regex.compile("[" + regex.escape("".join(_PAIRS) + "".join(_PAIRS.values()) + '"') + "]")


def enclosed(text: str) -> list[tuple[int, int]]:
    """Half-open spans of quotations and brackets, their signs included; a sign without its partner encloses nothing."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []  # (signs that close it, where it opened)
    for m in _SIGNS.finditer(text):
        sign, at = m.group(), m.start()
        for k in range(len(stack) - 1, -1, -1):
            if sign in stack[k][0]:
                if sign == "’" and at + 1 < len(text) and text[at + 1].isalpha():  # an apostrophe
                    break
                spans.append((stack[k][1], at + 1))
                del stack[k:]
                break
        else:
            if sign == '"':
                stack.append(('"', at))
            elif sign in _PAIRS and not (sign == "‘" and at and text[at - 1].isalnum()):
                stack.append((_PAIRS[sign], at))
    return spans


def _unit_places(text: str, lang: str) -> Iterator[int]:
    """Where sentences of a unit end (not its own end)."""
    inside: bytearray | None = None
    tables = tables_of(lang)
    for m in (THAI_PLACE if lang == "th" else GREEK_PLACE if lang == "el" else SPACE_PLACE).finditer(text):
        at = m.start() if lang == "th" else m.end()
        if at >= len(text):
            continue
        if inside is None:
            inside = bytearray(len(text) + 1)
            for a, b in enclosed(text):
                inside[a + 1 : b] = b"\x01" * (b - a - 1)
        if _ends(text, at, bool(inside[at]), tables):
            yield at


def _ends(text: str, at: int, within: bool, tables: tuple[Table, ...]) -> bool:
    """The first rule that fits decides; what follows an emoji is decided by what stands before it."""
    stop = at
    if at and text[at - 1] > " " and (emoji := _EMOJI_BEFORE.match(text, 0, at)):
        stop = emoji.start()
    for t in tables:
        if t.any_before is not None and t.any_before.match(text, 0, stop) is None:
            continue
        for r in t.rules:
            if r.enclosing and not within:
                continue
            if (r.before is None or r.before.match(text, 0, stop)) and r.after.match(text, at):
                return r.ends
    return False


_ODD = regex.compile(r"[\p{Cf}͏ᅟᅠㅤﾠ]|\P{M}\p{M}+|(?<!\P{M})\p{M}+")
_EMOJI_JOINER = regex.compile(r"(?<=[\p{Extended_Pictographic}️\U0001F3FB-\U0001F3FF])‍(?=\p{Extended_Pictographic})")


def _plain(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible characters and with composed accents, and each character's place in the original."""
    if text.isascii() or not INVISIBLE.search(text) and unicodedata.is_normalized("NFC", text):
        return text, None
    out: list[str] = []
    where: list[int] = []
    joiners = {m.start() for m in _EMOJI_JOINER.finditer(text)}
    done = 0
    for m in _ODD.finditer(text):
        a, b = m.span()
        out.append(text[done:a])
        where.extend(range(done, a))
        done = b
        kept = [k for k in range(a, b) if k in joiners or not INVISIBLE.match(text[k])]
        own = "".join(text[k] for k in kept)
        composed = unicodedata.normalize("NFC", own)
        own = composed if len(composed) < len(own) else own
        out.append(own)
        where.extend(kept[: len(own)])
    out.append(text[done:])
    where.extend(range(done, len(text)))
    return "".join(out), where


def _visible(c: str) -> bool:
    return not (c.isspace() or unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp") or c in "͏ᅟᅠㅤﾠ")


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Half-open spans of code points, one for each sentence; none for null and blank texts."""
    if not text:
        return []
    plain, where = _plain(text)
    default, spans = "", []
    for a, b in _units(plain):
        unit = plain[a:b]
        lang = language_of(unit, "")
        if not lang:  # that of the whole text
            lang = default = default or language_of(plain)
        at = 0
        for end in (*_unit_places(unit, lang), len(unit)):
            x, y = a + at, a + end
            at = end
            while x < y and not _visible(plain[x]):
                x += 1
            while y > x and not _visible(plain[y - 1]):
                y -= 1
            if x < y:
                if where is None:
                    spans.append((x, y))
                else:
                    stop = where[y] if y < len(where) else len(text)
                    while stop > where[y - 1] + 1 and not _visible(text[stop - 1]):
                        stop -= 1
                    spans.append((where[x], stop))
    return spans


def _units(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in UNIT_END.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos): one row for each sentence of each text, as half-open spans of code points.

    A narrow map over Arrow batches, whole texts, no shuffle. Null and blank texts give no rows. A blank line ends a
    unit; a single line break doesn't. Repeated rows repeat their sentences (keys of documents are unique); a null key
    stays null; other columns are ignored.
    """
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [sentence_spans(x) for x in part.column(1).to_pylist()]
                rows = pa.array([k for k, spans in enumerate(found) for _ in spans], pa.int64())
                starts, ends = (pa.array([s[j] for spans in found for s in spans], pa.int64()) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), starts, ends], names=[key, "start_pos", "end_pos"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {key_type}, start_pos bigint, end_pos bigint")
