"""Texts that look the same but differ in their characters, brought to one form."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.words import sliced
from kelpie.session import written

# Letters that look like a Latin letter but which the public table of look-alikes doesn't group with it,
# or that are Latin themselves, by that letter.
LOOKALIKE_LETTERS = {"Q": "Ԛ", "a": "ɑ", "g": "ɡ", "i": "ı", "l": "ӏ", "u": "ʋ", "x": "χ", "z": "ᴢ"}
#: Scripts whose signs aren't letters of an alphabet.
NO_ALPHABET = regex.compile(r"[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Tangut}\p{Yi}\p{Nushu}\p{Khitan_Small_Script}]")
#: Visible format characters: signs that span the digits after them. All other format characters are invisible.
VISIBLE_FORMAT = set("؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd")
#: Invisible although they aren't format characters: joiners, fillers and variation selectors.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


_LATIN = regex.compile(r"\p{Latin}")


class UnionFind:
    """Disjoint sets over strings, with path halving."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)


def _decomposed(text: str) -> str:
    return unicodedata.normalize("NFD", text)


@lru_cache(maxsize=1)
def _letters() -> str:
    """Letters of alphabets that are whole in themselves: no composed, raised or listed ones."""
    listed = set("".join(LOOKALIKE_LETTERS.values()))
    single = (chr(c) for c in range(0x41, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo"))
    return "".join(c for c in single if c not in listed and not NO_ALPHABET.match(c) and len(_decomposed(c)) == 1)


def lookalike_groups(spark: SparkSession) -> tuple[str, ...]:
    """Letters that look alike by Unicode's table of confusable characters, as the JVM's ICU library has it.

    Letters with one skeleton form a group: the ASCII letters and letters of other alphabets, but no second Latin one.
    Where a group holds both cases of a letter, or two ASCII letters, capitals and small letters are kept apart.
    """
    letters = _letters()
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    by_skeleton: dict[str, list[str]] = {}
    for c, skeleton in zip(letters, checker.getSkeleton(0, "\n".join(letters)).split("\n"), strict=True):
        if c.isascii() or not _LATIN.match(c):
            by_skeleton.setdefault(skeleton, []).append(c)
    out = []
    for group in by_skeleton.values():
        parts = [group]
        if len({c.casefold() for c in group}) < len(group) or sum(c.isascii() for c in group) > 1:
            parts = [[c for c in group if (unicodedata.category(c) in ("Lu", "Lt")) == upper] for upper in (True, False)]
        out += ["".join(p) for p in parts if len(p) > 1]
    return tuple(sorted(out))


@lru_cache(maxsize=2)
def classes(groups: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """The transitive look-alike classes over code points and strings, by any one member; the empty string's class is the invisible ones.

    All strings are canonically decomposed, so that composition never makes a difference. Derived from the properties
    of all code points: width variants, compatibility signs of several letters (ligatures) or of one letter of another
    block (micro sign), kinds of blanks, invisible characters; and from the ``groups`` of look-alike letters.
    """
    sets = UnionFind()
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        if cp in INVISIBLE or category == "Cf" and c not in VISIBLE_FORMAT:
            sets.join(c, "")
            continue
        if category == "Zs":
            sets.join(c, " ")
            continue
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if not tag.startswith("<"):
            continue
        whole = _decomposed("".join(chr(int(x, 16)) for x in rest.split()))
        if tag in ("<wide>", "<narrow>") or tag == "<noBreak>" or tag == "<compat>" and category[0] == "L" and cp != 0x017F:
            sets.join(c, whole)
    for letter, others in [*LOOKALIKE_LETTERS.items(), *((g[0], g[1:]) for g in groups)]:
        for c in others:
            sets.join(_decomposed(c), letter)
    found: dict[str, list[str]] = {}
    for x in list(sets.up):
        found.setdefault(sets.find(x), []).append(x)
    return found


def members(groups: tuple[str, ...] = ()) -> list[str]:
    return sorted(x for group in classes(groups).values() for x in group if x)


def representatives(counts: dict[str, int], groups: tuple[str, ...] = ()) -> dict[str, str]:
    """member -> representative: of each class the most frequent member, of equals the first in code point order.

    The invisible class keeps the empty string. A representative is a member no other member is part of, so the result
    of rewriting never holds something to be rewritten.
    """
    to: dict[str, str] = {}
    for group in classes(groups).values():
        if "" in group:
            best = ""
        else:
            single = [x for x in group if len(x) == 1] if len({len(x) for x in group}) == 1 else [x for x in group if len(x) > 1 or x.isascii()] or group
            best = min(single, key=lambda x: (-counts.get(x, 0), x))
        to.update((x, best) for x in group if x and x != best)
    # a string of several letters is itself written in representatives
    return {x: "".join(to.get(c, c) for c in y) if len(y) > 1 else y for x, y in to.items()}


class Rewriter:
    """Rewrites texts to their representative form, greedily from the left, the longest member first.

    An automaton finds the members of several code points. Members of one code point are what is left between those:
    they can't overlap anything, so a table indexed by code point rewrites them in all texts of a batch at once.
    """

    def __init__(self, to: dict[str, str]):
        self.ascii_fixed = not any(x.isascii() for x in to)
        self.hidden, self.table = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        self.longer: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for x, y in to.items():
            if len(x) > 1:
                self.automaton.add_word(x, (len(x), y))
            elif not y:
                self.hidden[ord(x)] = True
            elif len(y) == 1:
                self.table[ord(x)] = ord(y)
            else:
                self.longer[x] = y
        self.strings = len(self.automaton) > 0
        if self.strings:
            self.automaton.make_automaton()
        self.becomes_longer = re.compile("[" + re.escape("".join(sorted(self.longer))) + "]") if self.longer else None

    def __call__(self, text: str) -> str:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[str]:
        """The forms of several texts."""
        out = list(texts)
        at = [k for k, x in enumerate(texts) if not (self.ascii_fixed and x.isascii())]
        joined = _BETWEEN.join([texts[k] for k in at])
        if joined.count(_BETWEEN) != max(0, len(at) - 1):  # a text holds the sign that parts them: each on its own
            parts = [self._form(texts[k]) for k in at]
        else:
            parts = self._form(joined).split(_BETWEEN)
        for k, form in zip(at, parts):
            out[k] = form
        return out

    def _form(self, text: str) -> str:
        points = _points(text)
        hides = self.hidden[points]
        if hides.any():  # marks meet their letters only without what hides between them
            text = _text(points[~hides])
        text = _decomposed(text)
        if not self.strings:
            return _decomposed(self._single(text))
        out, at = [], 0
        for end, (n, y) in self.automaton.iter_long(text):
            start = end - n + 1
            out += (self._single(text[at:start]), y)
            at = end + 1
        out.append(self._single(text[at:]))
        return _decomposed("".join(out))

    def _single(self, text: str) -> str:
        points = _points(text)
        changed = self.table[points]
        if not np.array_equal(changed, points):
            text = _text(changed)
        return self.becomes_longer.sub(lambda m: self.longer[m.group()], text) if self.becomes_longer else text


#: A noncharacter that parts texts which are rewritten together.
_BETWEEN = "\U0010ffff"


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def member_counts(records: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each class member occurs in all texts: at most as many rows as there are members reach the driver."""
    known = set(members(lookalike_groups(records.sparkSession)))
    long = sorted(x for x in known if len(x) > 1)
    single = np.array(sorted(ord(x) for x in known if len(x) == 1), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        strings: Counter = Counter()
        automaton = ahocorasick.Automaton()
        for x in long:
            automaton.add_word(x, x)
        automaton.make_automaton()
        for part in (x for batch in batches for x in sliced(batch, 0)):
            joined = _decomposed("\n".join(x for x in part.column(0).to_pylist() if x))
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            total += np.bincount(points, minlength=len(total))
            strings.update(x for _, x in automaton.iter(joined))
        rows = [(chr(p), int(total[p])) for p in single if total[p]] + list(strings.items())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["member", "n"])

    counted = records.select(text).mapInArrow(run, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in counted.collect()}


def canonical_text(records: DataFrame, key: str = "id", text: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """(key, text, canonical): each text beside its representative form; a null text has a null form."""
    to = representatives(member_counts(records, text) if counts is None else counts, lookalike_groups(records.sparkSession))
    key_type = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(to)
        for part in (x for batch in batches for x in sliced(batch, 1)):
            texts = part.column(1).to_pylist()
            forms = [None if x is None else form for x, form in zip(texts, rewrite.many([x or "" for x in texts]))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forms, pa.string())], names=[key, text, "canonical"])

    return records.select(key, text).mapInArrow(run, f"`{key}` {key_type}, `{text}` string, canonical string")


def spelled(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, form, form2, own): a 128-bit digest of each text's form and a 64-bit one of the text itself, written once.

    Null keys and texts, and texts without any visible sign or blank, have no row; repeated rows count once.
    """
    to = representatives(member_counts(records, text), lookalike_groups(records.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(to)
        for part in (x for batch in batches for x in sliced(batch, 1)):
            ids, digests = [], []
            texts = part.column(1).to_pylist()
            for i, x, form in zip(part.column(0).to_pylist(), texts, rewrite.many([x or "" for x in texts])):
                if form and i is not None:
                    ids.append(i)
                    digests.append(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest() + hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest())
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(d[:, k].copy()) for k in range(3))], names=["id", "form", "form2", "own"])

    schema = "id bigint, form bigint, form2 bigint, own bigint"
    return written(records.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema), "spelled").distinct()


def look_same(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id_a, id_b): pairs of different keys, smaller first, whose texts look the same but aren't equal.

    Only digests of the forms and texts are shuffled. Forms with a single spelling drop out by an aggregate; the rest
    joins itself on the form, where Spark's skew join splits a form that many rows share. Case, accents, digits, raised
    digits, punctuation, line breaks and the number of blanks stay as they are. ``look_classes`` has the same without
    expanding pairs.
    """
    rows = spelled(records, key, text)
    several = rows.groupBy("form", "form2").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("form", "form2")
    rows = rows.join(several, ["form", "form2"], "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.form") == F.col("b.form")) & (F.col("a.form2") == F.col("b.form2"))
    return a.join(b, same).where("a.id < b.id and a.own <> b.own").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def look_classes(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, class, links): of each key whose text looks like others the least key of its class, and how many keys have it otherwise spelled.

    Counted by form and spelling, so a form that a third of all rows share is never joined with itself.
    """
    rows = spelled(records, key, text)
    by_own = rows.groupBy("form", "form2", "own").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    by_form = by_own.groupBy("form", "form2").agg(F.sum("n").alias("all"), F.min("least").alias("class"), F.count("*").alias("spellings")).where("spellings > 1")
    counted = by_own.join(by_form, ["form", "form2"]).select("form", "form2", "own", "class", (F.col("all") - F.col("n")).alias("links"))
    return rows.join(counted, ["form", "form2", "own"]).select("id", "class", "links")
