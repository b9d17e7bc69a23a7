"""Names that look right but are built from other characters: one consistent form for all.

Look-alike classes are computed by union-find over strings and code points: compatibility forms with their plain text,
base-and-accent sequences with the combined letter, invisible characters with the empty string, spaces with the ordinary one,
and letters of different scripts that look the same. Each class is written with its most frequent member, for letters the most
frequent one of the script wanted, and a multi-pattern automaton rewrites texts greedily, longest match first.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamisol.llm import garbled

# Letters that look alike, Latin first, then Cyrillic, Greek, Armenian and Cherokee.
SAME_SHAPE = """
A А Α|B В Β|C С|E Е Ε|H Н Η|I І Ι|J Ј|K К Κ|M М Μ|N Ν|O О Ο|P Р Ρ|S Ѕ|T Т Τ|X Х Χ|Y У Υ|Z Ζ|a а α|c с|e е|i і ι|j ј|k к κ|o о ο|p р ρ|s ѕ
v ν|x х χ|y у γ|u υ|h һ|d ԁ|q ԛ|w ԝ|n п|r г|Ï Ї|ï ї|Ë Ё|ë ё|ō ӧ|g ɡ|l ӏ|İ Ӏ|m м|t т|b Ь|n η
A Ꭺ|B Ᏼ|C Ϲ Ꮯ|D Ꭰ|E Ꭼ|G Ԍ Ꮐ|H Ꮋ|J Ϳ Ꭻ|K Ꮶ|L Լ Ꮮ|M Ꮇ|O Օ|P Ꮲ|Q Ԛ|R Ꭱ|S Տ Ꮪ|T Ꭲ|U Ս|V Ѵ Ꮩ|W Ԝ Ꮃ|Y Ү Ꮍ|Z Ꮓ|I Ӏ
c ϲ|f ք|g ց|h հ|i Ꭵ|j ϳ յ|n ո|o օ|q զ|u ս|v ѵ|w ω|y ү|g ԍ
"""
#: What a character class contributes to the reasons for a rewrite.
COMPATIBILITY, ACCENT, INVISIBLE, SPACE, MIXED = "compatibility", "accent", "invisible", "space", "mixed"

_WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
_EAST = {"HIRAGANA", "KATAKANA", "CJK", "HANGUL", "BOPOMOFO"}


def script(c: str) -> str:
    s = garbled.script(c)
    return "EAST" if s in _EAST else s


def invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or c in "͏ᅟᅠ឴឵ㅤﾠ"


class UnionFind:
    """Disjoint sets of strings, with path halving; roots are the smallest members, so that results don't depend on order."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: str, y: str) -> None:
        a, b = sorted((self.find(x), self.find(y)))
        self.up[b] = a

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return {k: sorted(v) for k, v in out.items()}


def compatibility(c: str) -> str | None:
    """The plain text of a compatibility form of a letter, digit or full-width mark; None for other characters and ordinary punctuation."""
    plain = unicodedata.normalize("NFKC", c)
    if plain == unicodedata.normalize("NFC", c):
        # an other code point for the same letter, such as the Kelvin sign
        return plain if plain != c and len(c) == 1 else None
    wide = "＀" <= c <= "￯" or unicodedata.category(c)[0] in "LNM"
    return plain if wide else None


def _automaton(patterns: Iterable[tuple[str, tuple[int, str, str]]]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for pattern, value in patterns:
        made.add_word(pattern, value)
    if not len(made):
        return None
    made.make_automaton()
    return made


def _rewritten(text: str, automaton: ahocorasick.Automaton | None, why: set[str]) -> str:
    """The text with every pattern of the automaton written as its target, longest match first; the kinds of what was found join ``why``."""
    if automaton is None:
        return text
    out, at = [], 0
    for end, (n, target, kind) in automaton.iter_long(text):
        out += [text[at : end - n + 1], target]
        at = end + 1
        why.add(kind)
    return "".join([*out, text[at:]])


class Rewriter:
    """Classes, representatives and automata for texts whose characters occur as often as ``counts`` says."""

    def __init__(self, counts: dict[str, int]):
        seen = {c for c in counts if c > "\x7f"}
        marks = {c for c in seen if unicodedata.category(c) == "Mn"}
        shapes, plain = UnionFind(), UnionFind()
        self.kinds: dict[str, str] = {}
        for group in SAME_SHAPE.replace("\n", "|").strip("|").split("|"):
            first, *rest = group.split()
            for x in rest:
                shapes.union(first, x)
        for c in sorted(seen):
            if invisible(c):
                plain.union(c, "")
                self.kinds[c] = INVISIBLE
            elif unicodedata.category(c) == "Zs":
                plain.union(c, " ")
                self.kinds[c] = SPACE
            elif (p := compatibility(c)) is not None:
                plain.union(c, p)
                shapes.union(c, p)
                self.kinds[c] = COMPATIBILITY
        if marks:
            for cp in range(0xC0, 0x2000):
                whole = chr(cp)
                parts = unicodedata.normalize("NFD", whole)
                if len(parts) > 1 and marks & set(parts) and unicodedata.normalize("NFC", parts) == whole:
                    for written in {parts, unicodedata.normalize("NFC", parts[:-1]) + parts[-1]}:
                        plain.union(written, whole)
                        self.kinds[written] = ACCENT
        weight = lambda s: (-counts.get(s, 0) if len(s) == 1 else 0, s in self.kinds, len(s), s)
        self.classes = shapes.classes()
        #: pattern -> what it is written as, whatever stands beside it
        self.plain: dict[str, str] = {}
        for members in plain.classes().values():
            # a class that can be left out or that has a member outside ``kinds`` is written with the most frequent such member
            free = [m for m in members if m not in self.kinds] or members
            best = "" if "" in members else " " if " " in members else min(free, key=weight)
            self.plain.update({m: best for m in members if m in self.kinds})
        #: letter -> script -> the class's most frequent letter of that script
        self.by_script: dict[str, dict[str, str]] = {}
        for members in self.classes.values():
            best: dict[str, str] = {}
            for m in sorted((m for m in members if len(m) == 1 and m not in self.kinds), key=weight):
                best.setdefault(script(m), m)
            for m in members:
                if len(m) == 1:
                    self.by_script[m] = best
        self.automaton = _automaton((p, (len(p), target, self.kinds[p])) for p, target in self.plain.items())
        #: script -> automaton that writes look-alike letters of other scripts with the representatives of their classes in it
        scripts = {s for best in self.by_script.values() for s in best}
        self.shapes = {s: _automaton((c, (len(c), best[s], MIXED)) for c, best in self.by_script.items() if s in best and script(c) != s) for s in scripts}

    def _word(self, m: re.Match, why: set[str]) -> str:
        word = m[0]
        if word.isascii():
            return word
        letters = [c for c in word if unicodedata.category(c) in ("Ll", "Lu", "Lt", "Lo")]
        scripts = Counter(map(script, letters))
        if len(scripts) < 2:
            return word
        why.add(MIXED)
        # the script most letters can be written in; of equals the one with more letters there already, then Latin
        fits = lambda s: sum(script(c) == s or s in self.by_script.get(c, {}) for c in letters)
        to = max(sorted(scripts), key=lambda s: (fits(s), scripts[s], s == "LATIN"))
        return _rewritten(word, self.shapes.get(to), why)

    def rewrite(self, text: str) -> tuple[str, set[str]]:
        """(the consistent form, why it differs)."""
        if text.isascii():
            return text, set()
        why: set[str] = set()
        text = _rewritten(text, self.automaton, why)
        composed = unicodedata.normalize("NFC", text)
        if composed != text:
            why.add(ACCENT)
        return _WORD.sub(lambda m: self._word(m, why), composed), why


def character_counts(texts: DataFrame) -> dict[str, int]:
    """How often each code point occurs in the only column of ``texts``; at most as many rows reach the driver as Unicode has code points."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            total.update("".join(t for t in b.column(0).to_pylist() if t))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["c", "n"])

    found = texts.mapInArrow(scan, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {r.c: r.n for r in found.collect()}


def _unspoiled(text: str) -> tuple[str, bool]:
    """The text as it was before a wrong decoding, and whether damage is left."""
    new, bad, _ = garbled.names([text])[0]
    return new, bad and garbled.cost(new) > garbled.MOVE


def canonical(df: DataFrame, key: str, text: str, counts: dict[str, int] | None = None) -> DataFrame:
    """(key, canonical, reasons) for every row of ``df``; reasons is a sorted array, empty where nothing was rewritten.

    Texts garbled by a wrong encoding are restored first, so that their leftovers don't count as look-alikes. A null text gives a null
    form, '' stays ''; very long texts are rewritten whole; ties between representatives go to the lower code point; extra columns are
    ignored. ``counts``: character counts of a wider corpus, else those of ``df``.
    """
    rewriter_counts = character_counts(df.select(text)) if counts is None else counts
    made: list[Rewriter] = []

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Rewriter(rewriter_counts))
        for b in batches:
            forms, reasons = [], []
            for t in b.column(1).to_pylist():
                if t is None or t.isascii():
                    forms.append(t)
                    reasons.append([])
                    continue
                t, damaged = _unspoiled(t)
                form, why = made[0].rewrite(t)
                forms.append(form)
                # what a wrong decoding leaves behind looks like compatibility forms and invisible characters below U+0180
                reasons.append(sorted(why if not damaged else made[0].rewrite("".join(c for c in t if not "\x80" <= c < "ƀ"))[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array(reasons, pa.list_(pa.string()))], ["key", "canonical", "reasons"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, f"key {kind}, canonical string, reasons array<string>")


def canonical_names(sanctions: DataFrame, kyc: DataFrame) -> DataFrame:
    """(table_name, row_key, canonical, reasons) of the names of both tables, written with the same representatives."""
    rows = sanctions.select(F.concat(F.lit("sanctions\u0001"), F.col("id").cast("string")).alias("k"), F.col("full_name").alias("t")).unionByName(
        kyc.select(F.concat(F.lit("customer_kyc\u0001"), F.col("customer_id")).alias("k"), F.col("full_name").alias("t"))
    )
    parts = F.split("key", "\u0001", 2)
    return canonical(rows, "k", "t").select(parts[0].alias("table_name"), parts[1].alias("row_key"), "canonical", "reasons")


def found(sanctions: DataFrame, kyc: DataFrame) -> DataFrame:
    rows = canonical_names(sanctions, kyc)
    return rows.filter(F.size("reasons") > 0).select("table_name", "row_key")
