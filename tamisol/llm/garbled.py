"""Text decoded with the wrong character encoding: detection and repair.

A best-first search over texts: its moves re-encode the text in a legacy code page and decode it as what it may have been, or
undo escapes; visited texts are remembered by hash. A character-plausibility cost, plus a price per move, orders the queue, so
the first texts taken are the cheapest ones reachable.
"""

from __future__ import annotations

import heapq
import html
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages that UTF-8 bytes may have been read in.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859-2", "iso8859-15", "cp1253", "cp1256", "cp852", "cp866", "koi8_r", "iso8859-9", "mac_latin2", "cp1257"]
#: (read as, really) pairs of single-byte code pages.
SWAPPED = [("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1256"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp866", "cp1251"), ("cp1252", "cp866")]
MOVE, SWAP, UNESCAPE = 0.6, 1.5, 0.05
#: Price of a lost character, which no move brings back. Texts after which a search that hasn't ended is given up; ``complete`` then says so.
LOST, MAX_TEXTS = 1.5, 5_000
#: Price of a valid UTF-8 sequence of a fitting letter: above MOVE, so that the search begins and the move pays.
SEQUENCE = 0.9

_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_RUN = re.compile(r"[^\x00-\x7f]+")
_LONG_RUN = re.compile(r"[^\x00-\x7f]{3}")
_OUT = "Ā"
#: Words whose letter case is turned round, as KOI8-R read in another Cyrillic code page has it.
_INVERTED = re.compile(r"\b[а-яё][А-ЯЁ]{2,}\b")


@lru_cache(None)
def _to_bytes(codec: str) -> dict[int, str]:
    """For str.translate: characters to the byte (as a code point) they have in ``codec``; bytes without a character stand for themselves."""
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(ord(c), chr(b))
    return table


class _Bytes(dict):
    """Characters outside the code page become a mark that no UTF-8 sequence contains."""

    def __missing__(self, c: int) -> str:
        v = self[c] = chr(c) if c < 128 else _OUT
        return v


@lru_cache(None)
def _table(codec: str) -> _Bytes:
    return _Bytes(_to_bytes(codec))


@lru_cache(None)
def _shown(codec: str) -> re.Pattern:
    """What a UTF-8 sequence looks like in ``codec``."""
    shown = {ord(b): chr(c) for c, b in _to_bytes(codec).items()}
    group = lambda low, high: "[" + "".join(re.escape(shown[b]) for b in range(low, high + 1) if b in shown) + "]"
    follow = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{follow}|{group(0xE0, 0xEF)}{follow}{{2}}|{group(0xF0, 0xF4)}{follow}{{3}}")


def _as_utf8(text: str, codec: str) -> str | None:
    """Every UTF-8 sequence that ``codec``'s bytes of the text hold, decoded; the rest as it is. None if there is none."""
    if _shown(codec).search(text) is None:
        return None
    marked = text.translate(_table(codec))
    if len(marked) != len(text):
        return None
    out, at = [], 0
    for m in _SEQUENCE.finditer(marked):
        try:
            c = m[0].encode("latin-1").decode()
        except UnicodeDecodeError:
            continue
        out += [text[at : m.start()], c]
        at = m.end()
    return "".join([*out, text[at:]]) if out else None


def _swapped(text: str, read: str, really: str) -> str | None:
    """Runs outside ASCII of at least three characters, read in another single-byte code page; None if no run can be."""
    table, changed = _table(read), False

    def one(m: re.Match) -> str:
        nonlocal changed
        b = m[0].translate(table)
        if len(m[0]) < 3 or _OUT in b:
            return m[0]
        try:
            new = b.encode("latin-1").decode(really)
        except UnicodeDecodeError:
            return m[0]
        changed = True
        return new

    new = _RUN.sub(one, text)
    return new if changed and new != text else None


_SCRIPT: dict[str, str] = {}


def script(c: str) -> str:
    """The script of a letter by its Unicode name, without width and style."""
    s = _SCRIPT.get(c)
    if s is None:
        n = unicodedata.name(c, "?").split()
        s = _SCRIPT[c] = n[1] if n[0] in ("FULLWIDTH", "HALFWIDTH") and len(n) > 1 else "LATIN" if n[0] in ("MATHEMATICAL", "MICRO", "FEMININE", "MASCULINE") else n[0]
    return s


_CLASS: dict[str, tuple[str, float]] = {}


def _kind(c: str) -> tuple[str, float]:
    """(class, price) of a character outside ASCII."""
    k = _CLASS.get(c)
    if k is None:
        cat, cp = unicodedata.category(c), ord(c)
        if c == "�":
            k = ("lost", LOST)
        elif cp < 0xA0:
            k = ("symbol", 2.5)
        elif 0x2500 <= cp < 0x25A0:
            k = ("symbol", 2.5)
        elif c in "ªºµ" or cat in ("No", "Sm", "So", "Sc", "Sk", "Lm"):
            k = ("symbol", 1.6)
        elif cat in ("Pi", "Pf", "Pd", "Po", "Ps", "Pe", "Cf", "Zs"):
            k = ("mark", 0.9)
        elif cat[0] in "CN":
            k = ("symbol", 2.0)
        elif cat[0] == "M":
            k = ("accent", 0.1)
        else:
            k = ("letter", 0.02)
        _CLASS[c] = k
    return k


def _pairs(codec: str, leads: range) -> dict[str, str]:
    """Two characters that ``codec`` shows for the UTF-8 bytes of a Latin letter, and that letter."""
    shown = {ord(b): chr(c) for c, b in _to_bytes(codec).items()}
    found = ((shown.get(a), shown.get(b), bytes([a, b]).decode()) for a in leads for b in range(0x80, 0xC0))
    return {a + b: c for a, b, c in found if a and b and c.isalpha() and script(c) == "LATIN"}


@lru_cache(None)
def _sequences() -> dict[str, str]:
    """UTF-8 pairs of Latin letters with marks as Western and Central European code pages show them."""
    central = {k: v for codec in ("cp1250", "iso8859-2") for k, v in _pairs(codec, range(0xC3, 0xC6)).items()}
    western = {k: v for codec in ("latin-1", "cp1254", "cp1252") for k, v in _pairs(codec, range(0xC3, 0xC9)).items()}
    return central | western


def _valid(text: str, i: int) -> bool:
    """Whether the two characters at ``i`` are the UTF-8 bytes of a Latin letter that fits the letters around it."""
    letter = _sequences().get(text[i : i + 2])
    if letter is None:
        return False
    before, after = text[i - 1] if i else " ", text[i + 2 : i + 3] or " "
    if any(c.isalpha() and script(c) != "LATIN" for c in (before, after)):
        return False
    if letter.islower() and before.isupper() and (after.isupper() or i > 1 and text[i - 2].isupper()):
        return False  # a small letter among capitals
    mark = text[i + 1]
    # a real letter with a closing quote, or with a dash or blank between two words, is written so
    quote = mark in "”“’‘»›" and not after.isalpha() and any(c in text[:i] for c in "„“”‘’«»‹›")
    return not quote


def cost(text: str) -> float:
    """Implausibility of the characters of ``text`` beside one another, and of valid UTF-8 sequences; 0 for ASCII."""
    if text.isascii():
        return 0.0
    total, n = 0.0, len(text)
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        what, price = _kind(c)
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        if what == "letter":
            if c.isupper() and before.islower():
                price += 0.7
            b, a = before.isalpha() and before >= "\x80", after.isalpha() and after >= "\x80"
            s = script(c)
            if s == "LATIN" and b and a:
                price += 0.35
            if s != "LATIN" and (before.isalpha() and script(before) != s or after.isalpha() and script(after) != s):
                price += 0.3
            if s in ("CYRILLIC", "GREEK", "ARABIC") and c in "ЂЃЉЊЌЋЏђѓљњќћџҐґЎЈЅѕјў":
                price += 0.5
        elif what == "mark":
            if not (before.isalnum() or before >= "\x80") or not (after.isalnum() or after >= "\x80"):
                price *= 0.15
            elif c in "’‘ʼ-–‑·" or unicodedata.category(c) in ("Cf", "Zs"):
                price *= 0.3
        elif what == "symbol" and not (before.isalpha() or after.isalpha() or before >= "\x80" or after >= "\x80"):
            price *= 0.4
        total += price
    total += SEQUENCE * sum(c >= "\x80" and _valid(text, i) for i, c in enumerate(text))
    return total + 1.9 * len(_INVERTED.findall(text))


def _moves(text: str, most: float) -> Iterator[tuple[str, float, str]]:
    """(text, price, move) of every move that costs less than ``most``."""
    for codec in READ_AS if most > MOVE else ():
        if (new := _as_utf8(text, codec)) is not None and new != text:
            yield new, MOVE, f"utf-8 read as {codec}"
    for read, really in SWAPPED if most > SWAP and _LONG_RUN.search(text) else ():
        if (new := _swapped(text, read, really)) is not None:
            yield new, SWAP, f"{really} read as {read}"
    if "&" in text and (new := html.unescape(text)) != text:
        yield new, UNESCAPE, "unescape"
    if "\\u" in text:
        new = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        if new != text:
            yield new, UNESCAPE, "unescape"


_LATIN = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha() and script(chr(c)) == "LATIN"]
_ACCENTED = re.compile("[\\x00-\\x7f]*(?:(?:[{}]|(?<![a-z])[{}])(?:[\\x00-\\x7f]+|$))*".format("".join(c for c in _LATIN if c.islower()), "".join(c for c in _LATIN if c.isupper())))


def accented(text: str) -> bool:
    """Whether nothing but single Latin letters with marks stands among ASCII, where such letters stand; a short text of this kind never costs a move."""
    return len(text) < 2 * MOVE / 0.02 - 4 and "&" not in text and "\\" not in text and _ACCENTED.fullmatch(text) is not None


@lru_cache(60_000)
def searched(text: str) -> tuple[str, bool, bool]:
    """(the cheapest text reachable, whether the text was garbled, whether the search ended). Lost originals keep U+FFFD where nothing better is reachable.

    A text is left alone once no text behind it can be cheaper than the best one found: characters cost nothing at best, lost ones stay, and
    every move has its price. So the search ends by itself, with the cheapest text.
    """
    start = cost(text)
    escaped = "&" in text and html.unescape(text) != text or "\\u" in text
    if start < MOVE and not escaped:
        return text, False, True
    best, best_at, best_path = text, start, ()
    queue: list[tuple[float, int, str, tuple[str, ...], float]] = [(start, 0, text, (), 0.0)]
    seen, n = {hash(text)}, 0
    while queue and n < MAX_TEXTS:
        at, _, t, path, paid = heapq.heappop(queue)
        if at < best_at - 1e-9:
            best, best_at, best_path = t, at, path
        least = paid + LOST * t.count("\ufffd")
        if least + UNESCAPE >= best_at:
            continue
        for new, price, move in _moves(t, best_at - least):
            if (h := hash(new)) not in seen:
                seen.add(h)
                n += 1
                there = cost(new) + paid + price
                if there < best_at - 1e-9:
                    best, best_at, best_path = new, there, (*path, move)
                heapq.heappush(queue, (there, n, new, (*path, move), paid + price))
    decoded = any(m != "unescape" for m in best_path)
    lost = "\ufffd" in text or "ï¿½" in text
    if not decoded:
        best = text
    return best, decoded or lost, n < MAX_TEXTS


def repair(text: str) -> tuple[str, bool]:
    """(the cheapest text reachable, whether the text was garbled)."""
    return searched(text)[:2]


def names(texts: Iterable[str | None]) -> list[tuple[str | None, bool, bool]]:
    """``searched`` of each text; null and plain ASCII texts stay."""
    return [(t, False, True) if t is None or t.isascii() and "&" not in t and "\\u" not in t else searched(t) for t in texts]


def _walk(value, state: list[bool]):
    if isinstance(value, str):
        if value.isascii() and "&" not in value and "\\u" not in value:
            return value
        new, bad, ended = searched(value)
        state[:] = state[0] or bad, state[1] and ended
        return new if bad else value
    if isinstance(value, dict):
        return {k: _walk(v, state) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, state) for v in value]
    return value


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"?')


def _unquote(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), s)


def record(text: str | None) -> tuple[str | None, bool, bool]:
    """The same for the texts inside a JSON record; a record that isn't valid JSON is searched string by string."""
    if not text or text.isascii() and "\\u" not in text:
        return text, False, True
    try:
        value = json.loads(text)
        if isinstance(value, str):  # a record wrapped in a JSON string
            new, bad, ended = record(value)
            return json.dumps(new, ensure_ascii=False) if bad else text, bad, ended
    except (ValueError, RecursionError):
        out, at, bad, ended = [], 0, False, True
        for m in _STRING.finditer(text):
            if not m[1].isascii() or "\\u" in m[1]:
                new, wrong, done = searched(_unquote(m[1]))
                bad, ended = bad or wrong, ended and done
                if wrong:
                    out += [text[at : m.start(1)], new]
                    at = m.end(1)
        return "".join([*out, text[at:]]), bad, ended
    state = [False, True]
    new = _walk(value, state)
    return json.dumps(new, ensure_ascii=False) if state[0] else text, *state


def repaired(df: DataFrame, key: str, text: str, nested: str | None = None) -> DataFrame:
    """(key, field, original, restored, complete) for each garbled value of ``text``, and of the texts inside the JSON column ``nested``.

    Null, empty and ASCII values are never garbled; very long texts are read whole; repeated rows give repeated results. Only the
    named columns are read, so clashing extra columns do no harm. complete: false where the search was given up after MAX_TEXTS texts.
    """
    fields = [text, *([nested] if nested else [])]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            for i, field in enumerate(fields):
                rows = []
                for k, t in zip(keys, b.column(i + 1).to_pylist(), strict=True):
                    new, bad, ended = record(t) if field == nested else names([t])[0]
                    if bad or not ended:
                        rows.append((k, field, t, new, ended))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [b.column(0).type, pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["key", "field", "original", "restored", "complete"])

    kind = dict(df.dtypes)[key]
    suspect = F.col(text).rlike(r"[^\x00-\x7F]|&|\\u")
    if nested:
        suspect |= F.col(nested).rlike(r"[^\x00-\x7F]|\\u")
    return df.select(key, *fields).filter(suspect).mapInArrow(scan, f"key {kind}, field string, original string, restored string, complete boolean").withColumnRenamed("key", key)
