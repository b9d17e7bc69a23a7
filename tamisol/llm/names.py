"""What spellings of one name have in common: Latin letters, sound classes, words without titles, and a comparison of two names."""

from __future__ import annotations

import gc
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamisol.llm import garbled, lookalikes

# Latin spellings of letters that don't decompose.
_LATIN = {"ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "þ": "th", "ð": "d", "ħ": "h", "ŋ": "n", "ə": "a"}
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфыэіѓґ", "abvgdeziyklmnoprstufyeigg", strict=True)) | {
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "ё": "yo", "є": "ye", "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "ђ": "dj", "џ": "dz", "ў": "u",
}
_ARABIC = dict(zip("ابتجحدرزسصضطظعفقكلمنهويىةپگچژکی", "abtjhdrzssdtzafqklmnhuiaapgxjki", strict=True)) | {"ث": "th", "خ": "kh", "ذ": "z", "ش": "sh", "غ": "gh", "ء": "", "أ": "a", "إ": "i", "آ": "a", "ؤ": "u", "ئ": "i", "چ": "ch", "ژ": "zh"}
_TABLE = str.maketrans(_LATIN | _CYRILLIC | _ARABIC)

# Titles, particles, legal forms with their short forms, and frequent short forms of business words.
TITLES = frozenset("mr mrs ms miss dr shri smt sheikh shaikh sheik sir prof hon messrs mister madame mme herr frau sri haji hajji capt col sayyid".split())
PARTICLES = frozenset("al el il all ell ul bin ibn bint ben b de del la las los da dos das du van von der den di le the of and y e et und".split())
LEFT_OUT = TITLES | PARTICLES
LEGAL = {
    w: form
    for form, words in {
        "limited": "limited ltd lmtd ltda lim", "private": "private pvt priv prvt", "corporation": "corporation corp corpn", "company": "company co coy comp", "holding": "holding holdings hldg hldgs hold", "establishment": "establishment estab est establ",
        "group": "group grp gr", "sons": "sons son", "foundation": "fundacion foundation fund fundn", "societe": "societe soc ste", "llc": "llc", "gmbh": "gmbh", "ooo": "ooo", "jsc": "jsc", "fze": "fze", "sa": "sa", "as": "as", "plc": "plc", "inc": "inc incorporated",
    }.items()
    for w in words.split()
}
BUSINESS = frozenset("global eastern united general northern international industrial national textiles logistics optics telecom agro foundry freight exchange commodities maritime investment mining steel timber engineering aviation pharma shipping electronics trading petrochemical energy construction clearing house southern western central".split())
# Familiar forms of given names.
NICKNAMES = {
    n: g
    for g, many in {
        "alejandro": "ale", "aleksandr": "sasha", "alexander": "sasha alex", "anatoly": "tolya", "antonio": "toninho", "deepak": "deepu", "dmitri": "dima mitya", "dolores": "lola", "ekaterina": "katya", "fatima": "fattoum", "francisco": "paco pancho", "galina": "galya",
        "grigory": "grisha", "guadalupe": "lupe", "ibrahim": "barhoum", "irina": "ira", "johannes": "hannes", "jose": "pepe", "kamran": "kami", "khalid": "khaloud", "krishnan": "kichu", "mikhail": "misha", "natalia": "natasha", "parisa": "pari", "pavel": "pasha",
        "rosario": "charo", "sergei": "seryozha", "valentina": "valya", "venkatesh": "venky", "vladimir": "vova volodya", "yevgeny": "zhenya", "behrouz": "behi", "sanjay": "sanju", "ivan": "vanya", "konstantin": "kostya", "nikolai": "kolya", "fyodor": "fedya", "ludmila": "lyuda", "svetlana": "sveta",
        "william": "bill billy will", "robert": "bob bobby rob", "richard": "dick rick", "james": "jim jimmy", "john": "jack johnny", "thomas": "tom tommy", "michael": "mike mick", "joseph": "joe", "charles": "charlie chuck", "edward": "ed ted eddie",
        "henry": "harry hank", "anthony": "tony", "andrew": "andy drew", "daniel": "dan danny", "david": "dave", "samuel": "sam", "christopher": "chris", "nicholas": "nick", "stephen": "steve", "peter": "pete", "frederick": "fred", "lawrence": "larry",
        "matthew": "matt", "philip": "phil", "ronald": "ron", "donald": "don", "kenneth": "ken", "gerald": "gerry jerry", "francis": "frank", "elizabeth": "liz beth betty", "margaret": "maggie peggy meg", "katherine": "kate kathy", "patricia": "pat trish",
        "jennifer": "jen jenny", "susan": "sue", "barbara": "barb", "dorothy": "dot", "manuel": "manolo", "ignacio": "nacho", "enrique": "quique", "mercedes": "merche", "consuelo": "chelo", "heinrich": "heinz", "friedrich": "fritz", "wilhelm": "willi",
        "johann": "hans", "giuseppe": "beppe", "giovanni": "gianni", "luigi": "gigi", "anna": "anya", "maria": "masha", "elena": "lena", "olga": "olya", "tatiana": "tanya", "pyotr": "petya", "mehmet": "memo", "rajendra": "raju", "mohammed": "hamoudi",
    }.items()
    for n in many.split()
}

_WORDS = re.compile(r"[a-z0-9]+")
_INITIALS = re.compile(r"(?<![^\W\d_])([^\W\d_])\.(?=[^\W\d_](?![^\W\d_]))")
_SIMPLE = re.compile(r"[A-Za-z0-9 ,-]*(?:\.(?=[ ,]|$)[A-Za-z0-9 ,-]*)*")
_OTHER_NAME, _MESSRS = re.compile(r"\s*[(@]\s*"), re.compile(r"\bM/s\b", re.IGNORECASE)
_APOSTROPHES = re.compile(r"['’`ʼʻ]")


def quiet() -> None:
    """Let Python look for cycles less often: its search goes through all that the caches of a worker hold, and nothing here makes cycles."""
    gc.set_threshold(1_000_000, 50, 1_000)


def latin(text: str) -> str:
    """Lower-case Latin letters without accents; Cyrillic and Arabic are transliterated, other scripts stay."""
    if text.isascii():
        return text.lower()
    return text.lower().translate(_LETTERS)


class _Without(dict):
    """For str.translate: characters that ``drop`` names vanish; each character is decided once."""

    def __init__(self, drop):
        super().__init__()
        self.drop = drop

    def __missing__(self, c: int):
        self[c] = None if self.drop(chr(c)) else c
        return self[c]


_UNACCENTED = _Without(unicodedata.combining)


class _Latin(dict):
    """For str.translate: what is written for a small letter; each is decided once."""

    def __missing__(self, c: int) -> str:
        self[c] = unicodedata.normalize("NFKD", chr(c).translate(_TABLE)).translate(_TABLE).translate(_UNACCENTED)
        return self[c]


_LETTERS = _Latin()
_VISIBLE = _Without(lambda c: lookalikes.invisible(c) or c == "\ufffd")


_I, _E, _U, _K, _Y = (re.compile(x) for x in ("ee|ei|ie", "ae|oe(?=.)", "ue(?=.)", "ck|q|c(?!h)", "y|j(?=[^aeiou]|$)"))

_SILENT = str.maketrans("", "", "aeiouyhw")


def _single(text: str) -> str:
    """The text with every run of one letter written once; for short texts faster than a regular expression."""
    last, out = "", []
    for c in text:
        if c != last:
            out.append(c)
            last = c
    return "".join(out) if len(out) < len(text) else text


@lru_cache(200_000)
def skeleton(word: str) -> str:
    """The consonant classes of a Latin word, with a mark for a vowel in front: what is left by most misspellings and by scripts without vowels."""
    if len(word) >= 8 and word[:2] in ("al", "el"):
        word = word[2:]
    if "h" in word:
        word = word.replace("shch", "x").replace("sch", "x").replace("sh", "x").replace("tch", "x").replace("ch", "x")
        word = word.replace("kh", "k").replace("gh", "g").replace("ph", "f").replace("th", "t").replace("zh", "j")
    word = word.replace("ck", "k").replace("c", "k").replace("q", "k").replace("v", "f").replace("dj", "j")
    first = word[:1]
    return _single(("a" if first and first in "aeiouyhw" else first) + word[1:].translate(_SILENT))


@lru_cache(200_000)
def spelling(word: str) -> str:
    """The word in one of its usual spellings: long vowels, doubled letters, f for ph and the like."""
    if len(word) >= 8 and word[:2] in ("al", "el"):
        word = word[2:]
    if "ch" in word:
        word = word.replace("sch", "sh").replace("tch", "ch")
    if "e" in word:
        if "ee" in word or "ei" in word or "ie" in word:
            word = _I.sub("i", word)
        word = word.replace("oo", "u").replace("ou", "u")
        if "ae" in word or "oe" in word:
            word = _E.sub("e", word)
        if "ue" in word:
            word = _U.sub("u", word)
    else:
        word = word.replace("oo", "u").replace("ou", "u")
    word = word.replace("ph", "f").replace("w", "v")
    if "c" in word or "q" in word:
        word = _K.sub("k", word)
    if "y" in word or "j" in word:
        word = _Y.sub("i", word)
    return _single(word)


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, a metric."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        before = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), before
            if x == y:
                before = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b; more than ``most`` come out as most + 1. Up to 1 it equals ``distance``."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    short = min(n, m)
    i = 0
    while i < short and a[i] == b[i]:
        i += 1
    while short > i and a[n - 1] == b[m - 1]:
        n, m, short = n - 1, m - 1, short - 1
    n, m = n - i, m - i
    if not n or not m or most <= 0:
        return min(most + 1, n or m)
    if most == 1:
        return 1 if n == m == 1 or n == m == 2 and a[i] == b[i + 1] and a[i + 1] == b[i] else 2
    a, b = a[i : i + n], b[i : i + m]
    best = edits(a[1:], b[1:], most - 1)
    if n >= m - 1:
        best = min(best, edits(a[1:], b, most - 1))
    if m >= n - 1:
        best = min(best, edits(a, b[1:], most - 1))
    if n > 1 and m > 1 and a[0] == b[1] and a[1] == b[0]:
        best = min(best, edits(a[2:], b[2:], most - 1))
    return best + 1


def clean(text: str) -> str:
    """The text restored from a wrong encoding, with look-alikes and compatibility forms written plainly."""
    if text.isascii() or garbled.accented(text):
        return text
    t = unicodedata.normalize("NFKC", garbled.repair(text)[0].translate(_VISIBLE))
    return _WORD.sub(_one_script, t) if _BEYOND_LATIN.search(t) else t


_BEYOND_LATIN = re.compile("[\u0370-\u1dff]")
_WORD = re.compile(r"[^\W\d_]+")
_TO_LATIN = {x: g.split()[0] for g in lookalikes.SAME_SHAPE.replace("\n", "|").strip("|").split("|") for x in g.split()[1:]}


def _one_script(m: re.Match) -> str:
    w = m[0]
    if w.isascii():
        return w
    scripts = {lookalikes.script(c) for c in w}
    return "".join(_TO_LATIN.get(c, c) if lookalikes.script(c) != "LATIN" else c for c in w) if len(scripts) > 1 and "LATIN" in scripts else w


@lru_cache(100_000)
def parts(text: str) -> tuple[tuple[str, ...], ...]:
    """The words of each of the names that ``text`` gives, the first one first: in brackets or after @ stand others. Titles and particles are left out."""
    if _SIMPLE.fullmatch(text):
        words = text.lower().replace(",", " ").replace("-", " ").replace(".", " ").split()
        kept = [w for w in words if w not in LEFT_OUT] or [w for w in words if w not in TITLES] or words
        return (tuple(kept),) if kept else ()
    t = clean(text)
    pieces = _OTHER_NAME.split(t.replace(")", " ")) if "(" in t or "@" in t else [t]
    if len(pieces) > 1 and not pieces[0].strip(" ,.-_\t\n'\""):
        pieces = pieces[1:]
    out = []
    for p in pieces:
        if "." in p:
            p = _INITIALS.sub(r"\1", p)
        if "/" in p:
            p = _MESSRS.sub(" ", p)
        words = _WORDS.findall(latin(_APOSTROPHES.sub("", p)))
        kept = [w for w in words if w not in LEFT_OUT]
        out.append(tuple(kept or [w for w in words if w not in TITLES] or words))
    return tuple(w for w in out if w)


def packed(text: str | None) -> str:
    """``parts`` as one string: words divided by blanks, names by bars; '' where there is none."""
    return "|".join([" ".join(w) for w in parts(text)]) if text else ""


class _Bits(dict):
    def __missing__(self, c: str) -> int:
        b = self[c] = 1 << (ord(c) & 63)
        return b


_BIT = _Bits()


def _letters(text: str) -> int:
    """The characters of a text as bits; one edit changes two of them at most."""
    bits = 0
    for c in text:
        bits |= _BIT[c]
    return bits


_CONSONANTS = ~_letters("a")


class Word:
    """One word, ready to be compared: spelling, skeleton, the characters of each, its beginning, and the given name that it is a form of."""

    __slots__ = ("begins", "bits", "classes", "consonants", "formal", "many", "one", "sound", "spelled", "text", "trade")

    def __init__(self, text: str):
        self.text, self.spelled, self.sound = text, spelling(text), skeleton(text)
        self.bits, self.classes = _letters(self.spelled), _letters(self.sound)
        vowel = self.sound[:1] == "a"
        self.consonants, self.many = self.classes & _CONSONANTS if vowel else self.classes, len(self.sound) - vowel
        self.begins, self.one, self.formal = text[:2], len(text) == 1, NICKNAMES.get(text, text)
        self.trade = text in LEGAL or text in BUSINESS


word = lru_cache(200_000)(Word)


def _totals(words: list[Word]) -> tuple[int, int, int]:
    """What words hold together: the number of consonants, consonant classes, and characters."""
    many = consonants = bits = 0
    for w in words:
        many += w.many
        consonants |= w.consonants
        bits |= w.bits
    return many, consonants, bits


def _run_together(words: list[Word]) -> tuple[str, str]:
    """Skeleton and spelling of words written as one."""
    text = "".join([w.text for w in words])
    return skeleton.__wrapped__(text), spelling.__wrapped__(text)


class Words(list):
    """Words in order, with their texts, whether all of these differ, and their totals."""

    __slots__ = ("_joined", "differ", "texts", "totals")

    def __init__(self, words: Iterable[Word]):
        super().__init__(words)
        self.texts = {w.text for w in self}
        self.differ = len(self.texts) == len(self)
        self.totals = _totals(self)
        self._joined: tuple[str, str] | None = None

    @property
    def joined(self) -> tuple[str, str]:
        if self._joined is None:
            self._joined = _run_together(self)
        return self._joined


class Name:
    """One packed name, ready to be compared."""

    __slots__ = ("_own", "alternatives", "business", "legal", "words")

    def __init__(self, text: str):
        first, *rest = text.split("|")
        self.words = Words([word(w) for w in first.split(" ") if w])
        self.alternatives = [Words([word(w) for w in r.split(" ") if w]) for r in rest]
        self.business = any([w.trade for w in self.words[1:]]) or len(self.words) > 1 and self.words[0].text in BUSINESS
        self.legal = {LEGAL[w.text] for w in self.words if w.text in LEGAL} if self.business else set()
        self._own: Words | None = None

    @property
    def own(self) -> Words:
        """The words without legal forms."""
        if self._own is None:
            own = [w for w in self.words if w.text not in LEGAL]
            self._own = Words(own) if len(own) < len(self.words) else self.words
        return self._own


@lru_cache(60_000)
def name(text: str) -> Name:
    return Name(text)


def likeness(a: Word, b: Word) -> float:
    """Likeness of two words of names, from 0 to 1; below 0.6 they are different words."""
    if a.text == b.text:
        return 1.0
    if a.one or b.one:
        return 0.7 if a.text[0] == b.text[0] else 0.0
    if a.formal == b.formal:
        return 0.9
    x, y, s, t = a.spelled, b.spelled, a.sound, b.sound
    if x == y:
        return 0.97
    short = min(len(x), len(y))
    most = 1 if short <= 5 else 2
    e = edits(x, y, most) if short >= 3 and (a.bits ^ b.bits).bit_count() <= 2 * most else most + 1
    if s == t and len(s) >= 4:  # only vowels differ
        return 0.95 - 0.03 * e if e <= most else 0.88
    if e <= most:
        return 0.95 - 0.07 * e if short > 4 else 0.7
    if s == t and len(s) == 3:
        return 0.8
    if len(s) >= 5 and len(t) >= 5 and (a.classes ^ b.classes).bit_count() <= 2 and edits(s, t, 1) <= 1:
        return 0.75
    if a.begins == b.begins:  # familiar forms
        n, m = len(a.text), len(b.text)
        if abs(n - m) <= 5 and (min(n, m) <= 4 or min(n, m) <= 6 and a.text[2] == b.text[2]):
            return 0.62
    return 0.0


def word_score(a: str, b: str) -> float:
    return likeness(word(a), word(b))


def _pair_words(a: Words, b: Words) -> tuple[list[tuple[Word, Word, float]], list[Word], list[Word]]:
    """Words put in pairs by likeness, best first, and what is left on either side."""
    got: list[tuple[Word, Word, float]] = []
    if (same := a.texts & b.texts) and a.differ and b.differ:  # the same words come first whatever the others are
        got = [(x, x, 1.0) for x in a if x.text in same]
        if len(same) == len(a) or len(same) == len(b):
            return got, [x for x in a if x.text not in same], [y for y in b if y.text not in same]
        left, right = [(i, x) for i, x in enumerate(a) if x.text not in same], [(j, y) for j, y in enumerate(b) if y.text not in same]
    else:
        left, right = list(enumerate(a)), list(enumerate(b))
    scored = []
    for i, x in left:
        bits, classes = x.bits, x.classes
        for j, y in right:
            # most pairs of words have nothing in common that ``likeness`` could find
            if (bits ^ y.bits).bit_count() > 4 and (classes ^ y.classes).bit_count() > 2 and x.begins != y.begins and x.formal != y.formal and not x.one and not y.one:
                continue
            s = likeness(x, y)
            if s >= 0.6:
                scored.append((s, -abs(i - j), i, j))
    if not scored:
        return got, [x for _, x in left], [y for _, y in right]
    if len(scored) > 1:
        scored.sort(reverse=True)
    used_a: set[int] = set()
    used_b: set[int] = set()
    for s, _, i, j in scored:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            got.append((a[i], b[j], s))
    return got, [x for i, x in left if i not in used_a], [y for j, y in right if j not in used_b]


#: Consonant classes by which two divisions of one text may differ: edits, and what is lost or made where words meet.
SEAM = 4


def _glued(rest_a: list[Word], rest_b: list[Word]) -> bool:
    """What is left on both sides is the same text divided differently."""
    if not rest_a or not rest_b:
        return False
    if len(rest_a) == len(rest_b) == 1:
        return likeness(rest_a[0], rest_b[0]) >= 0.8
    many, consonants, bits = rest_a.totals if isinstance(rest_a, Words) else _totals(rest_a)
    of_b = rest_b.totals if isinstance(rest_b, Words) else _totals(rest_b)
    if not -SEAM < many - of_b[0] < SEAM or (consonants ^ of_b[1]).bit_count() > SEAM or (bits ^ of_b[2]).bit_count() > SEAM + 2:
        return False
    (s, a), (t, b) = (r.joined if isinstance(r, Words) else _run_together(r) for r in (rest_a, rest_b))
    if len(s) >= 3 and s == t:
        return True
    short = min(len(a), len(b))
    most = 1 if short <= 5 else 2
    return a == b or short > 4 and edits(a, b, most) <= most


def _abbreviates(a: str, b: str) -> bool:
    """a is a short form of b: a prefix of it, or some of its letters in order, with its first one."""
    if len(a) >= len(b) or len(a) < 2 or a[0] != b[0]:
        return False
    at = iter(b)
    return all(c in at for c in a)


def _business_score(a: Name, b: Name) -> float:
    got, rx, ry = _pair_words(a.own, b.own)
    core = [s for p, q, s in got if p.text not in BUSINESS and q.text not in BUSINESS and not p.one and not q.one]
    if not core and not _glued([w for w in rx if w.text not in BUSINESS], [w for w in ry if w.text not in BUSINESS]):
        return 0.0
    for p in list(rx):
        for q in list(ry):
            if _abbreviates(p.text, q.text) or _abbreviates(q.text, p.text):
                rx.remove(p)
                ry.remove(q)
                break
    for legal, rest in ((b.legal, rx), (a.legal, ry)):  # short legal forms that aren't listed
        for p in list(rest):
            if any(_abbreviates(p.text, q) for q in legal):
                rest.remove(p)
    if rx and ry:
        if not _glued(rx, ry):
            return 0.0
        rx, ry = [], []
    score = (min(core) if core else 0.8) - 0.15 * (len(rx) + len(ry))
    if a.legal and b.legal and not a.legal & b.legal:
        score -= 0.3
    return score


def _person_score(x: Words, y: Words) -> float:
    """At least one full word must agree; of the rest, each side's words are in the other's, up to initials and left-out middle names."""
    if unequal := len(x) != len(y):
        if _glued(x, y):
            return 0.85
    got, rx, ry = _pair_words(x, y)
    if rx:  # initials of particles
        rx = [w for w in rx if w.text != "i" and w.text != "d"]
    if ry:
        ry = [w for w in ry if w.text != "i" and w.text != "d"]
    full = [s for p, q, s in got if not p.one and not q.one]
    if rx and ry:
        # one word left on either side: they would be a pair if they were alike
        if (full or got) and len(rx) + len(ry) > 2 and _glued(rx, ry):
            rx, ry, full = [], [], [*full, 0.8]
        elif not unequal and _glued(x, y):
            rx, ry, full = [], [], [0.8]
        else:
            return 0.0
    if not full:
        return 0.8 if not unequal and _glued(x, y) else 0.0
    initials = len(got) - len(full)
    long = max((len(p.text) for p, q, s in got if not q.one), default=0)
    if len(full) == 1 and not initials and len(x) + len(y) > 2:
        return 0.5 if long >= 5 else 0.3
    low = min(full)
    if low < 0.65 and (len(full) < 2 or max(full) < 0.9):
        return 0.0
    return low - 0.04 * initials - 0.05 * (len(rx) + len(ry)) if low >= 0.6 else 0.0


def score(a: str, b: str) -> float:
    """Likeness of two packed names, from 0 to 1; people by given and family names, organisations by what sets them apart."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    p, q = name(a), name(b)
    best = _business_score(p, q) if p.business and q.business else 0.0 if p.business != q.business and len(p.words) > 1 and len(q.words) > 1 and min(len(p.words), len(q.words)) > 2 else _person_score(p.words, q.words)
    if p.business != q.business:
        best = max(best, _business_score(p, q))
    for alt in p.alternatives:
        best = max(best, _person_score(alt, q.words) if len(alt) > 1 else _person_score(Words([*alt, *p.words[-1:]]), q.words))
    for alt in q.alternatives:
        best = max(best, _person_score(p.words, alt) if len(alt) > 1 else _person_score(p.words, Words([*alt, *q.words[-1:]])))
    return max(0.0, min(1.0, best))


def with_packed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``packed``, made from the column ``text``."""
    at = df.columns.index(text)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([packed(t) for t in b.column(at).to_pylist()], pa.string())], [*b.schema.names, "packed"])

    return df.mapInArrow(scan, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", packed string")


class _Spellings(dict):
    """The spelling of each word, '' for one letter."""

    def __missing__(self, w: str) -> str:
        if len(self) >= 200_000:
            self.clear()
        self[w] = s = spelling(w) if len(w) > 1 else ""
        return s


def word_counts(packed_names: DataFrame, rows: int) -> dict[str, int]:
    """Spellings of words that occur in many of the ``rows`` names in the column packed, with their counts.

    Only words in at least one of 5,000 names come to the driver: as a name has a few words, that is some twenty thousand at most, whatever the size.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet()
        total: Counter[str] = Counter()
        spelled = _Spellings().__getitem__
        for b in batches:
            found: list[str] = []
            for p in b.column(0).to_pylist():
                found += set(map(spelled, p.partition("|")[0].split(" ")))
            total.update(found)
            total.pop("", None)
            if len(total) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["k", "n"])
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["k", "n"])

    counts = packed_names.select("packed").mapInArrow(scan, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {r.k: r.n for r in counts.filter(F.col("n") >= max(3, rows / 5000)).collect()}
