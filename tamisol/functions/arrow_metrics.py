"""Similarities that built-ins can't express: plain functions on names, and Arrow functions on columns of pairs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache
from math import sqrt

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

def _word(name: str | None) -> str:
    return re.sub("[^A-Za-z]+", "", name or "").upper()


def _rewriting(rules: str, special: Callable[[re.Match], str] | None = None) -> Callable[[str], str]:
    """A function that rewrites a word in one pass by rules ``pattern -> code``, one a line, the first that fits at each place; other letters stay.

    Patterns see the word as it was, whatever has been written for the letters before. The code * stands for what ``special`` makes of a match.
    """
    pairs = [[x.strip() for x in line.split("->")] for line in rules.strip().split("\n")]
    pattern = re.compile("|".join(f"({p})" for p, _ in pairs))
    codes = [special if code == "*" else (lambda m, code=code: code) for _, code in pairs]
    return lambda word: pattern.sub(lambda m: codes[m.lastindex - 1](m), word)


# How a word may begin, and what its letters stand for; the end of the word ($) counts as any letter that is asked for.
_SOUND_BEGINS = _rewriting("""
^A(?=E)|^[GKP](?=N)|^W(?=R) ->
^X -> S
^WH -> W
""")
_SOUNDS = _rewriting("""
(?<=.)[AEIOU] ->
(?<=M)B$ ->
CH|SH -> X
C(?=[IEY]|$)|Z -> S
(?<=C)K ->
C|Q|K -> K
DG[IEY] -> J
D -> T
(?<=[^AEIOU])GH ->
GH|PH|V -> F
G(?=N) ->
G(?=[IEY]|$) -> J
G -> K
(?<![^AEIOU])H(?=[^AEIOU]) ->
TH -> 0
[WY](?=[^AEIOU]) ->
X -> KS
""")


def metaphone(name: str | None) -> str:
    """The sound code of a whole name as one word; runs of a consonant count once."""
    return _SOUNDS(_SOUND_BEGINS(re.sub(r"([^AEIOU])\1+", r"\1", _word(name))))


def double_metaphone(name: str | None) -> tuple[str, str]:
    """The code and one with the first K, F and S written C, V and Z; as codes hold no C, V or Z, two pairs meet just when the codes are equal."""
    code = metaphone(name)
    return code, code.replace("K", "C", 1).replace("F", "V", 1).replace("S", "Z", 1)


# Rewritten beginnings and endings of a word, and the end of its key.
_KEY_BEGINS = _rewriting("""
^MAC -> MCC
^KN -> N
^K -> C
^PH|^PF -> FF
^SCH -> SSS
""")
_KEY_ENDS = _rewriting("""
(?:EE|IE)$ -> Y
(?:DT|RT|RD|NT|ND)$ -> D
""")
_KEY_CLOSES = (re.compile("(?<=.)S$"), ""), (re.compile("AY$"), "Y"), (re.compile("(?<=.)A$"), "")


def _breaths(m: re.Match) -> str:
    """A run of H and W: after a vowel, W is mute and H sounds; after anything else W sounds and H is mute, unless it is the first letter, but lets what follows sound as after a vowel."""
    open_, out = m.string[max(0, m.start() - 1) : m.start()] in tuple("AEIOU"), ""
    for k, c in enumerate(m[0]):
        heard = open_ != (c == "W") or c == "H" and m.start() + k == 0
        out += c if heard else ""
        open_ = open_ if c == "W" else not heard
    return out


# What the letters after the first one are written as.
_KEY_LETTERS = _rewriting("""
EV -> AF
[AEIOU] -> A
Q -> G
Z|K(?=N) -> S
M -> N
K -> C
SCH -> SSS
PH -> FF
[HW]+ -> *
""", _breaths)


def nysiis(name: str | None) -> str:
    """The New York sound code of a whole name as one word, six letters at most."""
    word = _KEY_ENDS(_KEY_BEGINS(_word(name)))
    key = word[:1] + _KEY_LETTERS(word[1:])
    key = re.sub(r"(.)\1+", r"\1", key)
    for pattern, to in _KEY_CLOSES:
        key = pattern.sub(to, key)
    return key[:6]


def damerau(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps, no part edited twice."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def damerau_sim(a: str, b: str) -> float:
    return 1 - damerau(a, b) / max(len(a), len(b), 1)


def lcs_sim(a: str, b: str) -> float:
    """Length of the longest common subsequence by the longer length; 0 for two empty names."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(len(a), len(b), 1)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - window), min(len(b), i + window + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            mine.append(x)
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(mine, sorted(taken), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def smith_waterman(a: str, b: str) -> float:
    """Best local alignment at +2, -1 and -2, by what the shorter name could reach."""
    if not a or not b:
        return 0.0
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], max(0, before + (2 if x == y else -1), row[j] - 2, row[j - 1] - 2)
            best = max(best, row[j])
    return best / (2 * min(len(a), len(b)))


def needleman_wunsch(a: str, b: str) -> float:
    """Global alignment at +2, -1 and -2, between the worst and the best that the longer name allows; 1 for two empty names, 0 for one."""
    longest = max(len(a), len(b))
    if not a or not b:
        return float(not longest)
    row = [-2 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], -2 * i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], max(before + (2 if x == y else -1), row[j] - 2, row[j - 1] - 2)
    return (row[-1] + 2 * longest) / (4 * longest)


def sequence_ratio(a: str, b: str) -> float:
    """difflib's ratio; it depends on the order of its arguments."""
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(50_000)
def _bag(text: str, n: int) -> tuple[Counter, float]:
    """The n-grams of a text with a blank on either side, and the length of their vector."""
    t = f" {text} "
    grams = Counter(t[i : i + n] for i in range(max(1, len(t) - n + 1)))
    return grams, sqrt(sum(v * v for v in grams.values()))


def _cosine(a: str, b: str, n: int) -> float:
    (x, p), (y, q) = _bag(a, n), _bag(b, n)
    return sum(v * y[g] for g, v in x.items() if g in y) / (p * q)


def bigram_cos(a: str, b: str) -> float:
    return _cosine(a, b, 2)


def trigram_cos(a: str, b: str) -> float:
    return _cosine(a, b, 3)


def of_pairs(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """An Arrow function of two text columns; null counts as ''."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


def of_names(f: Callable[[str], str]):
    """An Arrow function of one text column, meant for distinct names."""

    def run(a: pd.Series) -> pd.Series:
        return a.map(f)

    run.__annotations__ = {"a": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL under their names."""
    for f in (damerau_sim, lcs_sim, jaro, smith_waterman, needleman_wunsch, sequence_ratio):
        spark.udf.register(f.__name__, of_pairs(f))
    for f in (metaphone, nysiis):
        spark.udf.register(f.__name__, of_names(f))
