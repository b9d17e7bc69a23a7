"""Exact radius joins of short strings in a metric space, partitioned by pivots.

The metric is the unrestricted Damerau-Levenshtein distance. Pivots are the empty string and sets of strings: all strings of one great
length over half of the alphabet. The distance to a pivot follows from the length, or from how many letters are in that half. A
string's cell is the tuple of its distances to the pivots, in steps. By the triangle inequality, which holds for distances to sets
too, strings within radius 1 differ by at most 1 in every one of these distances; the query side is therefore replicated to the
neighbouring cell wherever its distance stands at a step's boundary, and each cell can be joined alone. One edit that makes a string
longer takes no letter from any half, and one that makes it shorter adds none, which rules out some neighbours. Inside a cell the
join is linear in its strings, so there are only as many pivots as it takes to keep cells small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamisol.llm.names import distance, edits, quiet

RADIUS, STEP = 1, 3  # the radius unless a caller gives another
#: Strings that a cell may hold on average before there is another pivot.
CELL = 40_000
#: Letters of names in the order in which halves of the alphabet are cut from them.
ALPHABET = "rlmkgpzhquytnsbfaidxcoevwj"


def half(k: int) -> frozenset[str]:
    """The k-th half of the alphabet: blocks of letters taken in turns, the blocks half as long for each further k; beyond the fourth, by a hash of k and the letter."""
    n = len(ALPHABET)
    if k < 4:
        return frozenset(c for i, c in enumerate(ALPHABET) if (i * 2 ** (k + 1) // n) % 2 == 0)
    return frozenset(sorted(ALPHABET, key=lambda c: hashlib.blake2b(f"{k}{c}".encode(), digest_size=8).digest())[: n // 2])


def pivots(rows: int) -> list[frozenset[str]]:
    """The halves of the alphabet that are pivots, beside the empty string, for a number of strings: the more strings, the more pivots."""
    n = 0
    while rows > CELL * 2 ** (n + 1):
        n += 1
    return [half(k) for k in range(n)]


def distance_to_half(text: str, half: frozenset[str], length: int) -> int:
    """The distance of ``text`` to the set of strings of ``length`` letters of ``half``, at least as long as the text."""
    return length - sum(c in half for c in text)


def cells(text: str, halves: list[frozenset[str]], replicate: bool, radius: int = RADIUS) -> list[str]:
    """The cell of a string, or, for a query, every cell that can hold a string within ``radius`` of it."""
    out = [("", 0)]
    for k, d in enumerate((len(text), *(sum(c in h for c in text) for h in halves))):  # up to a constant, the distances to the pivots
        own = d // STEP
        moves = range(max(0, d - radius) // STEP - own, (d + radius) // STEP - own + 1) if replicate else (0,)
        # at radius 1, ``way`` is where the length moved: the counts of letters can't move the other way then
        out = [(f"{x}{own + m:x}.", m if k == 0 and radius == 1 else way) for x, way in out for m in moves if not way or k == 0 or m != -way]
    return [x for x, _ in out]


def shortened(text: str, radius: int = RADIUS) -> set[str]:
    """The string and what is left of it without up to ``radius`` characters: strings within that distance share one of these."""
    out = {text}
    for _ in range(radius):
        out |= {t[:i] + t[i + 1 :] for t in out for i in range(len(t))}
    return out


def _without_one(text: str) -> list[str]:
    """What is left of the text without any one character; those of equal neighbours count once."""
    return [text[:i] + text[i + 1 :] for i, c in enumerate(text) if text[i + 1 : i + 2] != c]


def _near(text: str, get: Callable[[str], list[str] | None]) -> Iterator[tuple[str, int]]:
    """(member, distance) of the members within 1 of ``text``; ``get`` gives those that share a string of ``shortened``."""
    n, found = len(text), set(get(text) or ())
    for s in _without_one(text):
        if (members := get(s)) is not None:
            found.update(members)
    for x in found:
        # strings that share one and differ in length are apart by what the longer one was shortened by
        if len(x) != n:
            yield x, 1
        elif x == text:
            yield x, 0
        elif edits(text, x, 1) <= 1:
            yield x, 1


def apart(a: str, b: str, radius: int) -> int:
    """Their distance, or any number above ``radius``."""
    return edits(a, b, radius) if radius <= 1 else distance(a, b) if abs(len(a) - len(b)) <= radius else radius + 1


def within_radius(queries: DataFrame, members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, member, apart): all pairs of a string of ``queries`` and one of ``members`` (columns named text) at a distance, apart, of at most ``radius``.

    Both sides are made distinct; null strings have no partner, '' has those of length 1. Cells are streamed one after the other, sorted, so a task
    holds the members of one cell at a time. Nothing is capped.
    """
    q, m = queries.select("text").filter("text is not null").distinct(), members.select("text").filter("text is not null").distinct()
    # only how many pivots there are depends on it, no pair does
    halves = pivots(members.agg(F.approx_count_distinct("text")).first()[0])

    def place(side: int):
        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, text = [], []
                for t in b.column(0).to_pylist():
                    for c in cells(t, halves, side == 1, radius):
                        cell.append(c)
                        text.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array([side] * len(text), pa.int32()), pa.array(text, pa.string())], ["cell", "side", "text"])

        return scan

    schema = "cell string, side int, text string"
    both = m.mapInArrow(place(0), schema).unionByName(q.mapInArrow(place(1), schema))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet()
        cell: str | None = None
        index: dict[str, list[str]] = {}
        get = index.get
        for b in batches:
            left, right, far = [], [], []
            for c, side, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != cell:
                    cell, index = c, {}
                    get = index.get
                if side == 0:
                    for s in (t, *_without_one(t)) if radius == 1 else shortened(t, radius):
                        if (members := get(s)) is None:
                            index[s] = [t]
                        else:
                            members.append(t)
                elif index and radius == 1:
                    for x, e in _near(t, get):
                        left.append(t)
                        right.append(x)
                        far.append(e)
                elif index:
                    found = [m for s in shortened(t, radius) if (m := get(s)) is not None]
                    for x in set(found[0]).union(*found[1:]) if found else ():
                        if (e := apart(t, x, radius)) <= radius:
                            left.append(t)
                            right.append(x)
                            far.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(far, pa.int32())], ["query", "member", "apart"])

    # a pair can only meet in the one cell its member is in, so pairs are distinct
    return both.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(join, "query string, member string, apart int")


def brute(queries: Iterable[str], members: Iterable[str], radius: int = RADIUS) -> set[tuple[str, str]]:
    """All pairs by comparison, for tests."""
    return {(a, b) for a in queries for b in members if apart(a, b, radius) <= radius}


def brute_self(texts: list[str]) -> set[tuple[str, str]]:
    return {(a, b) for a, b in brute(texts, texts) if a < b}
