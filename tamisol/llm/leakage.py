"""Passages of held-out test items inside a corpus, found with a generalised suffix automaton of the items.

The automaton over the items' normalised words is built once per task. A document's words are streamed through it; the longest
matching length after each word gives the maximal spans a document shares with any item. Spans that are common to many
documents are told apart by counting, over the whole corpus, the different texts each item position is matched in without
the rest of the item. What is left must cover enough of the item, in order.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamisol.session import materialise

WORD = re.compile(r"\w+")
#: Shortest shared span in words; share of an item's words that makes a leak; share of them that must lie outside common passages; share and
#: least number of documents that make a passage common; longest change, in words, that doesn't end a stretch.
MIN_SPAN, COVERAGE, OWN, COMMON_SHARE, COMMON_LEAST, CHANGE = 4, 1 / 3, 0.16, 0.005, 8, 3
#: Share of an item from which a text holds the item and not a common passage, whatever its sentences. Words of one span that are a leak by themselves, however long the item.
WHOLE, LONGEST = 0.6, 50
#: Shortest span that is removed from a leaking document although the share doesn't rest on it.
REMOVED = 6
#: Items of more words than this are split into blocks, each with its own automaton; every document is streamed through all of them.
BLOCK_WORDS = 400_000


def words(text: str | None) -> list[str]:
    """Lower-case words; layout and punctuation carry no meaning. A word split by a hyphen at a line's end is joined."""
    return WORD.findall(re.sub(r"(?<=\w)-\n(?=\w)", "", text.lower())) if text else []


class SuffixAutomaton:
    """Generalised over several word sequences; knows at which (item, end) its states of at least ``min_span`` words occur."""

    def __init__(self, items: list[tuple[int, list[str]]], min_span: int = MIN_SPAN):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, (_, tokens) in enumerate(items):
            last = 0
            for at, w in enumerate(tokens):
                c = self.vocabulary.setdefault(w, len(self.vocabulary))
                last = self._extend(last, c, ends)
                ends[last].append((number, at + 1))
        self.ends: dict[int, list[tuple[int, int]]] = {}
        gathered = [list(e) for e in ends]
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[v] >= min_span:
                self.ends[v] = gathered[v]
                up = self.link[v]
                if self.length[up] >= min_span:
                    gathered[up] += gathered[v]

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        ends.append([])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int, ends: list) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q, ends)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append([])
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def spans(self, tokens: list[str], min_span: int = MIN_SPAN) -> list[tuple[int, int, int]]:
        """Maximal matches: (end in the document, length in words, state)."""
        get, nexts, link, length = self.vocabulary.get, self.next, self.link, self.length
        out, v, n = [], 0, 0
        for j, w in enumerate(tokens):
            c = get(w)
            u = nexts[v].get(c) if c is not None else None
            if u is not None:
                v, n = u, n + 1
                continue
            if n >= min_span:
                out.append((j, n, v))
            if c is None:
                v = n = 0
                continue
            while u is None and v:
                v = link[v]
                n = length[v]
                u = nexts[v].get(c)
            v, n = (u, n + 1) if u is not None else (0, 0)
        if n >= min_span:
            out.append((len(tokens), n, v))
        return out

    def matches(self, tokens: list[str], min_span: int = MIN_SPAN) -> dict[int, list[tuple[int, int, int]]]:
        """By item number: (start in the document, start in the item, length) of every maximal match."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, v in self.spans(tokens, min_span):
            while self.length[self.link[v]] >= n:
                v = self.link[v]
            for number, at in self.ends[v]:
                found.setdefault(number, []).append((end - n, at - n, n))
        return found


def covered(spans: list[tuple[int, int, int]], usable: list[int] | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """Most item words that spans ascending in both texts cover, and those spans. ``usable``: running counts of the item's positions that count."""
    spans = sorted(set(spans))
    best: list[int] = []
    back: list[int] = []
    value = lambda a, b: usable[b] - usable[a] if usable else b - a
    for k, (d, i, n) in enumerate(spans):
        top, frm = value(i, i + n), -1
        for m in range(k):
            d2, i2, n2 = spans[m]
            if d2 + n2 < d + n and i2 + n2 < i + n and d2 < d and i2 < i:
                cut = max(0, d2 + n2 - d, i2 + n2 - i)
                if cut < n and best[m] + value(i + cut, i + n) > top:
                    top, frm = best[m] + value(i + cut, i + n), m
        best.append(top)
        back.append(frm)
    if not best:
        return 0, []
    k = max(range(len(best)), key=best.__getitem__)
    total, chosen = best[k], []
    while k != -1:
        chosen.append(spans[k])
        k = back[k]
    return total, chosen[::-1]


def stretched(spans: list[tuple[int, int, int]]) -> int:
    """Item words that a chain of spans covers, with changes of up to CHANGE words between two spans."""
    total, at, to = 0, None, None
    for d, i, n in spans:
        if at is not None and 0 <= i - to <= CHANGE and d - at <= CHANGE + 1:
            total += i - to
        total += i + n - (i if to is None else max(i, to))
        at, to = d + n, i + n
    return total


def _blocks(items: list[tuple[int, list[str]]]) -> list[list[tuple[int, list[str]]]]:
    out, size = [[]], 0
    for x in items:
        if out[-1] and size + len(x[1]) > BLOCK_WORDS:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x[1])
    return out


def sentences(text: str) -> list[int]:
    """The number of its sentence for each of the words of ``text``; sentences end at .!?。؟ before white space (a full stop after a short word may be an abbreviation's), and at blank lines."""
    out: list[int] = []
    for k, part in enumerate(re.split(r"(?:(?<=\w{4}\.)|(?<=[!?。؟]))[\"'”’»)\]]*\s+|\n\s*\n", text)):
        out += [k] * len(words(part))
    return out


def holds_passage(chain: list[tuple[int, int, int]], size: int, of: list[int]) -> bool:
    """Whether a chain of spans is a passage of the item itself: most of it, or a third with at least MIN_SPAN words of each of two sentences."""
    n = stretched(chain)
    if n < COVERAGE * size:
        return False
    if n >= WHOLE * size:
        return True
    held = Counter(of[p] for p in {p for _, i, n in chain for p in range(i, i + n)})
    return sum(n >= MIN_SPAN for n in held.values()) > 1


def digest(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SHARED = "doc_id long, item_id long, spans array<struct<d:int,i:int,n:int>>, i int, n int, text long"


def shared_spans(docs: DataFrame, items: list[tuple[int, list[str]]], parts: dict[int, list[int]], longest: int) -> DataFrame:
    """Three kinds of row: (doc_id, item_id, spans) where the spans could cover enough of the item or one has ``longest`` words, (item_id, i, n, text) for each text that shares
    item words i to i + n but isn't a passage of the item, and (text) for each text; ``parts`` has the sentences of the items' words by item_id."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int32())])), pa.int32(), pa.int32(), pa.int64()]
    names = ["doc_id", "item_id", "spans", "i", "n", "text"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(items)
        sizes = [len(t) for _, t in items]
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            add = lambda *row: [c.append(x) for c, x in zip(cols, row, strict=True)]  # noqa: E731, B023
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = words(text)
                same = digest(tokens)
                add(None, None, None, None, None, same)
                for number, spans in automaton.matches(tokens).items():
                    item, size = items[number][0], sizes[number]
                    chain = covered(spans)[1]
                    if not holds_passage(chain, size, parts[item]):
                        for i, n in {(i, n) for _, i, n in spans}:
                            add(None, item, None, i, n, same)
                    if stretched(chain) >= COVERAGE * size or max(n for _, _, n in spans) >= longest:
                        add(key, item, [{"d": d, "i": i, "n": n} for d, i, n in sorted(set(spans))], None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, _SHARED)


def leaks(docs: DataFrame, items: DataFrame, documents: int | None = None, longest: int = LONGEST) -> DataFrame:
    """(doc_id, item_id, reason, share, spans, shared) of every document that repeats at least COVERAGE of an item's words in order (reason
    'share'), or else a span of ``longest`` words and more ('length'): the spans that make it up, and all spans of REMOVED words and more in common.

    A share of OWN of the item's words must lie outside passages common to COMMON_SHARE of all different texts (at least COMMON_LEAST; ``documents``
    overrides how many there are). Copies count once, and texts that hold a third of the item over several of its sentences don't count, however many there are. Null and empty texts share nothing; items shorter
    than MIN_SPAN words can't leak; repeated documents are each reported, repeated rows of one doc_id once; extra columns are ignored.
    ``items`` is a stated test set and goes to the driver as words; automata are built per block of BLOCK_WORDS words.
    """
    wanted = sorted({(int(r.item_id), r.text or "") for r in items.select("item_id", "text").collect()})
    listed = [(k, words(t)) for k, t in wanted]
    of = {k: sentences(re.sub(r"(?<=\w)-\n(?=\w)", "", t)) for k, t in wanted}
    parts = None
    for block in _blocks(listed):
        part = shared_spans(docs, block, of, longest)
        parts = part if parts is None else parts.unionByName(part)
    shared = materialise(parts, "spans")
    if documents is None:
        documents = shared.filter("item_id is null").select("text").distinct().count()
    common = max(COMMON_LEAST, COMMON_SHARE * documents)
    # where matches of different texts begin and end; summed by position, so as many rows as the items have words reach the driver
    spans = shared.filter("i is not null").select("item_id", "i", "n", "text").distinct()
    turns = spans.select("item_id", F.inline(F.array(F.struct(F.col("i").alias("p"), F.lit(1).alias("d")), F.struct((F.col("i") + F.col("n")).alias("p"), F.lit(-1).alias("d")))))
    matched = {k: [0] * (len(t) + 1) for k, t in listed}
    for r in turns.groupBy("item_id", "p").agg(F.sum("d").alias("d")).filter("d <> 0").collect():
        matched[r.item_id][r.p] = r.d
    usable = {}
    for k, t in listed:
        running, total, depth = [0], 0, 0
        for p in range(len(t)):
            depth += matched[k][p]
            total += depth < common
            running.append(total)
        usable[k] = running

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, why, shares, chosen, long = [], [], [], [], []
            for k, (item, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                size, own = len(usable[item]) - 1, usable[item]
                found = [(s["d"], s["i"], s["n"]) for s in spans]
                used = covered(found)[1]
                n = stretched(used)
                if n >= COVERAGE * size and covered(found, own)[0] >= OWN * size:
                    reason = "share"
                else:  # long spans of which at least half aren't common
                    used = [(d, i, m) for d, i, m in found if m >= longest and own[i + m] - own[i] >= m / 2]
                    n, reason = sum(m for _, _, m in used[:1]), "length"
                if used and n:
                    keep.append(k)
                    why.append(reason)
                    shares.append(min(1.0, n / size))
                    chosen.append([{"d": d, "i": i, "n": m} for d, i, m in used])
                    long.append([s for s in spans if s["n"] >= REMOVED])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(why, pa.string()), pa.array(shares, pa.float64()), pa.array(chosen, b.column(2).type), pa.array(long, b.column(2).type)], ["doc_id", "item_id", "reason", "share", "spans", "shared"])

    rows = shared.filter("spans is not null").select("doc_id", "item_id", "spans").mapInArrow(decide, "doc_id long, item_id long, reason string, share double, spans array<struct<d:int,i:int,n:int>>, shared array<struct<d:int,i:int,n:int>>")
    return rows.dropDuplicates(["doc_id", "item_id"])


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, removed_words, text_clean): every leaking document without the leaked spans; all others stay as they are and aren't listed."""
    cut = leaks(docs, items).select("doc_id", F.explode(F.concat("spans", "shared")).alias("s")).groupBy("doc_id").agg(F.collect_set(F.struct(F.col("s.d").alias("d"), F.col("s.n").alias("n"))).alias("cut"))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["doc_id"]).join(cut, "doc_id")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                gone = {p for s in spans for p in range(s["d"], s["d"] + s["n"])}
                out, at, joined = [], 0, re.sub(r"(?<=\w)-\n(?=\w)", "", text)
                for p, m in enumerate(WORD.finditer(joined)):
                    if p in gone:
                        out.append(joined[at : m.start()])
                        at = m.end()
                texts.append("".join([*out, joined[at:]]))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "removed_words", "text_clean"])

    return both.mapInArrow(remove, "doc_id long, removed_words int, text_clean string")
