"""Joins on parts of texts, and screening of names against lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamisol.functions import arrow_metrics as A
from tamisol.functions import metrics as M
from tamisol.functions.text import low, normalise, tokens
from tamisol.session import materialise, ship

GRAM = 3


#: Buckets of a hash by which parts of texts are counted; as many numbers come to the driver.
BUCKETS = 1 << 16


def _parts(strings: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of ``size`` characters, GRAM at most, of each string: their string, their start in it, themselves as a number, and their bucket."""
    length = np.array([len(s) for s in strings], np.int64)
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(strings)), length)
    start = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    whole = np.flatnonzero(start + size <= length[row])
    part = np.zeros(len(whole), np.int64)
    for k in range(size):
        part = part << 21 | code[whole + k]
    return row[whole], start[whole], part, (part % 1_000_003 * 7919 + size * 31) % BUCKETS


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): all pairs of distinct non-empty strings in which text holds needle. Columns: needle, text.

    No pair is compared blindly: each needle is looked up by one part of GRAM characters (itself, if it is shorter), which every text that holds it must have, and
    the pairs of that equi-join are verified. Any part of a needle will do; the rarest one by counts of hashed parts is taken, so texts are only written with parts in the
    buckets of those. Null and '' have no pairs here.
    """
    ship(needles.sparkSession)
    n = materialise(needles.select("needle").filter("needle <> ''").distinct(), "needles")
    t = materialise(texts.select("text").filter("text <> ''").distinct(), "texts")
    # parts shorter than GRAM only where a needle is so short; at most GRAM lengths come to the driver
    sizes = sorted(r.k for r in n.select(F.least(F.length("needle"), F.lit(GRAM)).alias("k")).distinct().collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            strings = b.column(0).to_pylist()
            for size in sizes:
                total += np.bincount(_parts(strings, size)[3], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in t.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings = b.column(0).to_pylist()
            needle, part, bucket = [], [], []
            for size in sizes:
                own = [s for s in strings if min(len(s), GRAM) == size]
                row, start, _, at = _parts(own, size)
                order = np.lexsort((start, counts[at], row))
                first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
                for i in first[counts[at[first]] > 0].tolist():  # else no text has it
                    s = own[row[i]]
                    needle.append(s)
                    part.append(s[start[i] : start[i] + size])
                    bucket.append(int(at[i]))
            yield pa.RecordBatch.from_arrays([pa.array(needle, pa.string()), pa.array(part, pa.string()), pa.array(bucket, pa.int32())], ["needle", "part", "bucket"])

    chosen = materialise(n.mapInArrow(rarest, "needle string, part string, bucket int"), "rarest")
    wanted = np.zeros(BUCKETS, bool)
    wanted[[r.bucket for r in chosen.select("bucket").distinct().collect()]] = True

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings = b.column(0).to_pylist()
            take, parts = [np.zeros(0, np.int64)], []
            for size in sizes:
                row, start, part, at = _parts(strings, size)
                row, start, part = (v[wanted[at]] for v in (row, start, part))
                order = np.lexsort((part, row))
                once = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (part[order][1:] != part[order][:-1])]] if len(order) else order
                take.append(row[once])
                parts += [strings[r][i : i + size] for r, i in zip(row[once].tolist(), start[once].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(take))), pa.array(parts, pa.string())], ["text", "part"])

    parts = t.mapInArrow(having, "text string, part string")
    return chosen.select("needle", "part").join(parts, "part").filter(F.col("text").contains(F.col("needle"))).select("needle", "text")


#: Strings of either side in a cell of ``similar_sequences``; strings of one side compared with a cell at once; characters up to which common subsequences are counted.
CELL, CHUNK, WORD = 8_192, 256, 64


def _repeats(keys: np.ndarray) -> np.ndarray:
    """How often each key stood before it."""
    order = np.argsort(keys, kind="stable")
    ordered, at = keys[order], np.arange(len(keys))
    out = np.empty(len(keys), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], at, 0)) if len(keys) else at
    return out


class _Strings:
    """Strings by length, with what bounds how alike they can be: counts of their numbered characters, and bits of their numbered parts of two characters, both by
    a hash; where each character stands in them, as bits by a hash of it, and their characters' hashes."""

    def __init__(self, strings: list[str]):
        self.strings = sorted(strings, key=len)
        n = len(self.strings)
        self.length = np.array([len(s) for s in self.strings], np.int64)
        code = np.frombuffer("".join(self.strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(n), self.length)
        at = np.arange(len(row)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.bag = np.zeros((n, 128), np.float32)
        np.add.at(self.bag, (row, code % 32 + 32 * np.minimum(_repeats(row << 21 | code), 3)), 1)
        inside = row[1:] == row[:-1]
        of, part = row[:-1][inside], (code[:-1] * 1_000_003 + code[1:])[inside] % (1 << 31)
        bits = np.zeros((n, 256), bool)
        bits[of, (part * 7 + _repeats(of << 31 | part) * 101) % 256] = True
        self.parts = np.packbits(bits, axis=1).view(np.uint64)
        self.places = np.zeros((n, 128), np.uint64)
        early = at < WORD
        np.bitwise_or.at(self.places, (row[early], code[early] % 128), np.uint64(1) << at[early].astype(np.uint64))
        self.codes = np.zeros((n, 2 * WORD), np.int64)
        early = at < 2 * WORD
        self.codes[row[early], at[early]] = code[early] % 128


def _subsequence(x: _Strings, y: _Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At least the lengths of the longest common subsequences of pairs, the first of WORD characters at most; bits in parallel."""
    rest, length = np.full(len(i), ~np.uint64(0)), y.length[j]
    for k in range(int(length.max(initial=0))):
        match = np.where(k < length, x.places[i, y.codes[j, k]], np.uint64(0))
        both = rest & match
        rest = (rest + both) | (rest - both)
    return np.bitwise_count(~rest)


def _alike(x: _Strings, y: _Strings, least: float) -> Iterator[tuple[str, str, float]]:
    """(a, b, ratio) of all pairs with a difflib ratio of at least ``least``."""
    half = np.float32(least / 2)
    one = lambda s: np.ones((len(s.strings), 1), np.float32)
    # the product is how many characters are common, at least, less how many must be
    left, right = np.hstack([x.bag, -half * x.length[:, None], one(x)]).astype(np.float32), np.hstack([y.bag, one(y), -half * y.length[:, None]]).astype(np.float32)
    for first in range(0, len(x.strings), CHUNK):
        last = min(first + CHUNK, len(x.strings))
        low = int(np.searchsorted(y.length, x.length[first] * least / (2 - least) - 1e-6))
        high = int(np.searchsorted(y.length, x.length[last - 1] * (2 - least) / least + 1e-6, "right"))
        if low >= high:
            continue
        i, j = np.divmod(np.flatnonzero((left[first:last] @ right[low:high].T).ravel() >= -1e-2), high - low)
        i, j = i + first, j + low
        total = x.length[i] + y.length[j]
        # every bit that differs stands for a part that isn't shared; of both lengths together, least / 2 match, and every block but one follows a character that doesn't
        parts = np.maximum(x.length[i] - 1, 0) + np.maximum(y.length[j] - 1, 0) - np.bitwise_count(x.parts[i] ^ y.parts[j]).sum(1)
        ok = parts / 2 >= (1.5 * least - 1) * total - 1 - 1e-6
        i, j, total = i[ok], j[ok], total[ok]
        ok = (x.length[i] > WORD) | (y.length[j] > 2 * WORD)
        short = np.flatnonzero(~ok)
        ok[short] = _subsequence(x, y, i[short], j[short]) >= least / 2 * total[short] - 1e-6
        for p, q in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if (r := A.sequence_ratio(a := x.strings[p], b := y.strings[q])) >= least:
                yield a, b, r


def similar_sequences(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, ratio): pairs of distinct strings (columns a and b) with a difflib ratio of at least ``least``.

    Both sides are dealt into blocks, and each two blocks are a cell. Within a cell all pairs of lengths in proportion are bounded together: by their common characters, a
    product of matrices; those left by their common parts of two characters and by their longest common subsequence, both as bits; the Arrow function only sees what
    passes all three. None of these bounds loses a pair, and no pair is written before it is known to be alike. Null has no partner, '' only ''.
    """
    x = materialise(left.select(F.col("a").alias("s")).filter("s is not null").distinct(), "left")
    y = materialise(right.select(F.col("b").alias("s")).filter("s is not null").distinct(), "right")
    rows, columns = (max(1, -(-d.count() // CELL)) for d in (x, y))
    block = lambda n: F.pmod(F.xxhash64("s"), F.lit(n).cast("long"))
    cells = lambda n, of: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)).alias("cell")
    both = x.select(cells(columns, lambda k: block(rows) * columns + k), F.lit(0).alias("side"), "s").unionByName(y.select(cells(rows, lambda k: k * columns + block(columns)), F.lit(1).alias("side"), "s"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(a: list[str], b: list[str]) -> pa.RecordBatch:
            pairs = list(_alike(_Strings(a), _Strings(b), least)) if a and b else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "ratio"])

        cell, sides = None, ([], [])
        for batch in batches:
            for c, side, s in zip(*(v.to_pylist() for v in batch.columns), strict=True):
                if c != cell:
                    yield found(*sides)
                    cell, sides = c, ([], [])
                sides[side].append(s)
        yield found(*sides)

    many = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * columns)
    return both.repartition(many, "cell").sortWithinPartitions("cell").mapInArrow(scan, "a string, b string, ratio double")


def screen_exact(names: DataFrame, lists: DataFrame, top: int = 10) -> DataFrame:
    """(name, hits, verdict): entries whose full or last name holds the name, whatever the case; at most ``top`` ids in their order. BLOCKED if there are any, else CLEAR.

    Where ``names`` has a column dob, it's in the result too, and a date that is given must be the entry's dob_normalized.
    """
    own = ["name", "dob"] if "dob" in names.columns else ["name"]
    wanted = names.select(*own).distinct().withColumn("needle", low("name"))
    texts = lists.select("id", *(["dob_normalized"] if len(own) > 1 else []), F.explode(F.array(low("full_name"), low("last_name"))).alias("text")).filter("text <> ''").distinct()
    found = wanted.join(containing(wanted.select("needle"), texts.select("text")), "needle").join(texts, "text")
    if len(own) > 1:
        found = found.filter(F.coalesce(F.nullif(F.col("dob"), F.lit("")), F.col("dob_normalized")).eqNullSafe(F.col("dob_normalized")))
    found = found.select(*own, "id").distinct()
    first = found.withColumn("n", F.row_number().over(W.partitionBy(*own).orderBy("id"))).filter(F.col("n") <= top)
    hits = first.groupBy(*own).agg(F.array_sort(F.collect_list("id")).alias("hits"))
    w, h = wanted.alias("w"), hits.alias("h")
    both = w.join(h, [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in own], "left").select(*(f"w.{c}" for c in own), "h.hits")
    return both.select(*own, F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"), F.when(F.col("hits").isNotNull(), "BLOCKED").otherwise("CLEAR").alias("verdict"))


#: Letters that a word must have to be looked up by itself: 1 looks up all words; with more, candidates grow far slower with both tables.
TELLING = 1


def looked_up(name: Column, telling: int = TELLING) -> Column:
    """The words of a name by which entries are looked up: those of at least ``telling`` letters; all of them where none is so long."""
    words = F.array_distinct(tokens(low(name)))
    long = F.filter(words, lambda w: F.length(w) >= telling)
    return F.when(F.size(long) > 0, long).otherwise(words)


def candidates(names: DataFrame, lists: DataFrame, telling: int = TELLING) -> DataFrame:
    """(name, id): entries whose lower-case full name holds any word of the name that is ``looked_up`` as a part. ``telling`` = 1: any word at all, single letters too."""
    words = names.select("name").distinct().select("name", F.explode(looked_up(F.col("name"), telling)).alias("needle"))
    texts = lists.select("id", low("full_name").alias("text"))
    return words.join(containing(words, texts), "needle").join(texts, "text").select("name", "id").distinct()


#: Names and entries of a cell of ``candidate_counts``; rows beyond which a word's entries are kept as bits.
NAMES, ENTRIES, DENSE = 16_384, 65_536, 64


def _holders(words: list[str], texts: list[str]) -> list[np.ndarray]:
    """For each word, which of the texts hold it, ascending. Words hold no line end."""
    blob = "\n".join(texts)
    code = np.frombuffer(blob.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in texts], np.int64))[: len(code)]
    out = [np.zeros(0, np.int64)] * len(words)
    for size in range(1, GRAM + 1):
        which = [k for k, w in enumerate(words) if min(len(w), GRAM) == size]
        if not which or len(code) < size:
            continue
        # every part of the texts by its characters; of a word's parts, the one that stands in the fewest places
        part = np.zeros(len(code) - size + 1, np.int64)
        for k in range(size):
            part = part << 21 | code[k : len(code) - size + 1 + k]
        order = np.argsort(part, kind="stable")
        part = part[order]
        own, start, key, _ = _parts([words[k] for k in which], size)
        low, high = np.searchsorted(part, key), np.searchsorted(part, key, "right")
        rarest = np.lexsort((high - low, own))
        for i in rarest[np.r_[True, own[rarest][1:] != own[rarest][:-1]]].tolist():
            k, at = which[own[i]], order[low[i] : high[i]] - start[i]
            if len(w := words[k]) > size:
                at = np.array([p for p in at.tolist() if p >= 0 and blob.startswith(w, p)], np.int64)
            out[k] = np.unique(row[at])
    return out


def _counts(names: list[tuple[str, list[str]]], texts: list[str]) -> Iterator[tuple[str, int]]:
    """(name, how many texts hold any of its words), names without any left out."""
    words = sorted({w for _, own in names for w in own})
    holders = dict(zip(words, _holders(words, texts), strict=True))
    sets, bits = {}, {}
    for w, rows in holders.items():
        if len(rows) <= DENSE:
            sets[w] = frozenset(rows.tolist())
        else:
            flags = np.zeros(-(-len(texts) // 64) * 64, bool)
            flags[rows] = True
            bits[w] = np.packbits(flags, bitorder="little").view(np.uint64)
    known: dict[tuple[str, ...], tuple[np.ndarray, int]] = {}
    for name, own in names:
        frequent = tuple(sorted(w for w in own if w in bits))
        rare = frozenset().union(*(sets[w] for w in own if w in sets))
        n = len(rare)
        if frequent:
            if frequent not in known:
                any_ = np.bitwise_or.reduce([bits[w] for w in frequent])
                known[frequent] = any_, int(np.bitwise_count(any_).sum())
            any_, n = known[frequent]
            n += sum(not int(any_[r >> 6]) >> (r & 63) & 1 for r in rare)
        if n:
            yield name, n


def candidate_counts(names: DataFrame, lists: DataFrame, telling: int = TELLING) -> DataFrame:
    """(name, candidates): the number of ``candidates`` of each name that has any; entries are told apart by id, null isn't counted.

    Both sides are dealt into blocks, and each two blocks are a cell, in which entries are bits and those of a name's words are united. So no pair is written, though a word
    of one letter stands in nearly all entries.
    """
    ship(names.sparkSession)
    named = materialise(names.select("name").distinct().select("name", looked_up(F.col("name"), telling).alias("words")).filter(F.size("words") > 0), "names")
    texts = lists.select("id", low("full_name").alias("text")).filter("text is not null").distinct()
    # several texts of an id are one entry; entries without an id are one that isn't counted
    texts = materialise(texts.groupBy("id").agg(F.array_sort(F.collect_list("text")).alias("texts")).select("id", F.array_join("texts", "\n").alias("text")), "texts")
    rows, columns = max(1, -(-named.count() // NAMES)), max(1, -(-texts.count() // ENTRIES))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    cells = lambda n, of: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)).alias("cell")
    both = named.select(cells(columns, lambda k: block("name", rows) * columns + k), F.lit(0).alias("side"), F.col("name").alias("s"), "words")
    both = both.unionByName(texts.select(cells(rows, lambda k: k * columns + block("id", columns)), F.when(F.col("id").isNull(), 2).otherwise(1).alias("side"), F.col("text").alias("s"), F.lit(None).cast("array<string>").alias("words")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(own: list, held: list[str], other: list[str]) -> pa.RecordBatch:
            found = dict(_counts(own, held)) if own and held else {}
            found |= {name: 0 for name, _ in _counts(own, other) if name not in found} if own and other else {}
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["name", "n"])

        cell, sides = None, ([], [], [])
        for batch in batches:
            for c, side, s, words in zip(*(v.to_pylist() for v in batch.columns), strict=True):
                if c != cell:
                    yield counted(*sides)
                    cell, sides = c, ([], [], [])
                sides[side].append((s, words) if side == 0 else s)
        yield counted(*sides)

    many = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * columns)
    return both.repartition(many, "cell").sortWithinPartitions("cell").mapInArrow(scan, "name string, n long").groupBy("name").agg(F.sum("n").alias("candidates"))


def similarities(pairs: DataFrame, a: str, b: str, na: str, nb: str) -> dict[str, Column]:
    """All 21 similarities of the raw names a, b and normalised names na, nb."""
    x, y, p, q = F.col(a), F.col(b), F.col(na), F.col(nb)
    jaro = A.of_pairs(A.jaro)(p, q)
    sound = A.of_names(A.metaphone)
    same = lambda f: (f(x) == f(y)).cast("double")
    return {
        "exact": M.exact(p, q), "initial_collapse": M.initial_collapse(p, q), "substring": M.substring(p, q), "soundex_eq": (M.soundex(x) == M.soundex(y)).cast("double"), "refined_soundex_eq": (M.refined_soundex(x) == M.refined_soundex(y)).cast("double"),
        "metaphone_eq": same(sound), "dmetaphone_eq": same(sound), "nysiis_eq": same(A.of_names(A.nysiis)), "levenshtein_sim": M.levenshtein_sim(p, q), "damerau_sim": A.of_pairs(A.damerau_sim)(p, q), "hamming_sim": M.hamming_sim(p, q),
        "lcs_sim": A.of_pairs(A.lcs_sim)(p, q), "jaro": jaro, "jaro_winkler": M.jaro_winkler(jaro, p, q), "jaccard": M.jaccard(p, q), "sorensen_dice": M.sorensen_dice(p, q), "token_set_ratio": M.token_set_ratio(p, q), "bigram_cos": M.ngram_cosine(p, q, 2),
        "trigram_cos": M.ngram_cosine(p, q, 3), "smith_waterman": A.of_pairs(A.smith_waterman)(p, q), "needleman_wunsch": A.of_pairs(A.needleman_wunsch)(p, q),
    }


def _arrow_sum(a: str, b: str, p: str, q: str) -> float:
    """The weighted sum of the similarities that aren't built-in expressions."""
    w, jaro, prefix = M.WEIGHTS, A.jaro(p, q), 0
    while prefix < 4 and prefix < min(len(p), len(q)) and p[prefix] == q[prefix]:
        prefix += 1
    s = (w["metaphone_eq"] + w["dmetaphone_eq"]) * (A.metaphone(a) == A.metaphone(b)) + w["nysiis_eq"] * (A.nysiis(a) == A.nysiis(b)) + w["damerau_sim"] * A.damerau_sim(p, q) + w["lcs_sim"] * A.lcs_sim(p, q)
    s += w["bigram_cos"] * A.bigram_cos(p, q) + w["trigram_cos"] * A.trigram_cos(p, q)
    return s + w["jaro"] * jaro + w["jaro_winkler"] * (jaro + 0.1 * prefix * (1 - jaro)) + w["smith_waterman"] * A.smith_waterman(p, q) + w["needleman_wunsch"] * A.needleman_wunsch(p, q)


def with_name_score(pairs: DataFrame, a: str, b: str, na: str, nb: str) -> DataFrame:
    """Append name_score, the weighted mean of all 21 similarities: native ones are summed by expressions, the rest in one Arrow stage."""
    sims = {k: c for k, c in similarities(pairs, a, b, na, nb).items() if k not in ARROW}
    native = F.lit(0.0)
    for k, c in sims.items():
        native = native + F.coalesce(c, F.lit(0.0)) * M.WEIGHTS[k]
    rows = pairs.withColumn("name_score", native)
    total = sum(M.WEIGHTS.values())

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [f[c].fillna("") for c in (a, b, na, nb)]
            f["name_score"] = [(s + _arrow_sum(*t)) / total for s, *t in zip(f["name_score"], *text, strict=True)]
            yield f

    return rows.mapInPandas(scan, rows.schema)


ARROW = ("bigram_cos", "trigram_cos", "metaphone_eq", "dmetaphone_eq", "nysiis_eq", "damerau_sim", "lcs_sim", "jaro", "jaro_winkler", "smith_waterman", "needleman_wunsch")


def scored(pairs: DataFrame) -> DataFrame:
    """Append name_score, dob_score, nationality_score and score to pairs with the columns name, full_name, norm, list_norm, dob, list_dob, nationality and list_nationality."""
    pairs = with_name_score(pairs, "name", "full_name", "norm", "list_norm")
    pairs = pairs.withColumns({"dob_score": M.dob_score(F.col("dob"), F.col("list_dob")), "nationality_score": M.nationality_score(F.col("nationality"), F.col("list_nationality"))})
    return pairs.withColumn("score", M.probability(F.col("name_score"), F.col("dob_score"), F.col("nationality_score")))


def _best_unequal() -> float:
    """The highest name score of two names that aren't the same when normalised."""
    return 1 - M.WEIGHTS["exact"] / sum(M.WEIGHTS.values())


def screen_fuzzy(people: DataFrame, lists: DataFrame, threshold: float = 0.65, top: int = 10, telling: int = TELLING) -> DataFrame:
    """The best ``top`` entries of each person (name, dob, nationality) with a score of at least ``threshold``, ties by id.

    Entries are compared when they hold one of the name's words as a part (``candidates``). Each distinct name is normalised once. An entry whose
    normalised name is another one can't have more than a certain name score, and then not reach the threshold unless dates of birth or
    nationalities agree well enough; those entries are looked for among entries of the same year or the same nationality only, equal names by equality. Blank names give nothing.
    """
    distinct = people.select("name").filter("trim(name) <> ''").distinct().withColumn("norm", normalise("name"))
    normed = lists.select("full_name").filter("full_name is not null").distinct().withColumn("list_norm", normalise("full_name"))
    names, entries = materialise(distinct, "names"), materialise(normed, "entries")
    who = people.select("name", "dob", "nationality").distinct()
    listed = lists.select("id", "full_name", F.col("dob").alias("list_dob"), F.col("nationality").alias("list_nationality"), "source")
    agree = M.probability(F.lit(_best_unequal()), M.dob_score(F.col("dob"), F.col("list_dob")), M.nationality_score(F.col("nationality"), F.col("list_nationality"))) >= threshold
    holds = F.exists(looked_up(F.col("name"), telling), lambda w: low("full_name").contains(w))
    equal = names.join(entries, F.col("norm") == F.col("list_norm")).filter(holds).join(listed, "full_name").join(who, "name")
    # scores of 0.5 for what is missing: can names that differ be enough then, or must something agree?
    missing = people.sparkSession.range(1).select((M.probability(F.lit(_best_unequal()), F.lit(0.5), F.lit(0.5)) >= threshold).alias("v")).collect()[0].v
    if missing:
        other = candidates(names, lists, telling).join(listed, "id").join(who, "name").join(names, "name").join(entries, "full_name")
    else:
        year = lambda c: F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)
        nation = lambda c: F.substring(F.lower(F.trim(c)), 1, 2)
        # what must agree, in front of the words that are looked up and of the names they are looked up in
        keys = lambda d, n: F.explode(F.filter(F.array(F.concat(F.lit("y"), F.nullif(year(F.col(d)), F.lit(""))), F.when(F.col(n) != "", F.concat(F.lit("n"), nation(F.col(n))))), lambda k: k.isNotNull()))
        wanted = who.withColumn("agreed", keys("dob", "nationality"))
        some = listed.withColumn("agreed", keys("list_dob", "list_nationality"))
        held = containing(wanted.select(F.explode(looked_up(F.col("name"), telling)).alias("needle")), some.select(low("full_name").alias("text")))
        words = wanted.withColumn("needle", F.explode(looked_up(F.col("name"), telling))).join(held, "needle")
        other = words.join(some.withColumn("text", low("full_name")), ["agreed", "text"]).drop("agreed", "text", "needle").distinct().join(names, "name").join(entries, "full_name")
    other = other.filter((F.col("norm") != F.col("list_norm")) & agree)
    columns = ["name", "dob", "nationality", "id", "full_name", "list_dob", "list_nationality", "source", "norm", "list_norm"]
    pairs = materialise(equal.select(*columns).unionByName(other.select(*columns)), "pairs")
    rank = W.partitionBy("name", "dob", "nationality").orderBy(F.desc("score"), "id")
    return scored(pairs).filter(F.col("score") >= threshold).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select("name", "dob", "nationality", "id", "full_name", "source", "name_score", "dob_score", "nationality_score", "score", "rank")
