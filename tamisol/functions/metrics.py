"""Similarities of two names as native column expressions, and their probabilistic combination.

``a`` and ``b`` are raw names, ``na`` and ``nb`` normalised ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamisol.functions import arrow_metrics as A
from tamisol.functions.text import initials, tokens

# Weights of the 21 similarities.
WEIGHTS = {
    "exact": 5.0, "initial_collapse": 2.0, "substring": 1.5, "soundex_eq": 1.0, "refined_soundex_eq": 1.0, "metaphone_eq": 1.2, "dmetaphone_eq": 1.2, "nysiis_eq": 1.0, "levenshtein_sim": 3.0, "damerau_sim": 3.0, "hamming_sim": 0.7, "lcs_sim": 1.5,
    "jaro": 3.0, "jaro_winkler": 4.0, "jaccard": 2.0, "sorensen_dice": 2.0, "token_set_ratio": 3.0, "bigram_cos": 2.0, "trigram_cos": 2.0, "smith_waterman": 2.0, "needleman_wunsch": 2.0,
}
# Probabilities of agreement among matches and among others, for name, date of birth and nationality.
AGREEMENT = {"name": (0.95, 0.10), "dob": (0.99, 0.05), "nationality": (0.90, 0.15)}
# Code digits of the letters, 0 for letters without one.
SOUNDEX = ("BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
REFINED = ("BPFVCKSGJQXZDTLMNRAEIOUYHW", "11223334566677899A00000000")


def exact(na: Column, nb: Column) -> Column:
    return (na == nb).cast("double")


def initial_collapse(na: Column, nb: Column) -> Column:
    """Equal initials: 1 if one side is nothing but short words, else 0.5."""
    x, y = tokens(na), tokens(nb)
    short = lambda t: F.forall(t, lambda w: F.length(w) <= 2)
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (initials(x) != initials(y)), 0.0).when(short(x) | short(y), 1.0).otherwise(0.5)


def substring(na: Column, nb: Column) -> Column:
    """Shorter by longer length where one holds the other; 0 where one is empty."""
    x, y = F.length(na), F.length(nb)
    return F.when((x == 0) | (y == 0), 0.0).when(na.contains(nb) | nb.contains(na), F.least(x, y) / F.greatest(x, y)).otherwise(0.0)


def _letters(a: Column) -> Column:
    return F.upper(F.regexp_replace(a, "[^A-Za-z]", ""))


def _from_second(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c))


def soundex(a: Column) -> Column:
    """The name's letters as one word: first letter and three digits; vowels, H, W and Y separate equal digits; no letters give 0000."""
    u = _letters(a)
    runs = F.regexp_replace(F.translate(u, *SOUNDEX), r"(.)\1+", "$1")
    return F.when(u == "", "0000").otherwise(F.substring(F.rpad(F.concat(F.substring(u, 1, 1), F.regexp_replace(_from_second(runs), "0", "")), 4, "0"), 1, 4))


def refined_soundex(a: Column) -> Column:
    """First letter, then the digits of the others without repetitions and zeros; variable length."""
    u = _letters(a)
    runs = F.regexp_replace(F.translate(_from_second(u), *REFINED), r"(.)\1+", "$1")
    return F.when(u == "", "").otherwise(F.concat(F.substring(u, 1, 1), F.regexp_replace(runs, "0", "")))


def levenshtein_sim(na: Column, nb: Column) -> Column:
    return 1.0 - F.levenshtein(na, nb) / F.greatest(F.length(na), F.length(nb), F.lit(1))


def hamming_sim(na: Column, nb: Column) -> Column:
    """Mismatches of aligned characters plus the difference in length, against the longer length; 1 for two empty names."""
    n, longest = F.least(F.length(na), F.length(nb)), F.greatest(F.length(na), F.length(nb))
    same = F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(na, i, F.lit(1)) == F.substring(nb, i, F.lit(1)))))
    return F.when(longest == 0, 1.0).otherwise(1.0 - (longest - same) / F.greatest(longest, F.lit(1)))


def jaro_winkler(jaro: Column, na: Column, nb: Column) -> Column:
    """Jaro raised by a tenth of the rest for each of up to four equal first characters, whatever the Jaro value."""
    same = lambda k: (F.length(na) >= k) & (F.length(nb) >= k) & (F.substring(na, k, 1) == F.substring(nb, k, 1))
    prefix = F.when(~same(1), 0).when(~same(2), 1).when(~same(3), 2).when(~same(4), 3).otherwise(4)
    return jaro + 0.1 * prefix * (1.0 - jaro)


def jaccard(na: Column, nb: Column) -> Column:
    x, y = F.array_distinct(tokens(na)), F.array_distinct(tokens(nb))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def sorensen_dice(na: Column, nb: Column) -> Column:
    x, y = F.array_distinct(tokens(na)), F.array_distinct(tokens(nb))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(x, y)) / F.greatest(total, F.lit(1)))


def token_set_ratio(na: Column, nb: Column) -> Column:
    """Levenshtein similarity of both names rewritten as sorted common words and sorted rest."""
    x, y = F.array_distinct(tokens(na)), F.array_distinct(tokens(nb))
    common = F.array_sort(F.array_intersect(x, y))
    line = lambda t, o: F.trim(F.concat_ws(" ", F.array_join(common, " "), F.array_join(F.array_sort(F.array_except(t, o)), " ")))
    return F.when((F.size(x) == 0) != (F.size(y) == 0), 0.0).otherwise(levenshtein_sim(line(x, y), line(y, x)))


def ngram_cosine(na: Column, nb: Column, n: int) -> Column:
    """Cosine of the bags of character n-grams of the names with a blank on either side; a text shorter than n is one gram. An Arrow stage, as built-ins can only count grams by comparing each with all."""
    return A.of_pairs(A.bigram_cos if n == 2 else A.trigram_cos)(na, nb)


def combined(similarities: dict[str, Column]) -> Column:
    """Weighted mean over the similarities given."""
    total = sum(WEIGHTS[k] for k in similarities)
    out = F.lit(0.0)
    for k, c in similarities.items():
        out = out + c * WEIGHTS[k]
    return out / total


def dob_score(a: Column, b: Column) -> Column:
    """Missing 0.5, no year 0.5, equal text 1, equal year 0.7, else 0."""
    year = lambda c: F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, 0.5).when((year(a) == "") | (year(b) == ""), 0.5).when(F.trim(a) == F.trim(b), 1.0).when(year(a) == year(b), 0.7).otherwise(0.0)


def nationality_score(a: Column, b: Column) -> Column:
    """Missing 0.5; 1 where the first two letters agree, whatever the case."""
    two = lambda c: F.substring(F.lower(F.trim(c)), 1, 2)
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, 0.5).when(two(a) == two(b), 1.0).otherwise(0.0)


def probability(name: Column, dob: Column, nationality: Column) -> Column:
    """Log-likelihood ratios of the three scores, interpolated between full agreement (from 0.9) and disagreement (up to 0.1), through a logistic curve."""
    total = F.lit(0.0)
    for k, s in (("name", name), ("dob", dob), ("nationality", nationality)):
        m, u = AGREEMENT[k]
        agree, differ = F.log2(F.lit(m / u)), F.log2(F.lit((1 - m) / (1 - u)))
        total = total + F.when(s >= 0.9, agree).when(s <= 0.1, differ).otherwise(differ + (agree - differ) * s)
    return 1.0 / (1.0 + F.exp(-total / 3.0))
