"""Name similarities of all alert pairs against brute force, beyond plain letters."""

import math
from collections import Counter

import pytest

from tamisol.functions import arrow_metrics as A
from tamisol.plans import registry

NAMES = [("Ana Berg", "Berg Ana"), ("José Núñez", "NUÑEZ, José"), ("O'Hara-Lee", "ohara lee"), ("李 小龙", "李小龙"), ("İpek Çelik", "Ipek Celik"), ("Мария", "Марина"), ("𝐀nna", "Anna"), (None, "Ana"), ("", "Ana"), (None, None), ("", ""), ("x", None)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def lev_sim(a, b):
    return 1 - levenshtein(a, b) / max(len(a), len(b), 1)


def cosine(a, b, n):
    grams = lambda t: Counter(t[i : i + n] for i in range(max(1, len(t) - n + 1)))
    x, y = grams(f" {a} "), grams(f" {b} ")
    return sum(x[g] * y[g] for g in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def brute(a, b):
    x, y, longest = set(a.split()), set(b.split()), max(len(a), len(b))
    line = lambda t, o: " ".join([*sorted(t & o), *sorted(t - o)])
    j, p = A.jaro(a, b), 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    initials = lambda t: "".join(w[0] for w in t.split())
    short = any(all(len(w) <= 2 for w in t) for t in (x, y))
    return {
        "levenshtein_sim": lev_sim(a, b), "hamming_sim": sum(c == d for c, d in zip(a, b, strict=False)) / longest if longest else 1, "jaro": j, "jaro_winkler": j + 0.1 * p * (1 - j),
        "jaccard": len(x & y) / len(x | y) if x | y else 1, "sorensen_dice": 2 * len(x & y) / (len(x) + len(y)) if x | y else 1, "token_set_ratio": 0 if bool(x) != bool(y) else lev_sim(line(x, y), line(y, x)),
        "bigram_cos": cosine(a, b, 2), "trigram_cos": cosine(a, b, 3), "exact": float(a == b), "substring_sim": min(len(a), len(b)) / longest if a and b and (a in b or b in a) else 0,
        "initial_collapse": 0 if not x or not y or initials(a) != initials(b) else 1 if short else 0.5,
    }


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pairs"))
    spark.createDataFrame([*NAMES, NAMES[0]], "customer_name string, matched_entity string").write.parquet(f"{d}/sanctions_alerts.parquet")
    return d


def lower(t):
    return t and t.replace("İ", "i").lower()


@pytest.mark.parametrize("name", ["name_similarities", "alignment"])
def test_all_pairs(spark, tables, name):
    rows = registry.queries()[name](spark, tables).collect()
    assert Counter((r.a, r.b) for r in rows) == Counter((lower(a), lower(b)) for a, b in NAMES)
    for r in rows:
        a, b = r.a or "", r.b or ""
        want = brute(a, b) if name == "name_similarities" else {f.__name__: f(a, b) for f in (A.damerau_sim, A.lcs_sim, A.smith_waterman, A.needleman_wunsch)}
        assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-8), (a, b)
