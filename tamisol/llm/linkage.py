"""Records of different lists that describe the same person or organisation, matched without a common key.

Probabilistic record linkage: several blocking passes propose pairs of profiles (distinct name, date and country), each pair is
reduced to levels of agreement, expectation-maximisation over the counts of all agreement patterns estimates how likely each
level is among matches and among others, and the posterior is the confidence of a match. How rare the word is that two profiles
share counts with their names: the larger the table, the more pairs are proposed by chance, but few of these by a rare word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamisol.llm import metric, names, variants
from tamisol.operators import timestamps
from tamisol.session import materialise

#: Posterior that makes a match; rounds of expectation-maximisation; weight of the prior counts that keep probabilities off 0 and 1.
ACCEPT, ROUNDS, PRIOR = 0.5, 60, 0.5

# Code, country, what its people are called, and other names, for lists that write these; all other countries are known by code and English name.
COUNTRIES = """
AE|UNITED ARAB EMIRATES|EMIRATI|UAE
AF|AFGHANISTAN|AFGHAN
AZ|AZERBAIJAN|AZERBAIJANI
BI|BURUNDI|BURUNDIAN
BR|BRAZIL|BRAZILIAN
BY|BELARUS|BELARUSIAN
CD|DR CONGO|CONGOLESE|DEMOCRATIC REPUBLIC OF THE CONGO
CF|CENTRAL AFRICAN REPUBLIC|CENTRAL AFRICAN
CO|COLOMBIA|COLOMBIAN
CU|CUBA|CUBAN
CY|CYPRUS|CYPRIOT
DE|GERMANY|GERMAN
DK|DENMARK|DANISH
EE|ESTONIA|ESTONIAN
HT|HAITI|HAITIAN
IN|INDIA|INDIAN
IQ|IRAQ|IRAQI
IR|IRAN|IRANIAN|ISLAMIC REPUBLIC OF IRAN
IS|ICELAND|ICELANDIC
LB|LEBANON|LEBANESE
LK|SRI LANKA|SRI LANKAN
LY|LIBYA|LIBYAN
ML|MALI|MALIAN
MX|MEXICO|MEXICAN
PK|PAKISTAN|PAKISTANI
RS|SERBIA|SERBIAN
RU|RUSSIA|RUSSIAN|RUSSIAN FEDERATION
SY|SYRIA|SYRIAN
TJ|TAJIKISTAN|TAJIK
TR|TÜRKIYE|TURKISH|TURKEY
UA|UKRAINE|UKRAINIAN
VE|VENEZUELA|VENEZUELAN
YE|YEMEN|YEMENI
"""
_CODES = {x: line.split("|")[0] for line in COUNTRIES.strip().split("\n") for x in line.split("|")}

_YEAR = re.compile(r"(?:1[89]|20)\d\d")
_ABOUT = re.compile(r"circa|\bca?\.|\bc\b|approx|about|around", re.IGNORECASE)


@lru_cache(4)
def _country_codes(application: str, spark: SparkSession) -> dict[str, str]:
    locale, english = spark._jvm.java.util.Locale, spark._jvm.java.util.Locale.ENGLISH
    out = {}
    for code in locale.getISOCountries():
        place = locale("", code)
        out[code] = code
        out[place.getDisplayCountry(english).upper()] = code
        try:
            out[place.getISO3Country()] = code
        except Py4JError:  # a country without a code of three letters
            continue
    return out | _CODES


def country_codes(spark: SparkSession) -> dict[str, str]:
    """Codes of all countries by their codes of two and three letters and their English names, as the JVM's locale data have them, and what COUNTRIES adds."""
    return _country_codes(spark.sparkContext.applicationId, spark)


def country(text: str | None, codes: dict[str, str] = _CODES) -> str:
    """A country's code from its code, name or adjective; other texts in upper case; '' where missing."""
    t = " ".join((text or "").upper().split())
    return codes.get(t, t)


def birth(raw: str | None, norm: str | None) -> str:
    """first day|last day|how exact: D, M or Y of the days that a date of birth can mean; '' where it names none."""
    if not norm or not raw:
        return ""
    y = int(norm[:4])
    years = sorted({int(x) for x in _YEAR.findall(raw)} | {y})
    if len(years) == 2 and not re.search(r"\d{1,4}[-/.]\d{1,2}[-/.]\d", raw):
        return f"{years[0]:04d}-01-01|{years[1]:04d}-12-31|Y"
    rest = _YEAR.sub(" ", raw, count=1) if not re.match(r"\s*\d{8}\s*$", raw) else "1 1"
    rest = re.sub(r"[T ]\d\d:\d\d.*$", "", rest)
    parts = [p for p in re.findall(r"\d+|[^\W\d_]{3,}", rest) if (p.isdigit() and int(p)) or (not p.isdigit() and not _ABOUT.match(p) and p.lower() not in ("mm", "dd", "born", "year"))]
    if len(parts) >= 2 or norm[5:] != "01-01" and norm[8:] != "01":
        return f"{norm}|{norm}|D"
    if len(parts) == 1 and norm[8:] == "01":
        return f"{norm}|{norm[:8]}31|M"
    spread = 2 if _ABOUT.search(raw) else 0
    return f"{y - spread:04d}-01-01|{y + spread:04d}-12-31|Y"


def dates_level(a: str, b: str) -> int:
    """0 they contradict, 1 one is missing, 2 inexact and a year apart, 3 inexact and possibly the same, 4 nearly the same day, 5 the same day."""
    if not a or not b:
        return 1
    (lo, hi, p), (lo2, hi2, q) = a.split("|"), b.split("|")
    if p == q == "D":
        if lo == lo2:
            return 5
        y, m, d = lo.split("-")
        y2, m2, d2 = lo2.split("-")
        if (y == y2 and (m, d) == (d2, m2)) or (y == y2) + (m == m2) + (d == d2) == 2 and (y == y2 or abs(int(y) - int(y2)) in (1, 10)):
            return 4
        return 0
    if lo <= hi2 and lo2 <= hi:
        return 3
    apart = max(int(lo[:4]) - int(hi2[:4]), int(lo2[:4]) - int(hi[:4]))
    return 2 if apart <= 1 else 0


def countries_level(a: str, b: str) -> int:
    return 1 if not a or not b else 2 if a == b else 0


def names_level(a: str, b: str) -> int:
    """0 nothing in common, 1 one telling word in common, 2 to 5 ever more alike."""
    s = names.score(a, b)
    if s >= 0.62:
        return 5 if s >= 0.96 else 4 if s >= 0.86 else 3 if s >= 0.75 else 2
    got, _, _ = names._pair_words(names.name(a).words, names.name(b).words)
    return 1 if any(x >= 0.88 and min(len(p.text), len(q.text)) >= 5 and p.text not in names.BUSINESS and p.text not in names.LEGAL for p, q, x in got) else 0


#: Levels of how rare the rarest shared word is: in up to 4 profiles, 8, 16 and so on; the last one is for pairs without such a word.
RARITIES = 18
SIZES = (6, RARITIES, 6, 3)
#: The fields of SIZES that agree or don't independently of each other: names together with the rarity of what they share, dates, countries.
FIELDS = ((0, 1), (2,), (3,))


def fit(counts: np.ndarray) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Share of matches, and for each of FIELDS the probabilities of its levels among matches and among others, from ``counts`` by level of each of SIZES.

    Pairs with nothing in common in their names are left out: they are no matches, there are the more of them the larger the table, and their dates are
    missing at another rate than those of the pairs that have to be told apart.
    """
    counts = counts.copy()
    counts[0] = 0
    total = counts.sum()
    if not total:
        return 0.0, *([np.full([SIZES[x] for x in f], 1 / np.prod([SIZES[x] for x in f])) for f in FIELDS] for _ in range(2))
    # to begin with, matches are those that agree on the name and don't contradict each other, however rare its words
    evenly = lambda levels: np.repeat(np.array(levels)[:, None] / RARITIES, RARITIES, 1)
    m = [evenly([0.005, 0.03, 0.08, 0.15, 0.25, 0.485]), np.array([0.01, 0.3, 0.01, 0.25, 0.03, 0.4]), np.array([0.03, 0.3, 0.67])]
    u = [evenly([0.6, 0.3, 0.04, 0.03, 0.02, 0.01]), np.array([0.53, 0.3, 0.04, 0.1, 0.01, 0.02]), np.array([0.5, 0.3, 0.2])]
    share, m0, u0 = 0.2, [x.copy() for x in m], [x.copy() for x in u]
    for _ in range(ROUNDS):
        post = posterior(share, m, u)
        w = counts * post
        v = counts - w
        share = float(np.clip(w.sum() / total, 1e-4, 0.999))
        for k, field in enumerate(FIELDS):
            others = tuple(x for x in range(len(SIZES)) if x not in field)
            a, b = w.sum(others) + PRIOR * m0[k], v.sum(others) + PRIOR * u0[k]
            m[k], u[k] = a / a.sum(), b / b.sum()
    return share, m, u


def posterior(share: float, m: list[np.ndarray], u: list[np.ndarray]) -> np.ndarray:
    """By level of each of SIZES; 0 for names with nothing in common, whatever else agrees."""
    a, b = share * np.einsum("ir,j,k->irjk", *m), (1 - share) * np.einsum("ir,j,k->irjk", *u)
    out = a / (a + b)
    out[0] = 0
    return out


def records(sanctions: DataFrame, conventions: DataFrame) -> DataFrame:
    """(id, source, packed, dob, nation) of every row with an id, a source and a name; dob as ``birth`` gives it."""
    rows = sanctions.filter("id is not null and source is not null and full_name is not null").select(F.col("id").cast("long").alias("id"), "source", "full_name", "nationality", "dob")
    rows = timestamps.with_conventions(rows, conventions, "source").withColumn("__day", F.lit(False))
    rows = timestamps.normalise(rows, "dob", "__day", "__order", "__zone", "norm").select("id", "source", "full_name", "nationality", "dob", "norm")

    codes = country_codes(sanctions.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names.quiet()
        for b in batches:
            _, _, full, nation, dob, norm = (c.to_pylist() for c in b.columns)
            cols = [[names.packed(t) for t in full], [birth(x, y) for x, y in zip(dob, norm, strict=True)], [country(n, codes) for n in nation]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in cols)], ["id", "source", "packed", "dob", "nation"])

    return rows.mapInArrow(scan, "id long, source string, packed string, dob string, nation string").filter("packed <> ''")


def blocks(profiles: DataFrame, common: variants.Common) -> DataFrame:
    """(word, other, profile, ...) rows by which profiles meet. Passes: a telling word with the initial of another one, an exact day of birth with
    the beginning of a telling word, and all letters of the name in alphabetical order. ``other`` splits the groups of frequent words."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, kind, word, other = [], [], [], []

            def add(i: int, k: str, w: str, o: str, take=take, kind=kind, word=word, other=other) -> None:
                take.append(i)
                kind.append(k)
                word.append(w)
                other.append(o)

            for i, (packed, dob) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for k, _, initials in variants.key_words(packed, common):
                    for o in initials or [""]:
                        add(i, "w", k, o)
                    if "|D" in dob and "+" not in k:
                        add(i, "d", dob, names.skeleton(k.strip("=~"))[:2])
                add(i, "l", "".join(sorted("".join(names.spelling(w) for w in packed.split("|")[0].split(" ") if w not in names.LEGAL))), "")
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(kind, pa.string()), pa.array(word, pa.string()), pa.array(other, pa.string())], ["profile", "kind", "word", "other"])

    return profiles.select("profile", "packed", "dob").mapInArrow(scan, "profile long, kind string, word string, other string").distinct()


def rarity(profiles: Column) -> Column:
    """The level of RARITIES of a word that so many profiles have; null is no word."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(RARITIES - 2), F.ceil(F.log2(profiles)) - 2)), F.lit(RARITIES - 1)).cast("int")


def candidate_pairs(profiles: DataFrame) -> DataFrame:
    """(a, b, rare), a <= b: pairs of profiles that share a block of any pass, each profile with itself too; telling words may differ by one edit. ``rare`` is
    the rarity of the rarest word they share, judged by how many profiles have it or one as near."""
    keys = materialise(blocks(profiles, variants.common_words(profiles.select("packed"))), "blocks")
    spelled = keys.filter("kind = 'w'")
    near = materialise(variants.near_words(spelled, spelled), "near")
    sizes = materialise(spelled.groupBy("word").agg(F.count_distinct("profile").alias("n")), "sizes")
    as_near = near.select("query", F.col("member").alias("word")).unionByName(sizes.filter(F.substring("word", 1, 1).isin(*variants.EXACT)).select(F.col("word").alias("query"), "word"))
    having = as_near.join(sizes, "word").groupBy(F.col("query").alias("word")).agg(F.sum("n").alias("having"))
    spelled = materialise(spelled.select("word", "profile", "other").join(having, "word"), "spelled")
    left = variants.reached(spelled.select("word", F.col("profile").alias("a"), "other", F.col("having").alias("having_a")), near)
    passes = left.join(spelled.select(F.col("profile").alias("b"), "word", "other", "having"), ["word", "other"]).filter("a <= b").select("a", "b", F.least("having_a", "having").alias("having"))
    exact = keys.filter("kind <> 'w'")
    same = exact.select(F.col("profile").alias("a"), "kind", "word", "other").join(exact.select(F.col("profile").alias("b"), "kind", "word", "other"), ["kind", "word", "other"]).filter("a <= b").select("a", "b", F.lit(None).cast("long").alias("having"))
    return passes.unionByName(same).groupBy("a", "b").agg(rarity(F.min("having")).alias("rare"))


def profile_links(profiles: DataFrame) -> DataFrame:
    """(a, b, confidence) of all pairs of profiles that are matches, a profile with itself included."""
    side = lambda n: profiles.select(F.col("profile").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("packed", "dob", "nation")))
    pairs = candidate_pairs(profiles).join(side("a"), "a").join(side("b"), "b").select("a", "b", "rare", "packed_a", "packed_b", "dob_a", "dob_b", "nation_a", "nation_b")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names.quiet()
        for b in batches:
            x, y, d, e, n, o = (b.column(i).to_pylist() for i in range(3, 9))
            levels = [
                [names_level(p, q) for p, q in zip(x, y, strict=True)],
                [dates_level(p, q) for p, q in zip(d, e, strict=True)],
                [countries_level(p, q) for p, q in zip(n, o, strict=True)],
                [int(names.name(p).business and names.name(q).business) for p, q in zip(x, y, strict=True)],
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(v, pa.int32()) for v in levels)], ["a", "b", "rare", "names", "dates", "nations", "business"])

    compared = materialise(pairs.mapInArrow(compare, "a long, b long, rare int, names int, dates int, nations int, business int"), "compared")
    # people and organisations have different habits of agreement; at most as many rows as there are patterns come to the driver
    counts = np.zeros((2, *SIZES))
    for r in compared.filter("a <> b").groupBy("business", "names", "rare", "dates", "nations").count().collect():
        counts[r.business, r.names, r.rare, r.dates, r.nations] = r["count"]
    post = np.stack([posterior(*fit(c)) for c in counts])
    table = [(*map(int, at), float(post[at])) for at in np.ndindex(post.shape)]
    known = F.broadcast(profiles.sparkSession.createDataFrame(table, "business int, names int, rare int, dates int, nations int, confidence double"))
    return compared.join(known, ["business", "names", "rare", "dates", "nations"]).filter(F.col("confidence") >= ACCEPT)


def linked(sanctions: DataFrame, conventions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, source, profile) of every row with a name, source and id, and (a, b, confidence) of the profiles that match, one with itself included.

    A profile stands for all rows of the same name, date and country and is known by the smallest id of these; profiles are compared once, however
    many rows have them. Missing dates and countries neither agree nor contradict; repeated rows of one id count once.
    """
    rows = materialise(records(sanctions, conventions).dropDuplicates(["id"]), "records")
    profiles = materialise(rows.groupBy("packed", "dob", "nation").agg(F.min("id").alias("profile")), "profiles")
    members = materialise(rows.join(profiles, ["packed", "dob", "nation"]).select("id", "source", "profile"), "members")
    return members, materialise(profile_links(profiles).select("a", "b", "confidence"), "linked")


def matches(sanctions: DataFrame, conventions: DataFrame) -> DataFrame:
    """(id_a, id_b, confidence), id_a < id_b: rows of different source that describe the same person or organisation, each pair of rows of what ``linked`` gives."""
    member, links = linked(sanctions, conventions)
    both = links.join(member.select(F.col("profile").alias("a"), F.col("id").alias("x"), F.col("source").alias("source_x")), "a").join(member.select(F.col("profile").alias("b"), F.col("id").alias("y"), F.col("source").alias("source_y")), "b")
    both = both.filter("source_x <> source_y and (a <> b or x < y)")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "confidence")


def classes(sanctions: DataFrame, conventions: DataFrame) -> DataFrame:
    """(relation, id_a, id_b, confidence): 'match' between profiles, and 'member' from each profile to every other row of it; nothing is written once for every pair of rows."""
    member, links = linked(sanctions, conventions)
    pairs = links.filter("a <> b").select(F.lit("match").alias("relation"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "confidence")
    return pairs.unionByName(member.filter("id <> profile").select(F.lit("member").alias("relation"), F.col("profile").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("confidence")))
