"""Substring, similarity and fuzzy joins against brute force; reviews, calls and validators on small fixtures."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tamisol.functions import arrow_metrics as A
from tamisol.functions import metrics as M
from tamisol.functions import text as T
from tamisol.operators import audit, matching, review, state
from tamisol.streaming import live


def some_names(seed, n):
    rng = random.Random(seed)
    words = ["ana", "anna", "berg", "bergen", "o'hara", "li", "józsef", "маria", "van", "der", "x", "hassan", "hasan", "ali", "trading", "co"]
    out = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(n)}
    return sorted(out | {t[: len(t) // 2] + rng.choice("abz ") + t[len(t) // 2 :] for t in list(out)[::3]} | {"", "a", "ab", "aaaa aaaa aaaa", "x" * 400})


@pytest.mark.parametrize("least", [0.8, 0.9, 0.6])
def test_similar_sequences(spark, least):
    a, b = some_names(1, 60), some_names(2, 60)
    left = spark.createDataFrame([(x, "clash") for x in [*a, None, a[0]]], "a string, b string")
    right = spark.createDataFrame([(x, "clash") for x in [*b, None]], "b string, a string")
    got = {(r.a, r.b): r.ratio for r in matching.similar_sequences(left, right, least).collect()}
    want = {(x, y): r for x in a for y in b if (r := SequenceMatcher(None, x, y).ratio()) >= least}
    assert got == pytest.approx(want)
    assert matching.similar_sequences(left.limit(0), right, least).count() == 0


def test_containing(spark):
    needles, texts = [*some_names(3, 40), "berg", "i", "an"], some_names(4, 80)
    got = {tuple(r) for r in matching.containing(spark.createDataFrame([(x,) for x in [*needles, None]], "needle string"), spark.createDataFrame([(x,) for x in [*texts, None]], "text string")).collect()}
    assert got == {(n, t) for n in needles for t in texts if n and n in t}


def brute_score(name, dob, nat, full, ldob, lnat):
    p, q = T.fold(name), T.fold(full)
    words, w = lambda t: [x for x in t.split() if x], M.WEIGHTS
    x, y = set(words(p)), set(words(q))
    lev = lambda a, b: 1 - distance(a, b) / max(len(a), len(b), 1)
    line = lambda t, o: " ".join([*sorted(t & o), *sorted(t - o)])
    initials = lambda t: "".join(v[0] for v in words(t))
    longest, jaro = max(len(p), len(q)), A.jaro(p, q)
    same = next((k for k in range(4) if len(p) <= k or len(q) <= k or p[k] != q[k]), 4)
    short = any(all(len(v) <= 2 for v in words(t)) for t in (p, q))
    s = w["exact"] * (p == q) + w["initial_collapse"] * (0 if not x or not y or initials(p) != initials(q) else 1 if short else 0.5)
    s += w["substring"] * (min(len(p), len(q)) / longest if p and q and (p in q or q in p) else 0) + w["levenshtein_sim"] * lev(p, q)
    s += w["hamming_sim"] * (sum(a == b for a, b in zip(p, q, strict=False)) / longest if longest else 1) + w["jaccard"] * (len(x & y) / len(x | y) if x | y else 1)
    s += w["sorensen_dice"] * (2 * len(x & y) / (len(x) + len(y)) if x or y else 1) + w["token_set_ratio"] * (0 if bool(x) != bool(y) else lev(line(x, y), line(y, x)))
    s += (w["metaphone_eq"] + w["dmetaphone_eq"]) * (A.metaphone(name) == A.metaphone(full)) + w["nysiis_eq"] * (A.nysiis(name) == A.nysiis(full)) + w["damerau_sim"] * A.damerau_sim(p, q) + w["lcs_sim"] * A.lcs_sim(p, q)
    s += w["jaro"] * jaro + w["jaro_winkler"] * (jaro + 0.1 * same * (1 - jaro)) + w["smith_waterman"] * A.smith_waterman(p, q) + w["needleman_wunsch"] * A.needleman_wunsch(p, q)
    return s + w["bigram_cos"] * A.bigram_cos(p, q) + w["trigram_cos"] * A.trigram_cos(p, q)  # without both soundex codes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("threshold", [0.65, 0.3])
def test_screen_fuzzy(spark, threshold):
    """Every entry that holds a word of the name is scored and judged, whatever way its candidates were found."""
    dobs, nations = [None, "1970-01-02", "2 Jan 1970", "1981", "", "unknown"], [None, "IN", "India", "RU", ""]
    rng = random.Random(5)
    people = [(n, rng.choice(dobs), rng.choice(nations)) for n in some_names(6, 25) if n.strip()] + [("ana berg", None, None), (" ", None, None), (None, None, None)]
    lists = [(i, n, rng.choice(dobs), rng.choice(nations), "s") for i, n in enumerate([*some_names(7, 30), "ana berg", "Ana  Berg", "ANA BERG"])] + [(999, None, None, None, "s")]
    p = spark.createDataFrame(people, "name string, dob string, nationality string")
    s = spark.createDataFrame(lists, "id long, full_name string, dob string, nationality string, source string")
    got = {(r.name, r.dob, r.nationality, r.id): r for r in matching.screen_fuzzy(p, s, threshold, top=1000).collect()}
    pairs = [(*a, i, f, d, n) for a in {x for x in people if x[0] and x[0].strip()} for i, f, d, n, _ in lists if f and any(w in f.lower() for w in a[0].lower().split())]
    df = spark.createDataFrame(pairs, "name string, dob string, nationality string, id long, full_name string, list_dob string, list_nationality string")
    sound = (M.soundex(F.col("name")) == M.soundex(F.col("full_name"))).cast("double") * M.WEIGHTS["soundex_eq"] + (M.refined_soundex(F.col("name")) == M.refined_soundex(F.col("full_name"))).cast("double") * M.WEIGHTS["refined_soundex_eq"]
    rows = df.select("*", sound.alias("sound"), M.dob_score(F.col("dob"), F.col("list_dob")).alias("ds"), M.nationality_score(F.col("nationality"), F.col("list_nationality")).alias("ns")).collect()
    total, want = sum(M.WEIGHTS.values()), {}
    scores = spark.createDataFrame([(k, (brute_score(*r[:3], *r[4:7]) + r.sound) / total, r.ds, r.ns) for k, r in enumerate(rows)], "k long, n double, d double, s double")
    final = {r.k: (r.n, r.p) for r in scores.select("k", "n", M.probability(F.col("n"), F.col("d"), F.col("s")).alias("p")).collect()}
    for k, r in enumerate(rows):
        if final[k][1] >= threshold:
            want[r.name, r.dob, r.nationality, r.id] = final[k]
    assert {k: (r.name_score, r.score) for k, r in got.items()} == {k: (pytest.approx(n), pytest.approx(p)) for k, (n, p) in want.items()} and want
    assert matching.screen_fuzzy(p.limit(0), s).count() == 0 and matching.screen_fuzzy(p, s.limit(0)).count() == 0


def test_longer_words_look_up_alone(spark):
    names, lists = spark.createDataFrame([("a berg",), ("a b",)], "name string"), spark.createDataFrame([(1, "Anna Berg"), (2, "Ana B"), (3, "Olaf")], "id long, full_name string")
    assert {tuple(r) for r in matching.candidates(names, lists, 3).collect()} == {("a berg", 1), ("a b", 1), ("a b", 2), ("a b", 3)}
    assert {tuple(r) for r in matching.candidates(names, lists).collect()} == {("a berg", 1), ("a berg", 2), ("a berg", 3), ("a b", 1), ("a b", 2), ("a b", 3)}


def test_one_alert_bands_and_validators(spark):
    alerts = spark.createDataFrame([("A", "c1", "Ana", "Ana Berg", "s", "0.9", None, "PENDING", "2025", None), ("B", "c2", "Bo", None, None, "0.1", None, "PENDING", "2025", None)], "alert_id string, customer_id string, customer_name string, matched_entity string, source_list string, match_score string, confidence string, status string, created_at string, disposed_at string")
    kyc = spark.createDataFrame([("c1", "Ana", "LOW"), ("c2", "Bo", "LOW")], "customer_id string, full_name string, risk_rating string")
    pay = spark.createDataFrame([("t", "c1", "2025", "9e9", "wire", "", "")], "transaction_id string, customer_id string, date string, amount string, counterparty string, category string, country string")
    one = review.review_one("A", alerts, kyc, pay).collect()
    assert [(r.alert_id, r.recommendation, r.large_count) for r in one] == [("A", "TRUE_MATCH", 1)] and one[0].components.base == 0.9 and review.review_one("Z", alerts, kyc, pay).count() == 0
    sheet = review.worksheet(review.triage(alerts, kyc, pay), review.watchlist_hits(alerts, spark.createDataFrame([(1, "ana berg", "p", "s", "IN", "2020")], "id long, full_name string, program string, source string, nationality string, listed_on string"))).filter("alert_id = 'A'").collect()[0]
    assert sheet.kyc_summary.risk_rating == "LOW" and sheet.blocked_actions == [] and sheet.sanctions_db_hits[0].nationality == "IN" and [(c.marker, c.path) for c in sheet.narrative_citations] == [("s1", "sanctions_db_hits[0]")]
    bands = spark.createDataFrame([(x,) for x in (15.0, 15.1, 20.1, 25.1, None)], "s double").select(review.sla_band(F.col("s")).alias("b")).collect()
    assert [r.b for r in bands] == ["green", "amber", "red", "late", None]
    landed = spark.createDataFrame([("a", "e1", "m2"), ("b", "", "m1"), ("c", "e2", "m1"), ("d", None, None)], "source string, etag string, last_modified string")
    known = spark.createDataFrame([("a", "e1", "m1"), ("b", "e9", "m1"), ("c", "e1", "m1")], "source string, last_etag string, last_modified string")
    assert {r.source: r.unchanged for r in state.to_fetch(landed, known).collect()} == {"a": True, "b": True, "c": False, "d": False}
    out = F.struct(F.lit("x" * 900).alias("long"), F.lit(1).alias("n"))
    assert spark.range(1).select(audit.tool_summary(out, ["n"]).alias("s"), audit.tool_summary(out, ["long"]).alias("l")).collect()[0].s == '{"n":1}'
    assert audit.narrative_overall(spark.createDataFrame([(True,), (True,)], "hard_pass boolean")).collect()[0].passed and not audit.narrative_overall(spark.createDataFrame([], "hard_pass boolean")).collect()[0].passed


def test_snapshot_and_progress(spark, tmp_path):
    log = spark.range(3)
    audit.snapshot(log, f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        audit.snapshot(log, f"{tmp_path}/copy")
    heard = []
    listener = live.Progress(lambda kind, facts: heard.append(kind) or 1 / 0)
    listener._tell("batch", rows=1)
    assert heard == ["batch"] and isinstance(listener.errors[0], ZeroDivisionError)


def test_years_and_short_outputs(spark):
    rows = spark.createDataFrame([("12/05/1978",), ("1978-1990",), ("78",), ("2150",), (None,), ("",)], "d string").select(T.safe_year(F.col("d"), 1900).alias("y")).collect()
    assert [r.y for r in rows] == [1978, 1978, 1900, 1900, 1900, 1900]
    out = spark.createDataFrame([((["a", "b"], "x", 3),)], "o struct<hits: array<string>, name: string, n: int>")
    assert out.select(audit.output_summary(F.col("o"), {"hits": "array<string>", "name": "string", "n": "int"}).alias("s")).collect()[0].s == '{"hits__count":2,"name":"x","n":3}'


def test_similar_sequences_writes_only_pairs_that_are_alike(spark):
    """Names of few letters share parts with nearly all others: every pair is bounded, none is shuffled before it is known to be alike; strings beyond 64 characters too."""
    rng = random.Random(9)
    words = ["ali", "al", "li", "ila", "ana", "an", "ala", "nali"]
    a, b = (sorted({" ".join(rng.choice(words) for _ in range(rng.choice([2, 4, 6, 30]))) for _ in range(150)} | {"", "ć" * 70, "李" * 3}) for _ in range(2))
    df = matching.similar_sequences(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"))
    rows = df.collect()
    assert {(r.a, r.b): r.ratio for r in rows} == pytest.approx({(x, y): r for x in a for y in b if (r := SequenceMatcher(None, x, y).ratio()) >= 0.8})
    assert len(rows) == len({(r.a, r.b) for r in rows}) and df._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_containing_writes_few_parts(spark):
    """Texts are shuffled with the parts that needles are looked up by, not with all of their parts; repeated parts, short needles and rare characters lose nothing."""
    rng = random.Random(11)
    texts = sorted({"".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(300)} | {"aaaaaa", "𝐀b", "a", "İx", "ab\nab"})
    needles = sorted({t[5 : 5 + rng.choice([1, 2, 3, 9, 20])] for t in texts[:60]} | {"aaa", "𝐀", "𝐀b", "zzz", "ab\na"} - {""})
    df = matching.containing(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string"))
    rows = [tuple(r) for r in df.collect()]
    assert set(rows) == {(n, t) for n in needles for t in texts if n and n in t} and len(rows) == len(set(rows))
    long = matching.containing(spark.createDataFrame([(t[:20],) for t in texts[:10]], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string"))
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert long.count() >= 10 and plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_candidates_are_counted_without_pairs(spark):
    """Words of one letter stand in nearly all entries: no pair is written. Repeated ids count once, null ones don't, short and odd words are found."""
    rng = random.Random(13)
    people = [*some_names(8, 60), "a", "𝐀 zz", "o'", "É", None, "zzz"]
    entries = [(i % 180, n) for i, n in enumerate(some_names(9, 120) * 2)] + [(500, "𝐀nna"), (501, "a"), (501, "É x"), (502, None), (None, "qqzzzqq")] + [(600 + i, rng.choice(["ana b", "li x"])) for i in range(200)]
    df = matching.candidate_counts(spark.createDataFrame([(n,) for n in people], "name string"), spark.createDataFrame(entries, "id long, full_name string"))
    want = {}
    for n in {p for p in people if p}:
        held = [i for i, t in entries if t and any(w in t.lower() for w in n.lower().split())]
        if held:
            want[n] = len({i for i in held if i is not None})
    assert {r.name: r.candidates for r in df.collect()} == want and want["zzz"] == 0
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
