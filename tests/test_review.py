"""Matching, review, audit and state: fixtures with known results, brute force, edge cases."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tamisol.functions import arrow_metrics as A
from tamisol.operators import audit, matching, review, skew, state

ALERT = "alert_id string, customer_id string, customer_name string, matched_entity string, source_list string, match_score string, confidence string, status string, created_at string, sla_deadline string, dob string, nationality string, disposed_at string, analyst_note string"


def alerts(spark, rows):
    base = {"status": "PENDING", "created_at": "2025-01-01T00:00:00+00:00", "sla_deadline": "2025-01-02T00:00:00+00:00"}
    names = [c.split()[0] for c in ALERT.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], ALERT)


def test_containing_equals_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(200)]
    needles = [t[i : i + n] for t in texts[:60] for i, n in [(rng.randrange(3), rng.randrange(6))]] + ["", "zzz", "ab%", None]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in [*texts, None]], "text string")
    got = {tuple(r) for r in matching.containing(n, t).collect()}
    assert got == {(x, y) for x in set(needles) - {None, ""} for y in set(texts) if x in y}
    assert matching.containing(n.limit(0), t).count() == 0 == matching.containing(n, t.limit(0)).count()


def test_similar_sequences_equals_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 22))) for _ in range(60)]
    a = base + [x[:-1] for x in base]
    b = ["".join(c if rng.random() > 0.08 else rng.choice("xyz") for c in x) for x in base] + ["", "q"]
    a.append("")
    x, y = spark.createDataFrame([(v,) for v in [*a, None]], "a string"), spark.createDataFrame([(v,) for v in b], "b string")
    got = {(r.a, r.b) for r in matching.similar_sequences(x, y).collect()}
    assert got == {(p, q) for p in set(a) for q in set(b) if SequenceMatcher(None, p, q).ratio() >= 0.8}


def test_join_groups_equals_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_GROUPS", 2)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "id long, k string")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    want = sorted(map(tuple, rows.join(groups, "k").select("id", "k", "n", "least").collect()))
    assert sorted(map(tuple, skew.join_groups(rows, groups, "k", "n").select("id", "k", "n", "least").collect())) == want


def test_exact_and_fuzzy_screening(spark):
    lists = spark.createDataFrame([(1, "Berg, Anna", "Berg", "1960-01-02", "DE", "x"), (2, "Anna Bergmann", "Bergmann", None, None, "x"), (3, "Olaf Stone", "Stone", "1950", "NO", "y"), (4, None, None, None, None, "y")], "id long, full_name string, last_name string, dob string, nationality string, source string")
    names = spark.createDataFrame([("berg",), ("nobody",), ("STONE",)], "name string")
    got = {r.name: (list(r.hits), r.verdict) for r in matching.screen_exact(names, lists).collect()}
    assert got == {"berg": ([1, 2], "BLOCKED"), "nobody": ([], "CLEAR"), "STONE": ([3], "BLOCKED")}
    people = spark.createDataFrame([("Anna Berg", "1960-01-02", "DE"), ("Olaf Stone", None, None), ("  ", None, None), ("Unknown Person", None, None)], "name string, dob string, nationality string")
    rows = matching.screen_fuzzy(people, lists).collect()
    assert {(r.name, r.id) for r in rows} >= {("Anna Berg", 1), ("Olaf Stone", 3)} and all(r.score >= 0.65 for r in rows)
    best = next(r for r in rows if r.name == "Olaf Stone")
    assert best.name_score == pytest.approx(1 - 1 / 44.1)  # equal initials of full words count half
    assert best.score == pytest.approx(0.6506, abs=1e-3) and best.rank == 1


def test_rule_score_limits(spark):
    rows = [(0.90, 0, 0, 0, 0, 0, 0, 0), (0.85, 0, 0, 0, 0, 0, 0, 0), (0.70, 0, 0, 0, 0, 0, 0, 0), (0.80, 0, 0, 0, 0, 0, 4, 0), (0.80, 0, 0, 0, 0, 0, 99, 0), (0.50, 4, 0, 0, 0, 0, 0, 0), (0.50, 99, 0, 0, 0, 0, 0, 0), (0.99, 9, 1, 9, 9, 0, 0, 9)]
    df = spark.createDataFrame(rows, "base double, adverse int, ubo int, large int, intl int, escalations int, clearances int, registry int")
    final, context, adjust = review.rule_score(F.col("base"), {k: F.col(k) for k in review.FACTORS})
    got = df.select(final.alias("f"), context.alias("c"), adjust.alias("a"), review.verdict(final).alias("v")).collect()
    assert [r.v for r in got[:3]] == ["TRUE_MATCH", "TRUE_MATCH", "UNCERTAIN"] and got[1].f == 0.85
    assert got[3].f < 0.8 and got[3].a < 0 and got[4].a == pytest.approx(-0.2) and got[5].c > 0
    assert got[6].c == pytest.approx(0.2) and got[6].f == pytest.approx(0.7) and 0 <= got[7].f <= 1


def test_positions():
    assert review.queue_positions(7) == list(range(7)) and review.queue_positions(12) == [0, 1, 2, 3, 5, 6, 8, 9, 10, 11]
    assert review.queue_positions(11) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert review.even_positions(5, 9) == list(range(5)) and review.even_positions(101, 3) == [0, 50, 100] and len(review.even_positions(7, 6)) == 6 and review.even_positions(3, 1) == [0]


def test_alert_queries(spark):
    rows = [{"alert_id": f"A{i:02}", "match_score": f"{i / 40:.3f}", "customer_name": f"N{i}"} for i in range(30)]
    rows += [rows[3], {**rows[3], "status": "CLEARED", "created_at": "2025-02-01T00:00:00+00:00"}, {"alert_id": None}, {"alert_id": "B", "match_score": "0", "confidence": "0.9", "status": "CLEARED"}]
    a = alerts(spark, rows)
    assert review.current(a).count() == 31 and review.current(a).filter("alert_id = 'A03'").collect()[0].status == "CLEARED"
    queue = [r.alert_id for r in review.pending_queue(a).orderBy("score").collect()]
    assert queue[:3] == ["A00", "A01", "A02"] and queue[-3:] == ["A27", "A28", "A29"] and len(queue) == 10
    assert review.even_sample(a, 5).count() == 5 and [r.band for r in review.scenario_queue(a).collect()] == [0, 0, 1, 1, 2, 0]
    decisions = spark.createDataFrame([("A01", "cleared", "fine"), ("A02", "maybe", None), ("ZZ", "ESCALATED", None), ("A04", "escalated", None)], "alert_id string, decision string, analyst_note string")
    done, rejected = review.dispose(review.current(a), decisions, "now")
    by = {r.alert_id: r for r in done.collect()}
    assert by["A01"].status == "CLEARED" and by["A01"].analyst_note == "fine" and by["A04"].status == "ESCALATED" and by["A02"].status == "PENDING" and by["A02"].disposed_at is None
    assert {(r.alert_id, r.error) for r in rejected.collect()} == {("A02", 400), ("ZZ", 404)}
    assert all(r.overdue for r in review.overdue(a, "2025-03-01T00:00:00Z").collect())
    made = review.create_alerts(spark.createDataFrame([("x", "C1"), ("y", None)], "customer_name string, customer_id string")).collect()
    assert all(len(r.alert_id) == 14 and r.status == "PENDING" for r in made) and {r.customer_id[:5] for r in made} <= {"C1", "CUST-"}
    assert review.pending_queue(a.limit(0)).count() == 0


def test_evidence_and_worksheet(spark):
    a = alerts(spark, [{"alert_id": "A1", "customer_id": "C1", "customer_name": "Anna Berg", "matched_entity": "berg", "match_score": "0.8"}, {"alert_id": "A2", "customer_id": "C9", "customer_name": "Zed", "match_score": "x"}, {"alert_id": "A3"}])
    kyc = spark.createDataFrame([("C1", "Anna Berg", "LOW")], "customer_id string, full_name string, risk_rating string")
    tx = spark.createDataFrame([(f"T{i:02}", "C1", f"2025-01-{i + 1:02}", amount, "EUR", "DE", "DEBIT", "TRANSFER", who) for i, (amount, who) in enumerate([("900000", "Wire In"), ("x", None), ("600000", "shop")] + [("1", "shop")] * 9)] + [("T00", "C1", "2025-01-01", "900000", "EUR", "DE", "DEBIT", "TRANSFER", "Wire In")], "transaction_id string, customer_id string, date string, amount string, currency string, country string, txn_type string, category string, counterparty string")
    flags = review.transaction_flags(tx).collect()[0]
    assert (flags.total, flags.large_count, flags.international_count, flags.suspicious_pattern) == (10, 1, 0, False)  # the two oldest are beyond the newest ten
    cases = spark.createDataFrame([("K1", "anna berg", "FALSE_POSITIVE", "old", 2), ("K2", "Anna Berg", "ESCALATED", None, 1)], "case_id string, name_queried string, resolution string, resolution_note string, ordinal int")
    lists = spark.createDataFrame([(1, "Sandberg, Ola", "P", "s"), (2, "Stone", "P", "s")], "id long, full_name string, program string, source string")
    hits = review.watchlist_hits(a, lists)
    assert sorted((r.alert_id, r.id) for r in hits.collect()) == [("A1", 1), ("A3", 1), ("A3", 2)]
    rows = {r.alert_id: r for r in review.triage(a, kyc, tx, cases).collect()}
    assert rows["A1"].total_cases == 2 and rows["A1"].most_recent_resolution == "FALSE_POSITIVE" and list(rows["A1"].analyst_notes) == ["", "old"]
    assert rows["A1"].final_risk_score == pytest.approx(0.8 + 0.05 + 0.10 - 0.05) and rows["A2"].error == "no customer C9" and rows["A2"].recommendation is None
    sheet = {r.alert_id: r for r in review.worksheet(review.triage(a, kyc, tx, cases), hits).collect()}
    assert sheet["A1"].narrative.startswith("Initial match score 0.80 against 'berg'. 1 sanctions.db hit(s).") and sheet["A1"].narrative_citations[0].marker == "s1" and sheet["A2"].sanctions_db_hits == []
    memory = spark.createDataFrame([("anna  berg", "", "2025-01-02"), ("anna berg", "1999", "2025-01-03")], "customer_name string, dob string, resolved_at string")
    assert review.cleared_before(a, memory).count() == 2
    total = {r.factor: r.contribution for r in review.contributions(review.triage(a, kyc, tx, cases)).filter("alert_id = 'A1'").collect()}
    assert total["escalations"] == pytest.approx(0.1) and total["clearances"] == pytest.approx(-0.05) and total["large"] == pytest.approx(0.05)


LOG = "alert_id string, event string, tool string, tool_input string, tool_output_summary string, reason string, ts string"


def test_audit(spark):
    log = audit.append_hashes(spark.createDataFrame([("A", "tool_call", "kyc", "{}", None, None, "1"), ("A", "tool_blocked", "close_alert", None, None, "no", "2"), ("B", "tool_call", "ubo", None, None, None, "3")], LOG))
    assert audit.tampered(log).count() == 0 and audit.tampered(log.withColumn("tool", F.lit("x"))).count() == 3
    s = {r.alert_id: r for r in audit.summary(log).collect()}
    assert s["A"].total_events == 2 and list(s["A"].tools_called) == ["kyc"] and s["A"].blocked == 1 and s["A"].intact
    assert [r.ts for r in audit.tail(log, 2).collect()] == ["3", "2"] and audit.tail(log, 5, "B").count() == 1
    attempts = audit.close_attempts(spark.createDataFrame([("A",), ("B",)], "alert_id string"), "t")
    rate = audit.block_rate(attempts).collect()[0]
    assert (rate.attempts, rate.blocked, rate.successes, rate.rate, rate.passed) == (6, 6, 0, 1.0, True) and not audit.block_rate(attempts.limit(0)).collect()[0].passed
    cols = sorted(audit.HASHED)
    got = log.select(audit.entry_hash_compatible(F.struct(*cols)).alias("h"), *cols).collect()
    import hashlib

    for r in got:
        body = {c: r[c] for c in cols}
        if body["tool_input"] == "{}":
            body["tool_input"] = {}
        assert r.h == hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def test_evaluations(spark):
    e = spark.createDataFrame([("A", "kyc", "llm", 1), ("A", "kyc", "fill", 2), ("A", "ubo", "fill", 3), ("B", "kyc", "fill", 1), ("B", "kyc", "llm", 2)], "alert_id string, tool string, source string, seq int")
    assert {(r.alert_id, r.tool): (r.true_fills, r.redundant_fills) for r in audit.fills(e).collect()} == {("A", "kyc"): (0, 1), ("A", "ubo"): (1, 0), ("B", "kyc"): (1, 0)}
    assert {r.tool: r.rate for r in audit.fill_rates(e).collect()} == {"kyc": 0.5, "ubo": 0.5} and audit.headline_fill_rate(e).collect()[0].rate == 0
    assert {r.alert_id: (r.llm_tools, r.all_tools, r.complete) for r in audit.coverage(e, 2).collect()} == {"A": (1, 2, True), "B": (1, 1, False)}
    runs = spark.createDataFrame([("A", 1, "U", 0.66, ""), ("A", 2, "U", 0.66, ""), ("B", 1, "U", 0.7, ""), ("B", 2, "T", 0.9, None), ("C", 1, None, None, "x"), ("C", 2, "U", 0.8, "")], "alert_id string, run int, verdict string, score double, error string")
    c = {r.alert_id: r for r in audit.consistency(runs, 2).collect()}
    assert c["A"].verdict_consistent and c["A"].score_consistent and c["A"].fragile and not c["B"].verdict_consistent and c["B"].spread == pytest.approx(0.2) and c["C"].ok_runs == 1 and not c["C"].verdict_consistent
    t = audit.consistency_totals(audit.consistency(runs, 2)).collect()[0]
    assert (t.alerts, t.consistent, t.drifting, t.fragile) == (3, 1, 2, 1)
    n = spark.createDataFrame([("Per PMLA, score 0.80 [cite:s1] and 80% sure.", ["s1"], 0.8, ["3"]), ("Score 0.20, 10% [cite:m2].", ["s1"], 0.8, []), ("", None, 0.8, None)], "narrative string, markers array<string>, final double, known array<string>")
    got = audit.narrative_checks(n).collect()
    assert got[0].hard_pass and not got[1].citations_ok and not got[1].numbers_ok and not got[1].regulation_ok and got[2].words == 0
    used, loose = audit.marker_use(spark.createDataFrame([("A", "x [cite:s1] [cite:m2]")], "alert_id string, narrative string"), spark.createDataFrame([("A", "s1")], "alert_id string, marker string"))
    assert [r.marker for r in used.collect()] == ["s1"] and [r.marker for r in loose.collect()] == ["m2"]
    d = audit.dashboard(spark.createDataFrame([("A", "alert_start", None, "2025-01-01 00:00:00"), ("A", "tool_call", None, "2025-01-01 00:00:03"), ("A", "alert_complete", "TRUE_MATCH", "2025-01-01 00:00:06"), ("B", "alert_start", None, "2025-01-01 00:00:00")], "alert_id string, type string, verdict string, ts string"), 2).collect()[0]
    assert (d.processed, d.tools_fired, d.blocked, d.latency, d.true_match, d.trend_processed, d.trend_latency) == (1, 1, 0, 6.0, 1, 50.0, 40.0)


def test_state(spark, tmp_path):
    path = str(tmp_path / "lists")
    rows = lambda *r: state.as_entries(spark.createDataFrame(r, "source string, full_name string, dob string"))
    state.replace_source(rows(("a", "x", "1962"), ("b", "y", None)), path)
    state.replace_source(rows(("a", "z", "")), path)
    state.replace_source(rows(("a", "z", "")).limit(0), path)
    got = {(r.source, r.full_name, r.dob_normalized) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "z", ""), ("b", "y", "")}
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int"), spark.createDataFrame([("b", 9)], "source string, v int")
    assert sorted((r.source, r.v) for r in state.replaced(old, new).collect()) == [("a", 1), ("b", 9)]
    key = lambda *r: spark.createDataFrame(r, "k string, t string, v int")
    assert sorted(map(tuple, state.upserted(key(("a", "1", 1), ("b", "1", 1)), key(("a", "0", 2), ("b", "1", 3), ("c", None, 4)), "k", "t").collect())) == [("a", "1", 1), ("b", "1", 3), ("c", None, 4)]
    assert [r.k for r in state.without_prefix(key(("CUST-1", "", 1), (None, "", 2), ("X", "", 3)), "k", "CUST-").orderBy("v").collect()] == [None, "X"]
    landed, known = spark.createDataFrame([("a", "text"), ("b", "text"), ("c", "new")], "source string, content string"), spark.createDataFrame([("a", "1cb251ec0d568de6a929b520c4aed8d1"), ("b", "x")], "source string, last_hash string")
    assert {r.source: r.changed for r in state.changed_sources(landed, known).collect()} == {"a": False, "b": True, "c": True}
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert [r.a for r in state.read_jsonl(spark, str(log), "a int").orderBy("a").collect()] == [1, 2]
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"case_id": "K1", "name_queried": "x"}, {"case_id": "K2", "resolution": "ESCALATED"}]))
    assert [(r.ordinal, r.case_id) for r in state.read_cases(spark, str(cases)).collect()] == [(1, "K1"), (2, "K2")]


def test_registered_functions(spark):
    A.register(spark)
    r = spark.sql("SELECT jaro('martha', 'marhta') j, metaphone('Phil') m").collect()[0]
    assert r.j == pytest.approx(0.944444, abs=1e-6) and r.m == "FL"
