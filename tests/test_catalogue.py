"""Every query with an SQL counterpart against DuckDB on the smallest tables."""

import json
import math
import os
import re
import unicodedata
from collections import Counter
from datetime import date
from difflib import SequenceMatcher

import duckdb
import pytest

from tamisol.plans import preparation, registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW \"{f.split('.')[0]}\" AS SELECT * FROM '{TABLES}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, TABLES)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


# --- queries that SQL can't express: brute force over the same tables -------------------------------------------------
def rows_of(duck, sql):
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def run(spark, name):
    return registry.queries()[name](spark, TABLES).collect()


def fold(text):
    kept = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^\w]+", " ", kept).split())


def elements(value, path="", ords=()):
    """Every element below a listed path, by plain recursion; a value alone in a repeating path is its only element."""
    if path in preparation.RAW_PATHS:
        flat = [value]
        while any(isinstance(x, list) for x in flat):
            flat = [y for x in flat for y in (x if isinstance(x, list) else [x])]
        for n, x in enumerate(flat, 1):
            if x is not None:
                yield path, ".".join(map(str, (*ords, n)))
                if isinstance(x, dict):
                    for k, y in x.items():
                        yield from elements(y, f"{path}.{k}", (*ords, n))
    elif isinstance(value, dict):
        for k, y in value.items():
            yield from elements(y, f"{path}.{k}" if path else k, ords)
    elif isinstance(value, list):
        for y in value:
            yield from elements(y, path, ords) if isinstance(y, dict) else ()


def valid_json(text):
    while isinstance(text, str):
        try:
            text = json.loads(text, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return None
    return text


def check_normalised_names(spark, duck):
    assert {r.full_name: r.norm for r in run(spark, "normalised_names")} == {r["full_name"]: fold(r["full_name"]) for r in rows_of(duck, "SELECT DISTINCT full_name FROM sanctions")}


def check_phonetic_keys(spark, duck):
    got = {r.full_name: r for r in run(spark, "phonetic_keys")}
    assert set(got) == {r["full_name"] for r in rows_of(duck, "SELECT DISTINCT full_name FROM sanctions")}
    assert all(re.fullmatch("[A-Z0]*", r.metaphone) and re.fullmatch("[A-Z]{0,6}", r.nysiis) for r in got.values())


def cases_by_name(duck):
    cases = rows_of(duck, "SELECT * FROM prior_cases ORDER BY ordinal, case_id")
    names = {r["customer_name"] for r in rows_of(duck, "SELECT DISTINCT customer_name FROM sanctions_alerts")}
    alike = lambda a, b: SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() >= 0.8
    return {n: m for n in names if (m := [c for c in cases if alike(n, c["name_queried"])])}


def check_prior_case_match(spark, duck):
    got = {r.name: (r.total_cases, r.prior_clearances, r.prior_escalations, r.most_recent_resolution, list(r.analyst_notes)) for r in run(spark, "prior_case_match")}
    count = lambda m, v: sum(c["resolution"] == v for c in m)
    assert got == {n: (len(m), count(m, "FALSE_POSITIVE"), count(m, "ESCALATED"), m[-1]["resolution"], [c["resolution_note"] or "" for c in m]) for n, m in cases_by_name(duck).items()}


def check_screen_fuzzy(spark, duck):
    """Without dates and nationalities only equal names reach the threshold."""
    listed = [r for r in rows_of(duck, "SELECT id, full_name FROM sanctions ORDER BY id") if r["full_name"]]
    want = set()
    for r in rows_of(duck, "SELECT DISTINCT name_queried n FROM prior_cases WHERE trim(name_queried) <> ''"):
        same = [x["id"] for x in listed if fold(x["full_name"]) == fold(r["n"]) and any(w in x["full_name"].lower().replace("\u0130", "i") for w in r["n"].lower().split())]
        want |= {(r["n"], i) for i in same[:10]}
    got = run(spark, "screen_fuzzy")
    assert {(r.name, r.id) for r in got} == want and all(r.name_score >= 0.9 for r in got)


def check_triage_full(spark, duck):
    alike = cases_by_name(duck)
    got = run(spark, "triage_full")
    assert len(got) == rows_of(duck, "SELECT count(DISTINCT alert_id) n FROM sanctions_alerts")[0]["n"]
    for r in got:
        m = alike.get(r.customer_name, [])
        assert r.prior_cases.total_cases == len(m)
        adjust = min(0.1 * r.prior_cases.prior_escalations, 0.2) - min(0.05 * r.prior_cases.prior_clearances, 0.2)
        context = min(0.05 * r.adverse_media_count, 0.2) + min(0.05 * r.registry_match_count, 0.1) + min(0.05 * r.transactions.large_count, 0.15) + min(0.05 * r.transactions.international_count, 0.15)
        assert r.final_risk_score == pytest.approx(max(0, min(1, r.initial_match_score + context + adjust))) and (r.error is None) == (r.kyc_summary is not None)


def check_citation_check(spark, duck):
    got = run(spark, "citation_check")
    assert len(got) == rows_of(duck, "SELECT count(DISTINCT alert_id) n FROM sanctions_alerts")[0]["n"]
    assert all(r.citations_ok and r.numbers_ok and not r.regulation_ok and not r.hard_pass and r.words == len(r.narrative.split()) for r in got)


def check_name_sample(spark, duck):
    usable = {r["id"]: r["full_name"] for r in rows_of(duck, "SELECT id, full_name FROM sanctions WHERE length(full_name) BETWEEN 6 AND 79 AND lower(entity_type) IN ('individual', 'person')")}
    got = run(spark, "name_sample")
    assert len({r.id for r in got}) == len(got) == min(200, len(usable)) and all(usable[r.id] == r.full_name for r in got) and [r.id for r in got] == [r.id for r in run(spark, "name_sample")]


def check_synthetic_customers(spark, duck):
    got = run(spark, "synthetic_customers")
    real = {r["full_name"] for r in rows_of(duck, "SELECT full_name FROM sanctions")}
    assert len({r.customer_id for r in got}) == len(got) and all(r.derived_from_sanction in real and r.variant_type in "ABCDE" for r in got)
    assert all(r.dob is None for r in got if r.variant_type == "C") and all(r.nationality == "XX" for r in got if r.variant_type == "D")


def check_p4_found(spark, duck):
    want = {(r["id"], *e) for r in rows_of(duck, "SELECT id, raw_data FROM sanctions") if (v := valid_json(r["raw_data"])) is not None for e in elements(v)}
    got = [tuple(r) for r in run(spark, "p4_found")]
    assert set(got) == want and len(got) == len(want) > 0


def check_p4_elements(spark, duck):
    rows = run(spark, "p4_elements")
    keys = {r.node_key for r in rows}
    roots = {r["id"] for r in rows_of(duck, "SELECT id FROM sanctions")}
    assert len(keys) == len(rows) and all(r.parent_key in keys for r in rows if r.parent_path) and {r.row_key for r in rows} <= roots and all(json.loads(r.value) is not None for r in rows)


def check_p7_normalised(spark, duck):
    got = {(r.table_name, r.row_key, r.field, r.value): r.value_norm for r in run(spark, "p7_normalised")}
    values = {v for (_, _, _, v), n in got.items()}
    # what is in normal form already stays, and impossible days give nothing
    assert any(re.fullmatch(r"\d{4}-\d\d-\d\d", v) for v in values)
    for (_, _, field, v), n in got.items():
        if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
            try:
                date.fromisoformat(v)
                assert n == v
            except ValueError:
                assert n is None or n[5:] != v[5:]
        assert n is None or re.fullmatch(r"\d{4}-\d\d-\d\d" + ("" if field == "dob" else r"(T\d\d:\d\d:\d\dZ)?"), n)


def check_p7_found(spark, duck):
    want = {(r.table_name, r.row_key, r.field, r.value_norm) for r in run(spark, "p7_normalised") if r.value_norm is not None and r.value_norm != r.value}
    assert {tuple(r) for r in run(spark, "p7_found")} == want and want


def check_pairs(spark, duck):
    """The values themselves are tested on a fixture of all kinds of names."""
    want = rows_of(duck, "SELECT count(*) n FROM (SELECT DISTINCT lower(replace(customer_name, '\u0130', 'i')) a, lower(replace(matched_entity, '\u0130', 'i')) b FROM sanctions_alerts)")[0]["n"]
    for name in ("name_similarities", "alignment"):
        got = run(spark, name)
        assert len(got) == want and all(0 <= v <= 1 + 1e-9 for r in got for k, v in r.asDict().items() if k not in "ab")


check_name_similarities = check_alignment = check_pairs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, duck, name):
    globals()[f"check_{name}"](spark, duck)
