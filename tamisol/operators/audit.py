"""The audit trail and the figures that evaluations and dashboards draw from it."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamisol.functions.text import word_count
from tamisol.operators.review import current, entity_of, verdict_margin

# The tools of a review, those the model may leave out, the policy-blocked one, and the margin below which a verdict is fragile.
TOOLS = ("sanctions_screening", "dynamodb_kyc", "adverse_media", "company_registry", "ubo_chain", "prior_cases")
ELIGIBLE = ("sanctions_screening", "dynamodb_kyc")
BLOCKED_TOOL, ATTEMPTS, FRAGILE, EPSILON = "close_alert", 3, 0.03, 1e-9
HASHED = ("alert_id", "event", "reason", "tool", "tool_input", "tool_output_summary", "ts")


def entry_hash(*columns: str) -> Column:
    """SHA-256 of the seven fields as JSON with sorted keys; missing fields are left out. A documented form of our own, all built-in."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in (columns or HASHED)))), 256)


def _entry_hash_compatible(rows: pd.DataFrame) -> pd.Series:
    """The same over the bytes that Python's json.dumps(sort_keys=True) writes: blanks after separators, escapes, nulls kept. Texts that hold JSON are embedded as such."""

    def value(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        try:
            found = json.loads(v)
        except ValueError:
            return v
        return found if isinstance(found, dict | list) else v

    return pd.Series([hashlib.sha256(json.dumps({k: value(r[k]) for k in sorted(rows.columns)}, sort_keys=True, default=str).encode()).hexdigest() for r in rows.to_dict("records")])


entry_hash_compatible = F.pandas_udf(_entry_hash_compatible, StringType())


def append_hashes(events: DataFrame) -> DataFrame:
    return events.withColumn("sha256", entry_hash())


def tampered(log: DataFrame) -> DataFrame:
    """Entries whose hash isn't that of their fields."""
    return log.filter(~F.col("sha256").eqNullSafe(entry_hash()))


def summary(log: DataFrame) -> DataFrame:
    """(alert_id, total_events, tools_called, blocked, intact): intact is recomputed from the hashes."""
    return log.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.array_sort(F.collect_set(F.when(F.col("event") == "tool_call", F.col("tool")))).alias("tools_called"),
        F.count_if(F.col("event") == "tool_blocked").alias("blocked"), F.bool_and(F.col("sha256").eqNullSafe(entry_hash())).alias("intact"),
    )


def tail(log: DataFrame, n: int, alert_id: str | None = None) -> DataFrame:
    """The last n (at most 1,000) entries, newest first; ties by hash."""
    rows = log if alert_id is None else log.filter(F.col("alert_id") == alert_id)
    return rows.orderBy(F.desc("ts"), "sha256").limit(min(n, 1000))


def output_summary(output: Column, kind: dict[str, str]) -> Column:
    """A tool's output in short: arrays by their number of elements, the first eight other fields as they are."""
    cols = [F.size(output[k]).alias(f"{k}__count") if t.startswith("array") else output[k].alias(k) for k, t in list(kind.items())[:8]]
    return F.left(F.to_json(F.struct(*cols)), F.lit(600))


def tool_summary(output: Column, keys: list[str]) -> Column:
    """The chosen keys of a tool's output as JSON, cut at 600 characters."""
    return F.left(F.to_json(F.struct(*(output[k].alias(k) for k in keys))), F.lit(600))


def covers(have: Column, want: Column) -> Column:
    """Whether every element of ``want`` is in ``have``; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(want, none), F.coalesce(have, none))) == 0


def timeline(events: DataFrame, category: str | None = None, text: str | None = None, category_column: str = "category", text_column: str = "text") -> DataFrame:
    """Events of a category whose text holds ``text``, whatever the case; None doesn't restrict."""
    rows = events if category is None else events.filter(F.col(category_column) == category)
    return rows if not text else rows.filter(F.lower(text_column).contains(text.lower()))


def recent(events: DataFrame, order: str, key: str, most: int = 500) -> DataFrame:
    """The newest ``most`` events, as a bounded buffer holds them; ties by key."""
    return events.orderBy(F.desc(order), F.desc(key)).limit(most)


def snapshot(log: DataFrame, path: str) -> None:
    """A copy of the audit trail as it is now; an existing one is an error, as snapshots aren't overwritten."""
    log.write.mode("error").parquet(path)


def needed_calls(alerts: DataFrame, calls: DataFrame) -> DataFrame:
    """(alert_id, tool, reason): what must be run again after a review. Screening only if it wasn't run, the customer's data if they weren't fetched or for
    another customer, and every other tool always, with the alert's own names, as long as these aren't empty.

    Calls: alert_id, tool, customer_id. The first tool of TOOLS is the screening, the second the customer's data.
    """
    screening, customer, *others = TOOLS
    made = calls.groupBy("alert_id").agg(F.bool_or(F.col("tool") == screening).alias("screened"), F.collect_set(F.when(F.col("tool") == customer, F.col("customer_id"))).alias("fetched"))
    a = current(alerts).join(made, "alert_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    fetched = F.coalesce("fetched", F.array().cast("array<string>"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    row = lambda tool, when, reason: F.when(when, F.struct(F.lit(tool).alias("tool"), reason.alias("reason")))
    wanted = F.array(
        row(screening, no(F.col("screened")), F.lit("missing")),
        row(customer, no(F.array_contains(fetched, F.col("customer_id"))), F.when(F.size(fetched) == 0, "missing").otherwise("other customer")),
        *(row(t, filled(F.col("customer_id")) & filled(entity_of()), F.lit("always")) for t in others),
    )
    return a.select("alert_id", F.inline(F.filter(wanted, lambda w: w.isNotNull())))


def close_attempts(alerts: DataFrame, ts: str) -> DataFrame:
    """The attempts to close each alert that policy blocks."""
    rows = alerts.select("alert_id", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))).alias("attempt"))
    return append_hashes(rows.select("alert_id", F.lit("tool_blocked").alias("event"), F.lit(BLOCKED_TOOL).alias("tool"), F.concat(F.lit('{"attempt": '), "attempt", F.lit("}")).alias("tool_input"), F.lit(None).cast("string").alias("tool_output_summary"), F.lit("blocked by policy").alias("reason"), F.lit(ts).alias("ts")))


def block_rate(log: DataFrame) -> DataFrame:
    """(attempts, blocked, successes, rate, passed) of attempts to close an alert."""
    rows = log.filter(F.col("tool") == BLOCKED_TOOL).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event") == "tool_blocked").alias("blocked"), F.count_if(F.col("event") == "tool_call").alias("successes"))
    rate = F.when(F.col("attempts") > 0, F.col("blocked") / F.col("attempts")).otherwise(0.0)
    return rows.withColumn("rate", rate).withColumn("passed", (F.col("rate") == 1) & (F.col("successes") == 0) & (F.col("attempts") > 0))


def fills(events: DataFrame) -> DataFrame:
    """(alert_id, tool, true_fills, redundant_fills): a fill is true if the model hasn't called that tool on that alert before. Events: alert_id, tool, source, seq."""
    before = F.max((F.col("source") == "llm").cast("int")).over(W.partitionBy("alert_id", "tool").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = events.withColumn("__llm", before).filter(F.col("source") == "fill")
    return rows.groupBy("alert_id", "tool").agg(F.count_if(F.col("__llm") == 0).alias("true_fills"), F.count_if(F.col("__llm") == 1).alias("redundant_fills"))


def fill_rates(events: DataFrame) -> DataFrame:
    """(tool, true_fills, redundant_fills, rate): rate against the number of alerts."""
    n = events.agg(F.count_distinct("alert_id").alias("alerts"))
    return fills(events).groupBy("tool").agg(F.sum("true_fills").alias("true_fills"), F.sum("redundant_fills").alias("redundant_fills")).join(n).withColumn("rate", F.col("true_fills") / F.col("alerts")).drop("alerts")  # n is one row


def headline_fill_rate(events: DataFrame) -> DataFrame:
    """True fills of the two tools the model may call, by twice the number of alerts."""
    n = events.agg(F.count_distinct("alert_id").alias("alerts"))
    return fills(events).filter(F.col("tool").isin(*ELIGIBLE)).agg(F.coalesce(F.sum("true_fills"), F.lit(0)).alias("true_fills")).join(n).withColumn("rate", F.col("true_fills") / (F.col("alerts") * len(ELIGIBLE)))


def coverage(events: DataFrame, want: int = len(TOOLS)) -> DataFrame:
    """(alert_id, llm_tools, all_tools, complete): distinct tools called by the model and by anyone."""
    return events.groupBy("alert_id").agg(F.count_distinct(F.when(F.col("source") == "llm", F.col("tool"))).alias("llm_tools"), F.count_distinct("tool").alias("all_tools")).withColumn("complete", F.col("all_tools") >= want)


def coverage_totals(rows: DataFrame) -> DataFrame:
    """(alerts, mean_llm_tools, mean_all_tools, all_complete) of what ``coverage`` gives."""
    return rows.agg(F.count(F.lit(1)).alias("alerts"), F.avg("llm_tools").alias("mean_llm_tools"), F.avg("all_tools").alias("mean_all_tools"), F.coalesce(F.bool_and("complete"), F.lit(False)).alias("all_complete"))


def fills_by_tool(events: DataFrame) -> DataFrame:
    """(tool, calls, fills, fill_share): how often each tool was called, and by a fill."""
    filled = F.count_if(F.col("source") == "fill")
    return events.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), filled.alias("fills"), (filled / F.count(F.lit(1))).alias("fill_share"))


def narrative_overall(checked: DataFrame) -> DataFrame:
    """(narratives, hard_passes, passed) of what ``narrative_checks`` gives: passed if there are any and all pass."""
    n = F.count(F.lit(1))
    return checked.agg(n.alias("narratives"), F.count_if("hard_pass").alias("hard_passes"), ((n > 0) & F.coalesce(F.bool_and("hard_pass"), F.lit(False))).alias("passed"))


def consistency(runs: DataFrame, want: int) -> DataFrame:
    """(alert_id, ok_runs, verdicts, spread, verdict_consistent, score_consistent, margin, fragile) over repeated runs; failed runs have an error."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    rows = runs.groupBy("alert_id").agg(
        F.count_if(ok).alias("ok_runs"), F.count_distinct(F.when(ok, F.col("verdict"))).alias("verdicts"), (F.max(F.when(ok, F.col("score"))) - F.min(F.when(ok, F.col("score")))).alias("spread"), F.min_by(F.when(ok, F.col("score")), F.when(ok, F.col("run"))).alias("__score")
    )
    all_ok = F.col("ok_runs") == want
    rows = rows.withColumns({"verdict_consistent": all_ok & (F.col("verdicts") == 1), "score_consistent": all_ok & F.coalesce(F.col("spread") <= EPSILON, F.lit(False)), "margin": verdict_margin(F.col("__score"))})
    return rows.withColumn("fragile", F.coalesce(F.col("margin") < FRAGILE, F.lit(False))).drop("__score")


def consistency_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("alerts"), F.count_if("verdict_consistent").alias("consistent"), F.count_if(~F.col("score_consistent")).alias("drifting"), F.count_if("fragile").alias("fragile"))


def batch_summary(triaged: DataFrame) -> DataFrame:
    """(processed, crashed, mean_score, true_match, uncertain, false_positive); rows with an error count as crashed and in nothing else."""
    ok = F.col("error").isNull()
    of = lambda v: F.count_if(ok & (F.col("recommendation") == v)).alias(v.lower())
    return triaged.agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("crashed"), F.avg(F.when(ok, F.col("final_risk_score"))).alias("mean_score"), of("TRUE_MATCH"), of("UNCERTAIN"), of("FALSE_POSITIVE"))


def dashboard(events: DataFrame, total: int) -> DataFrame:
    """Processed alerts, tools fired, blocks, mean seconds from start to completion, verdict counts, and trends in per cent of what is expected, capped. Events: alert_id, type, verdict, ts."""
    per = events.groupBy("alert_id").agg(
        F.min(F.when(F.col("type") == "alert_start", F.col("ts"))).alias("began"), F.max(F.when(F.col("type") == "alert_complete", F.col("ts"))).alias("ended"), F.count_if(F.col("type") == "tool_call").alias("tools"),
        F.count_if(F.col("type") == "tool_blocked").alias("blocks"), F.max(F.when(F.col("type") == "alert_complete", F.col("verdict"))).alias("verdict"),
    )
    seconds = F.col("ended").cast("timestamp").cast("double") - F.col("began").cast("timestamp").cast("double")
    rows = per.agg(
        F.count_if(F.col("ended").isNotNull()).alias("processed"), F.sum("tools").alias("tools_fired"), F.sum("blocks").alias("blocked"), F.avg(seconds).alias("latency"),
        *(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("TRUE_MATCH", "UNCERTAIN", "FALSE_POSITIVE")),
    )
    trend = lambda c, most: F.least(F.lit(100.0), F.coalesce(c, F.lit(0)) / most * 100)
    return rows.withColumns({"trend_processed": trend(F.col("processed"), F.lit(max(total, 1))), "trend_tools": trend(F.col("tools_fired"), F.lit(max(total * 8, 1))), "trend_blocks": trend(F.col("blocked"), F.lit(max(total * 3, 1))), "trend_latency": trend(F.col("latency"), F.lit(15))})


MARKER = r"(\[cite:[a-z]\d+\])"


def narrative_checks(rows: DataFrame) -> DataFrame:
    """Checks of a narrative (columns narrative, markers, final, known): markers that resolve, regulation named, numbers that agree, at most 200 words.

    markers: array of valid markers such as s1; known: array of number texts that may stand in it; final: the score it reports.
    """
    found = F.regexp_extract_all("narrative", F.lit(MARKER))
    valid = F.transform(F.coalesce("markers", F.array().cast("array<string>")), lambda m: F.concat(F.lit("[cite:"), m, F.lit("]")))
    bad = F.filter(found, lambda m: ~F.array_contains(valid, m))
    pct = F.bround(F.col("final") * 100)
    known = F.concat(F.coalesce("known", F.array().cast("array<string>")), F.array(F.format_string("%.2f", "final"), pct.cast("int").cast("string")))
    off_pct = F.filter(F.regexp_extract_all("narrative", F.lit(r"(\d+\.?\d*)\s*%")), lambda p: ~F.array_contains(known, p) & (F.abs(p.try_cast("double") - pct) > 5))
    score = lambda d: d.try_cast("double")
    off_dec = F.filter(F.regexp_extract_all("narrative", F.lit(r"(\b0?\.\d+\b)")), lambda d: ~F.array_contains(known, d) & (score(d) > 0) & (score(d) <= 1) & (F.col("final") > 0) & (F.abs(score(d) - F.col("final")) / F.col("final") > 0.05))
    up = F.upper("narrative")
    return rows.withColumns({
        "markers_found": F.size(found), "markers_bad": F.size(bad), "citations_ok": F.size(bad) == 0, "regulation_ok": up.contains("PMLA") | up.contains("RBI"), "numbers_ok": (F.size(off_pct) == 0) & (F.size(off_dec) == 0), "words": word_count("narrative"), "short_ok": word_count("narrative") <= 200,
    }).withColumn("hard_pass", F.col("citations_ok") & F.col("regulation_ok") & F.col("numbers_ok"))


def marker_use(narratives: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(used citations, markers without one): narratives with alert_id and narrative, citations with alert_id and marker. Distinct; markers sort as text."""
    used = narratives.select("alert_id", F.explode(F.array_distinct(F.regexp_extract_all("narrative", F.lit(r"\[cite:([a-z]\d+)\]"), F.lit(1)))).alias("marker"))
    known = citations.select("alert_id", "marker").distinct()
    return used.join(known, ["alert_id", "marker"], "left_semi"), used.join(known, ["alert_id", "marker"], "left_anti")
