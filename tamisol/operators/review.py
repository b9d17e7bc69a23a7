"""Alerts, customers and the evidence beside them, as set-oriented joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamisol.functions.text import falsy, falsy_number, low, safe_float
from tamisol.operators.matching import containing, similar_sequences

# Parts of counterparty, category or country that mark a payment abroad; what counts as large; newest payments looked at.
ABROAD = ("international", "wire", "swift", "foreign", "uae", "dubai", "turkey", "hawala", "western union", "payoneer")
LARGE, NEWEST = 500_000.0, 10
# Per unit and at most, of what raises (+) or lowers (-) a score; lower limits of the verdicts.
FACTORS = {"adverse": (0.05, 0.20), "ubo": (0.10, 0.10), "large": (0.05, 0.15), "intl": (0.05, 0.15), "registry": (0.05, 0.10), "escalations": (0.10, 0.20), "clearances": (-0.05, 0.20)}
TRUE_MATCH, UNCERTAIN = 0.85, 0.65


def current(alerts: DataFrame) -> DataFrame:
    """One row per alert: the latest of its repetitions by creation, disposal and status."""
    cols = [c for c in alerts.columns if c != "alert_id"]
    order = F.struct(F.coalesce("created_at", F.lit("")), F.coalesce("disposed_at", F.lit("")), F.coalesce("status", F.lit("")))
    return alerts.filter("alert_id is not null").groupBy("alert_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("alert_id", "r.*")


def confidence(a: Column | str = "match_score", b: Column | str = "confidence") -> Column:
    return falsy_number(a, b)


def score_band(score: Column) -> Column:
    return F.when(score < 0.5, "low").when(score < 0.75, "medium").otherwise("high")


def list_alerts(alerts: DataFrame, status: str | None = None) -> DataFrame:
    """Newest first; ties by alert."""
    rows = alerts if status is None else alerts.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "alert_id")


def list_customers(kyc: DataFrame, risk_rating: str | None = None, nationality: str | None = None) -> DataFrame:
    for c, v in (("risk_rating", risk_rating), ("nationality", nationality)):
        kyc = kyc if v is None else kyc.filter(F.col(c) == v)
    return kyc.orderBy("customer_id")


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def with_missing(ids: DataFrame, alerts: DataFrame) -> DataFrame:
    """The alerts of a list of ids (column alert_id), unknown ones too, with the flag ``missing``."""
    known = current(alerts).withColumn("__known", F.lit(True))
    return ids.select("alert_id").join(known, "alert_id", "left").withColumn("missing", F.col("__known").isNull()).drop("__known")


def create_alerts(requests: DataFrame) -> DataFrame:
    """New pending alerts, due a day after they were made. A request without a customer gets a new customer id."""
    now = F.current_timestamp()
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    new = lambda prefix, n: F.concat(F.lit(prefix), F.upper(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, n)))
    out = requests.withColumns({"alert_id": new("ALR-", 10), "status": F.lit("PENDING"), "created_at": stamp(now), "sla_deadline": stamp(now + F.expr("INTERVAL 24 HOURS"))})
    given = F.nullif(F.col("customer_id"), F.lit("")) if "customer_id" in requests.columns else F.lit(None).cast("string")
    return out.withColumn("customer_id", F.coalesce(given, new("CUST-", 8)))


def dispose(alerts: DataFrame, decisions: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(alerts with decisions applied, rejected decisions with their error). Decisions: alert_id, decision, analyst_note; the note is kept if none is given.

    Of several decisions on one alert the greatest (decision, note) counts, so that the result doesn't depend on their order.
    """
    d = decisions.withColumn("decision", F.upper("decision"))
    known = alerts.select("alert_id").distinct().withColumn("__known", F.lit(True))
    good = d.filter(F.col("decision").isin("CLEARED", "ESCALATED"))
    rejected = d.filter(~F.coalesce(F.col("decision").isin("CLEARED", "ESCALATED"), F.lit(False))).withColumn("error", F.lit(400)).unionByName(good.join(known, "alert_id", "left_anti").withColumn("error", F.lit(404)))
    one = good.groupBy("alert_id").agg(F.max(F.struct("decision", "analyst_note")).alias("__d"))
    done = alerts.join(one, "alert_id", "left")
    hit = F.col("__d").isNotNull()
    done = done.withColumns({"status": F.when(hit, F.col("__d.decision")).otherwise(F.col("status")), "disposed_at": F.when(hit, F.lit(at)).otherwise(F.col("disposed_at")), "analyst_note": F.coalesce(F.when(hit, F.nullif(F.col("__d.analyst_note"), F.lit(""))), F.col("analyst_note"))})
    return done.drop("__d"), rejected


#: Steps that a score is divided into to find positions in a global order; scores beyond 0 to 1 fall into the outer two.
STEPS = 10_000


def _picked(rows: DataFrame, score: str, key: str, count: int, positions: Callable[[int, int], list[int]]) -> DataFrame:
    """Rows at 0-based positions in the order of ``score``, then ``key``, over the whole table.

    Rows are counted by step of their score (at most STEPS + 3 counts come to the driver), which tells the steps that hold the positions; only rows of
    those are ranked, each step by itself. No task sorts all rows.
    """
    step = F.greatest(F.lit(-1), F.least(F.lit(STEPS + 1), F.floor(F.col(score) * STEPS))).cast("int")
    rows = rows.withColumn("__step", step)
    counts = sorted((r["__step"], r["count"]) for r in rows.groupBy("__step").count().collect())
    total = sum(n for _, n in counts)
    wanted, before, at = [], 0, 0
    for p in sorted(positions(total, count)):
        while p >= before + counts[at][1]:
            before += counts[at][1]
            at += 1
        wanted.append((counts[at][0], p - before + 1))
    chosen = F.broadcast(rows.sparkSession.createDataFrame(wanted, "__step int, __n int"))  # as many rows as positions
    ranked = rows.filter(F.col("__step").isin(sorted({s for s, _ in wanted}))).withColumn("__n", F.row_number().over(W.partitionBy("__step").orderBy(score, key)))
    return ranked.join(chosen, ["__step", "__n"]).drop("__step", "__n")


def _ranks(n: int, *pieces: np.ndarray) -> list[int]:
    """The ranks below n that the pieces name, rounded, each once."""
    named = np.unique(np.rint(np.concatenate(pieces)).astype(int))
    return named[(named >= 0) & (named < n)].tolist()


def queue_positions(n: int, count: int = 10) -> list[int]:
    """The ranks that make a queue of ``count``: three at either end, the others in equal steps from one end's edge to the other's."""
    return _ranks(n, np.arange(3), np.linspace(3, max(3, n - 4), count - 6), np.arange(n - 3, n))


def even_positions(n: int, count: int) -> list[int]:
    """``count`` ranks in equal steps from the first of n to the last."""
    return _ranks(n, np.linspace(0, n - 1, min(n, count)))


def pending_queue(alerts: DataFrame, count: int = 10) -> DataFrame:
    """A stratified sample of the pending alerts by ascending confidence, ties by alert."""
    rows = current(alerts).filter("status = 'PENDING'").select("alert_id", "customer_id", "customer_name", confidence().alias("score"))
    return _picked(rows, "score", "alert_id", count, queue_positions)


def even_sample(alerts: DataFrame, count: int) -> DataFrame:
    """Alerts spread evenly over ascending match score, ties by alert."""
    rows = current(alerts).select("alert_id", "customer_name", safe_float("match_score").alias("match_score"))
    return _picked(rows, "match_score", "alert_id", count, even_positions)


def scenario_queue(alerts: DataFrame, count: int = 6) -> DataFrame:
    """Two pending alerts of each band (below 0.4, to 0.7, above), topped up with others to ``count``, in the order of alerts; with their label."""
    rows = current(alerts).filter("status = 'PENDING'").select("alert_id", confidence().alias("score"))
    rows = rows.withColumn("band", F.when(F.col("score") < 0.4, 0).when(F.col("score") <= 0.7, 1).otherwise(2))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("band").orderBy("alert_id"))).filter(F.col("n") <= count)
    return rows.orderBy((F.col("n") > 2).cast("int"), F.when(F.col("n") <= 2, F.col("band")).otherwise(0), "alert_id").limit(count).select("alert_id", "score", "band", score_band(F.col("score")).alias("label"))


def overdue(alerts: DataFrame, now: str) -> DataFrame:
    """Pending alerts with a flag whether their deadline has passed at ``now``."""
    return current(alerts).filter("status = 'PENDING'").select("alert_id", "sla_deadline", (F.try_to_timestamp("sla_deadline") < F.to_timestamp(F.lit(now))).alias("overdue"))


def entity_of(matched: str = "matched_entity", customer: str = "customer_name") -> Column:
    return falsy(matched, customer)


def watchlist_hits(alerts: DataFrame, sanctions: DataFrame, top: int = 10) -> DataFrame:
    """(alert_id, id, full_name, program, source, hit_no): the first entries, by id, whose name holds the alert's entity, whatever the case.

    An alert without any name meets every entry, hence the first ``top`` ones.
    """
    a = current(alerts).select("alert_id", low(entity_of()).alias("needle"))
    shown = ["id", "full_name", "program", "source", *(c for c in ("nationality", "listed_on") if c in sanctions.columns)]
    s = sanctions.select(*shown).withColumn("text", low("full_name"))
    found = a.join(containing(a.select("needle"), s.select("text")), "needle").join(s, "text").select("alert_id", *shown)
    some = F.broadcast(s.orderBy("id").limit(top).select(*shown))  # ``top`` rows
    found = found.unionByName(a.filter("needle = ''").select("alert_id").join(some))
    return found.withColumn("hit_no", F.row_number().over(W.partitionBy("alert_id").orderBy("id"))).filter(F.col("hit_no") <= top)


def latest_transactions(transactions: DataFrame, newest: int = NEWEST) -> DataFrame:
    """The newest payments of each customer, exact repetitions counted once; ties by transaction. The limit is pushed below the shuffle, so no customer gathers."""
    rows = transactions.distinct()
    order = W.partitionBy("customer_id").orderBy(F.desc("date"), "transaction_id", F.coalesce("amount", F.lit("")), F.coalesce("counterparty", F.lit("")))
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= newest)


def transaction_flags(transactions: DataFrame) -> DataFrame:
    """(customer_id, total, large_count, international_count, suspicious_pattern) over the newest payments."""
    text = F.lower(F.concat(F.coalesce("counterparty", F.lit("")), F.lit(" "), F.coalesce("category", F.lit("")), F.lit(" "), F.coalesce("country", F.lit(""))))
    rows = latest_transactions(transactions).withColumn("__abroad", text.rlike("|".join(ABROAD))).withColumn("__large", safe_float("amount") > LARGE)
    out = rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("__large").alias("large_count"), F.count_if("__abroad").alias("international_count"))
    return out.withColumn("suspicious_pattern", (F.col("large_count") > 1) | (F.col("international_count") > 0))


def name_counts(alerts: DataFrame, records: DataFrame, name: str | list[str], top: int, entity: Column | None = None, key: str | None = None, kyc: DataFrame | None = None) -> DataFrame:
    """(alert_id, n): records that hold the alert's name exactly in ``name``, or in any one of several columns, at most ``top``: media by customer, registry and ownership by entity.

    ``entity``: the name looked for, else the matched or the customer's. With several columns, ``key`` tells records apart. ``kyc``: customers whose
    full_name, there called kyc_name, ``entity`` may fall back on.
    """
    a = current(alerts)
    if kyc is not None:
        a = a.join(kyc.select("customer_id", F.col("full_name").alias("kyc_name")).dropDuplicates(["customer_id"]), "customer_id", "left")
    a = a.select("alert_id", (entity if entity is not None else entity_of()).alias("needle"))
    if isinstance(name, str):
        r = records.select(F.col(name).alias("text"))
        counted = containing(a.select("needle"), r.select("text")).join(r.groupBy("text").agg(F.count(F.lit(1)).alias("c")), "text").groupBy("needle").agg(F.sum("c").alias("c"))
    else:
        r = records.select(F.col(key).alias("key"), F.explode(F.array(*name)).alias("text")).filter("text <> ''").distinct()
        counted = containing(a.select("needle"), r.select("text")).join(r, "text").select("needle", "key").distinct().groupBy("needle").agg(F.count(F.lit(1)).alias("c"))
    return a.join(counted, "needle", "left").select("alert_id", F.least(F.coalesce("c", F.lit(0)), F.lit(top)).cast("bigint").alias("n"))


def similar_cases(names: DataFrame, cases: DataFrame) -> DataFrame:
    """(name, case_id, resolution, ordinal, ratio): prior cases whose queried name is alike."""
    left = names.select("name").distinct().withColumn("a", F.lower(F.coalesce("name", F.lit(""))))
    right = cases.withColumn("b", F.lower(F.coalesce("name_queried", F.lit(""))))
    return left.join(similar_sequences(left, right), "a").join(right, "b").select("name", "case_id", "resolution", "resolution_note", "ordinal", "ratio")


def case_counts(matched: DataFrame) -> DataFrame:
    """(name, total_cases, prior_clearances, prior_escalations, most_recent_resolution, analyst_notes); the most recent one is the last in file order."""
    return matched.groupBy("name").agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(F.col("resolution") == "FALSE_POSITIVE").alias("prior_clearances"), F.count_if(F.col("resolution") == "ESCALATED").alias("prior_escalations"),
        F.max_by("resolution", F.struct("ordinal", "case_id")).alias("most_recent_resolution"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "case_id", F.coalesce("resolution_note", F.lit("")).alias("note")))), lambda s: s["note"]).alias("analyst_notes"),
    )


def cleared_before(alerts: DataFrame, memory: DataFrame, top: int = 5) -> DataFrame:
    """(alert_id, remembered, resolved_at): the newest clearances of alike names whose dates of birth don't differ where both are known."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    a = current(alerts).select("alert_id", norm("customer_name").alias("b"), F.coalesce("dob", F.lit("")).alias("dob"))
    m = memory.select(norm("customer_name").alias("a"), F.col("customer_name").alias("remembered"), F.coalesce("dob", F.lit("")).alias("mdob"), "resolved_at")
    rows = a.join(similar_sequences(m, a).select("a", "b"), "b").join(m, "a").filter((F.col("dob") == "") | (F.col("mdob") == "") | (F.col("dob") == F.col("mdob")))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("alert_id").orderBy(F.desc("resolved_at"), "remembered"))).filter(F.col("n") <= top).select("alert_id", "remembered", "resolved_at", "n")


def contribution(factor: str, n: Column) -> Column:
    each, most = FACTORS[factor]
    return (F.least(n * abs(each), F.lit(most)) if factor != "ubo" else F.when(n > 0, most).otherwise(0.0)) * (1 if each > 0 else -1)


def rule_score(base: Column, counts: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(final score, context, adjustment); counts by factor. The order of the sums is fixed, as verdict limits are met exactly."""
    context = contribution("adverse", counts["adverse"]) + contribution("ubo", counts["ubo"]) + contribution("large", counts["large"]) + contribution("intl", counts["intl"]) + contribution("registry", counts["registry"])
    adjust = contribution("escalations", counts["escalations"]) + contribution("clearances", counts["clearances"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + context + adjust)), context, adjust


def verdict(score: Column) -> Column:
    return F.when(score >= TRUE_MATCH, "TRUE_MATCH").when(score >= UNCERTAIN, "UNCERTAIN").otherwise("FALSE_POSITIVE")


def verdict_margin(score: Column) -> Column:
    """The distance to the nearest verdict limit."""
    return F.when(score < UNCERTAIN, UNCERTAIN - score).when(score < TRUE_MATCH, F.least(score - UNCERTAIN, TRUE_MATCH - score)).otherwise(score - TRUE_MATCH)


def triage(alerts: DataFrame, kyc: DataFrame, transactions: DataFrame, cases: DataFrame | None = None, adverse: DataFrame | None = None, registry: DataFrame | None = None, ubo: DataFrame | None = None) -> DataFrame:
    """One row per alert with its evidence counts, score, verdict and, where the customer is unknown, an error instead of a verdict.

    Evidence that isn't given counts as none: cases with the columns of prior cases; adverse, registry and ubo with (alert_id, n) as name_counts makes them.
    """
    rows = current(alerts).withColumn("base", confidence())
    known = kyc.select("customer_id", F.col("full_name").alias("kyc_name"), "risk_rating").dropDuplicates(["customer_id"])
    rows = rows.join(known, "customer_id", "left").join(transaction_flags(transactions), "customer_id", "left")
    if cases is not None:
        counts = case_counts(similar_cases(rows.select(F.col("customer_name").alias("name")), cases)).withColumnRenamed("name", "customer_name")
        rows = rows.join(counts, "customer_name", "left")
    else:
        rows = rows.withColumns({"total_cases": F.lit(0), "prior_clearances": F.lit(0), "prior_escalations": F.lit(0), "most_recent_resolution": F.lit("none"), "analyst_notes": F.array().cast("array<string>")})
    for name, frame in (("adverse", adverse), ("registry", registry), ("ubo", ubo)):
        rows = rows.join(frame.select("alert_id", F.col("n").alias(name)), "alert_id", "left") if frame is not None else rows.withColumn(name, F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = {"adverse": zero("adverse"), "ubo": zero("ubo"), "large": zero("large_count"), "intl": zero("international_count"), "registry": zero("registry"), "escalations": zero("prior_escalations"), "clearances": zero("prior_clearances")}
    final, context, adjust = rule_score(F.col("base"), counts)
    rows = rows.withColumns({"context_score": context, "confidence_adjustment": adjust, "final_risk_score": final})
    missing = F.col("kyc_name").isNull()
    return rows.withColumns({"recommendation": F.when(~missing, verdict(F.col("final_risk_score"))), "confidence_pct": F.bround(F.col("final_risk_score") * 100).cast("int"), "components": F.struct(F.bround(F.col("base"), 3).alias("base"), F.bround("context_score", 3).alias("context"), F.bround("confidence_adjustment", 3).alias("adjustment")), "error": F.when(missing, F.concat(F.lit("no customer "), F.coalesce("customer_id", F.lit("")))), "margin": verdict_margin(F.col("final_risk_score"))})


def worksheet(triaged: DataFrame, hits: DataFrame) -> DataFrame:
    """The nested result per alert: hits, payments, prior cases, scores, narrative, citations of the hits used."""
    shown = ["hit_no", "full_name", "program", "source", *(c for c in ("nationality", "listed_on") if c in hits.columns)]
    listed = hits.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("sanctions_db_hits"))  # as many as watchlist_hits keeps
    empty = F.array().cast(dict(listed.dtypes)["sanctions_db_hits"])
    rows = triaged.join(listed, "alert_id", "left").withColumn("sanctions_db_hits", F.coalesce("sanctions_db_hits", empty))
    if "blocked_actions" not in rows.columns:
        rows = rows.withColumn("blocked_actions", F.array().cast("array<string>"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    narrative = F.format_string(
        "Initial match score %.2f against '%s'. %d sanctions.db hit(s). %d adverse media. %d large / %d intl txns. UBO chain: %s. Prior: %d clearance(s) / %d escalation(s). Final risk: %.2f → %s.",
        "base", F.coalesce("matched_entity", F.lit("")), F.size("sanctions_db_hits"), zero("adverse"), zero("large_count"), zero("international_count"), F.when(zero("ubo") > 0, "found").otherwise("none"),
        zero("prior_clearances"), zero("prior_escalations"), "final_risk_score", F.coalesce("recommendation", F.lit("UNCERTAIN")),
    )
    cite = lambda marker, tool, label, path, raw: F.struct(marker.alias("marker"), F.lit(tool).alias("tool"), label.alias("label"), path.alias("path"), F.to_json(raw).alias("raw"))
    cites = F.concat(
        F.transform("sanctions_db_hits", lambda h: cite(F.concat(F.lit("s"), h["hit_no"]), "sanctions_db", h["full_name"], F.concat(F.lit("sanctions_db_hits["), h["hit_no"] - 1, F.lit("]")), F.struct(h["full_name"].alias("full_name"), h["program"].alias("program"), h["source"].alias("source")))),
        F.when(zero("total_cases") > 0, F.array(cite(F.lit("c1"), "prior_cases", F.concat(zero("total_cases"), F.lit(" prior case(s)")), F.lit("prior_cases"), F.struct(zero("total_cases").alias("total_cases"), F.coalesce("most_recent_resolution", F.lit("none")).alias("most_recent_resolution"))))).otherwise(F.array()),
        F.when(zero("adverse") > 0, F.array(cite(F.lit("m1"), "adverse_media", F.concat(zero("adverse"), F.lit(" media hit(s)")), F.lit("adverse_media_count"), F.struct(zero("adverse").alias("count"))))).otherwise(F.array()),
    )
    kyc = F.struct("customer_id", F.col("kyc_name").alias("full_name"), "risk_rating")
    return rows.select(
        "alert_id", "customer_id", "customer_name", falsy("matched_entity").alias("matched_entity"), falsy("source_list").alias("source_list"), F.col("base").alias("initial_match_score"), "sanctions_db_hits",
        F.struct(zero("total").alias("total"), zero("large_count").alias("large_count"), zero("international_count").alias("international_count"), F.coalesce("suspicious_pattern", F.lit(False)).alias("suspicious_pattern")).alias("transactions"),
        zero("adverse").alias("adverse_media_count"), (zero("ubo") > 0).alias("ubo_chain_found"), zero("registry").alias("registry_match_count"),
        F.struct(zero("total_cases").alias("total_cases"), zero("prior_clearances").alias("prior_clearances"), zero("prior_escalations").alias("prior_escalations"), F.coalesce("most_recent_resolution", F.lit("none")).alias("most_recent_resolution")).alias("prior_cases"),
        "context_score", "confidence_adjustment", "final_risk_score", F.coalesce("recommendation", F.lit("UNCERTAIN")).alias("recommendation"), narrative.alias("narrative"), cites.alias("narrative_citations"), F.when(F.col("kyc_name").isNotNull(), kyc).alias("kyc_summary"), "blocked_actions", "confidence_pct", "components", "error",
    )


def contributions(triaged: DataFrame) -> DataFrame:
    """(alert_id, factor, contribution): what each kind of evidence added or took away, one row per factor."""
    count = {"adverse": "adverse", "ubo": "ubo", "large": "large_count", "intl": "international_count", "registry": "registry", "escalations": "prior_escalations", "clearances": "prior_clearances"}
    each = F.array(*(F.struct(F.lit(f).alias("factor"), contribution(f, F.coalesce(F.col(c), F.lit(0))).cast("double").alias("contribution")) for f, c in count.items()))
    return triaged.select("alert_id", F.inline(each))


def review_one(alert_id: str, alerts: DataFrame, kyc: DataFrame, transactions: DataFrame, **evidence: DataFrame) -> DataFrame:
    """``triage`` of a single alert; only its customer's payments are looked at. An unknown alert gives no row. A run that fails may simply be started again: nothing is kept between runs."""
    one = alerts.filter(F.col("alert_id") == alert_id)
    customers = F.broadcast(current(one).select("customer_id"))  # one row
    return triage(one, kyc.join(customers, "customer_id", "left_semi"), transactions.join(customers, "customer_id", "left_semi"), **evidence)


def sla_band(seconds: Column) -> Column:
    """How far a review is within its 25 seconds: green, amber beyond 15, red beyond 20, late beyond 25; null without a time."""
    return F.when(seconds > 25, "late").when(seconds > 20, "red").when(seconds > 15, "amber").when(seconds.isNotNull(), "green")
