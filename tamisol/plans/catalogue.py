"""The queries of screening, review, audit and state, each over whole tables, with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamisol.functions import arrow_metrics as A
from tamisol.functions import metrics as M
from tamisol.functions import text as T
from tamisol.operators import audit, matching, review, sampling, state
from tamisol.session import is_folder, shared_dir, ship, table
from tamisol.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Parts of the SQL counterparts.
CURRENT = """cur AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY coalesce(created_at,'') DESC, coalesce(disposed_at,'') DESC, coalesce(status,'') DESC) n FROM sanctions_alerts WHERE alert_id IS NOT NULL) WHERE n = 1)"""
NUMBER = "CASE WHEN try_cast({c} AS DOUBLE) IS NULL OR isnan(try_cast({c} AS DOUBLE)) OR isinf(try_cast({c} AS DOUBLE)) THEN 0.0 ELSE try_cast({c} AS DOUBLE) END"
CONF = f"coalesce(nullif({NUMBER.format(c='match_score')}, 0.0), {NUMBER.format(c='confidence')})"
NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY date DESC NULLS LAST, transaction_id, coalesce(amount,''), coalesce(counterparty,'')) n FROM (SELECT DISTINCT * FROM customer_transactions)) WHERE n <= 10)"""
FLAGS = f"""{NEWEST}, flags AS (SELECT customer_id, count(*) total, count(*) FILTER (WHERE {NUMBER.format(c='amount')} > 500000) large_count,
 count(*) FILTER (WHERE regexp_matches(lower(coalesce(counterparty,'') || ' ' || coalesce(category,'') || ' ' || coalesce(country,'')), 'international|wire|swift|foreign|uae|dubai|turkey|hawala|western union|payoneer')) international_count FROM newest GROUP BY 1)"""
TRIAGED = f"""{CURRENT}, {FLAGS}, base AS (SELECT c.*, {CONF} base, k.customer_id IS NULL missing, coalesce(large_count,0) l, coalesce(international_count,0) i
 FROM cur c LEFT JOIN (SELECT DISTINCT customer_id FROM customer_kyc WHERE full_name IS NOT NULL) k USING (customer_id) LEFT JOIN flags f USING (customer_id)),
 scored AS (SELECT *, greatest(0.0, least(1.0, base + (least(l * 0.05, 0.15) + least(i * 0.05, 0.15)))) score FROM base),
 triaged AS (SELECT *, CASE WHEN missing THEN NULL WHEN score >= 0.85 THEN 'TRUE_MATCH' WHEN score >= 0.65 THEN 'UNCERTAIN' ELSE 'FALSE_POSITIVE' END recommendation FROM scored)"""
PAIRS = "pairs AS (SELECT DISTINCT lower(customer_name) a, lower(matched_entity) b FROM sanctions_alerts WHERE regexp_full_match(customer_name, '[A-Za-z ]+') AND regexp_full_match(matched_entity, '[A-Za-z ]+'))"
EVENTS = "ev AS (SELECT event_id seq, CAST(user_id AS VARCHAR) alert_id, event_type tool, CASE WHEN event_id % 3 = 0 THEN 'fill' ELSE 'llm' END source, CASE WHEN value > 100 THEN 'tool_blocked' ELSE 'tool_call' END event, strftime(ts, '%Y-%m-%dT%H:%M:%S') ts, props FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as an audit trail: user as alert, type as tool."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("alert_id"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 3 == 0, "fill").otherwise("llm").alias("source"),
        F.when(F.col("value") > 100, "tool_blocked").otherwise("tool_call").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("props").alias("tool_input"),
    ).withColumns({"tool_output_summary": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})


def _triaged(spark: SparkSession, d: str) -> DataFrame:
    return review.triage(table(spark, d, "sanctions_alerts"), table(spark, d, "customer_kyc"), table(spark, d, "customer_transactions"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of a customer's and a listed name in plain letters, lower case."""
    a = table(spark, d, "sanctions_alerts").filter(F.col("customer_name").rlike("^[A-Za-z ]+$") & F.col("matched_entity").rlike("^[A-Za-z ]+$"))
    return a.select(F.lower("customer_name").alias("a"), F.lower("matched_entity").alias("b")).distinct()


def _all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of a customer's and a listed name in lower case, whatever their characters; null and '' stay apart."""
    return table(spark, d, "sanctions_alerts").select(T.low("customer_name").alias("a"), T.low("matched_entity").alias("b")).distinct()


# --- review ----------------------------------------------------------------------------------------------------------
@query(f"WITH {TRIAGED} SELECT alert_id, base, CAST(l AS BIGINT) large_count, CAST(i AS BIGINT) international_count, round(score, 9) final_risk_score, recommendation, missing FROM triaged")
def triage_verdicts(spark: SparkSession, d: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return _triaged(spark, d).select("alert_id", "base", zero("large_count"), zero("international_count"), F.round("final_risk_score", 9).alias("final_risk_score"), "recommendation", F.col("error").isNotNull().alias("missing"))


@query(f"WITH {TRIAGED} SELECT count(*) FILTER (WHERE NOT missing) processed, count(*) FILTER (WHERE missing) crashed, round(avg(score) FILTER (WHERE NOT missing), 9) mean_score, count(*) FILTER (WHERE recommendation = 'TRUE_MATCH') true_match, count(*) FILTER (WHERE recommendation = 'UNCERTAIN') uncertain, count(*) FILTER (WHERE recommendation = 'FALSE_POSITIVE') false_positive FROM triaged")
def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.batch_summary(_triaged(spark, d)).withColumn("mean_score", F.round("mean_score", 9))


@query(f"WITH {TRIAGED} SELECT alert_id, unnest(['adverse','ubo','large','intl','registry','escalations','clearances']) factor, unnest([0.0, 0.0, least(l * 0.05, 0.15), least(i * 0.05, 0.15), 0.0, 0.0, 0.0]::DOUBLE[]) contribution FROM triaged")
def factor_contributions(spark: SparkSession, d: str) -> DataFrame:
    return review.contributions(_triaged(spark, d)).withColumn("contribution", F.col("contribution") + F.lit(0.0))


@query(f"WITH {TRIAGED} SELECT alert_id, round(CASE WHEN score < 0.65 THEN 0.65 - score WHEN score < 0.85 THEN least(score - 0.65, 0.85 - score) ELSE score - 0.85 END, 9) margin FROM triaged")
def margins(spark: SparkSession, d: str) -> DataFrame:
    return _triaged(spark, d).select("alert_id", F.round("margin", 9).alias("margin"))


@query()
def triage_full(spark: SparkSession, d: str) -> DataFrame:
    """With prior cases by likeness of names, and list names that hold the customer's as stand-ins for other evidence."""
    ship(spark)
    alerts, kyc = table(spark, d, "sanctions_alerts"), table(spark, d, "customer_kyc")
    media = review.name_counts(alerts, table(spark, d, "sanctions"), "full_name", 20, T.falsy("customer_name"))
    registry = review.name_counts(alerts, kyc, "full_name", 10)
    rows = review.triage(alerts, kyc, table(spark, d, "customer_transactions"), table(spark, d, "prior_cases"), media, registry)
    return review.worksheet(rows, review.watchlist_hits(alerts, table(spark, d, "sanctions")))


@query("SELECT alert_id, customer_id, status, created_at FROM sanctions_alerts WHERE status = 'PENDING'")
def alerts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return review.list_alerts(table(spark, d, "sanctions_alerts"), "PENDING").select("alert_id", "customer_id", "status", "created_at")


@query("SELECT customer_id, full_name, risk_rating, nationality FROM customer_kyc WHERE risk_rating = 'HIGH' AND nationality = 'IN'")
def customers_filtered(spark: SparkSession, d: str) -> DataFrame:
    return review.list_customers(table(spark, d, "customer_kyc"), "HIGH", "IN").select("customer_id", "full_name", "risk_rating", "nationality")


@query("SELECT (SELECT count(*) FROM sanctions) sanctions, (SELECT count(*) FROM customer_kyc) customers, (SELECT count(*) FROM sanctions_alerts) alerts, (SELECT count(*) FROM sanctions_alerts WHERE status = 'PENDING') pending, (SELECT count(*) FROM customer_transactions) transactions, (SELECT count(*) FROM prior_cases) cases")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t, c, cond=None: table(spark, d, t).agg((F.count_if(cond) if cond is not None else F.count(F.lit(1))).alias(c))
    out = n("sanctions", "sanctions")
    for x in (n("customer_kyc", "customers"), table(spark, d, "sanctions_alerts").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("status") == "PENDING").alias("pending")), n("customer_transactions", "transactions"), n("prior_cases", "cases")):
        out = out.join(x)  # one row each
    return out


@query(f"WITH {CURRENT}, p AS (SELECT alert_id, customer_id, customer_name, {CONF} score FROM cur WHERE status = 'PENDING'), r AS (SELECT *, row_number() OVER (ORDER BY score, alert_id) - 1 k, count(*) OVER () n FROM p) SELECT alert_id, customer_id, customer_name, score FROM r WHERE n <= 10 OR k < 3 OR k >= n - 3 OR (n - 6 >= 4 AND k IN (3, 3 + round_even((n - 7) / 3.0, 0), 3 + round_even((n - 7) / 3.0 * 2, 0), 3 + round_even((n - 7) / 3.0 * 3, 0))) OR (n - 6 < 4)")
def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.pending_queue(table(spark, d, "sanctions_alerts"))


@query(f"WITH {CURRENT}, p AS (SELECT alert_id, {CONF} score FROM cur WHERE status = 'PENDING'), b AS (SELECT *, CASE WHEN score < 0.4 THEN 0 WHEN score <= 0.7 THEN 1 ELSE 2 END band FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY alert_id) n FROM b) SELECT alert_id, score, band, CASE WHEN score < 0.5 THEN 'low' WHEN score < 0.75 THEN 'medium' ELSE 'high' END AS label FROM r ORDER BY (n > 2)::INT, CASE WHEN n <= 2 THEN band ELSE 0 END, alert_id LIMIT 6")
def scenario_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.scenario_queue(table(spark, d, "sanctions_alerts"))


@query(f"WITH {CURRENT}, r AS (SELECT alert_id, customer_name, {NUMBER.format(c='match_score')} match_score, row_number() OVER (ORDER BY {NUMBER.format(c='match_score')}, alert_id) - 1 k, count(*) OVER () n FROM cur) SELECT alert_id, customer_name, match_score FROM r WHERE k IN (SELECT round_even(i * (n - 1) / 99.0, 0) FROM range(100) t(i))")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return review.even_sample(table(spark, d, "sanctions_alerts"), 100)


@query(f"WITH {CURRENT}, dec AS (SELECT alert_id, CASE WHEN {CONF} >= 0.8 THEN 'ESCALATED' WHEN {CONF} < 0.5 THEN 'CLEARED' END decision FROM cur WHERE status = 'PENDING') SELECT c.alert_id, coalesce(dec.decision, c.status) status, CASE WHEN dec.decision IS NOT NULL THEN '2025-07-01T00:00:00Z' ELSE disposed_at END disposed_at, CASE WHEN dec.decision IS NOT NULL THEN 'by score' ELSE analyst_note END analyst_note FROM cur c LEFT JOIN dec USING (alert_id)")
def dispositions(spark: SparkSession, d: str) -> DataFrame:
    alerts = review.current(table(spark, d, "sanctions_alerts"))
    c = review.confidence()
    decisions = alerts.filter("status = 'PENDING'").select("alert_id", F.when(c >= 0.8, "escalated").when(c < 0.5, "cleared").otherwise("unsure").alias("decision"), F.lit("by score").alias("analyst_note"))
    return review.dispose(alerts, decisions, "2025-07-01T00:00:00Z")[0].select("alert_id", "status", "disposed_at", "analyst_note")


@query(f"WITH {CURRENT} SELECT alert_id, sla_deadline, try_cast(sla_deadline AS TIMESTAMPTZ) < TIMESTAMPTZ '2025-05-01 00:00:00+00' overdue FROM cur WHERE status = 'PENDING'")
def sla_overdue(spark: SparkSession, d: str) -> DataFrame:
    return review.overdue(table(spark, d, "sanctions_alerts"), "2025-05-01T00:00:00Z")


@query(f"WITH {NEWEST} SELECT customer_id, transaction_id, date, amount, CAST(n AS INT) n FROM newest")
def latest_transactions(spark: SparkSession, d: str) -> DataFrame:
    return review.latest_transactions(table(spark, d, "customer_transactions")).select("customer_id", "transaction_id", "date", "amount", "n")


@query(f"WITH {FLAGS} SELECT *, large_count > 1 OR international_count > 0 suspicious_pattern FROM flags")
def transaction_flags(spark: SparkSession, d: str) -> DataFrame:
    return review.transaction_flags(table(spark, d, "customer_transactions"))


# --- lists and names -------------------------------------------------------------------------------------------------
@query("SELECT source, min(authority) authority, min(region) region, count(*) cnt FROM sanctions GROUP BY source")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sanctions").groupBy("source").agg(F.min("authority").alias("authority"), F.min("region").alias("region"), F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"))


@query("SELECT id, source, full_name FROM sanctions ORDER BY id DESC LIMIT 10")
def latest_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sanctions").select("id", "source", "full_name").orderBy(F.desc("id")).limit(10)


@query(f"WITH {CURRENT}, a AS (SELECT alert_id, lower(replace(coalesce(nullif(matched_entity,''), nullif(customer_name,''), ''), 'İ', 'i')) needle FROM cur), h AS (SELECT alert_id, id, full_name, program, source, row_number() OVER (PARTITION BY alert_id ORDER BY id) n FROM a JOIN sanctions s ON contains(lower(replace(s.full_name, 'İ', 'i')), a.needle)) SELECT alert_id, id, full_name, program, source, CAST(n AS INT) hit_no FROM h WHERE n <= 10")
def alert_watchlist_hits(spark: SparkSession, d: str) -> DataFrame:
    return review.watchlist_hits(table(spark, d, "sanctions_alerts"), table(spark, d, "sanctions").drop("nationality", "listed_on"))


@query("SELECT name, least(count(DISTINCT id), 10) hits, CASE WHEN count(id) > 0 THEN 'BLOCKED' ELSE 'CLEAR' END verdict FROM (SELECT DISTINCT name_queried name FROM prior_cases) LEFT JOIN sanctions s ON contains(lower(replace(s.full_name, 'İ', 'i')), lower(replace(name, 'İ', 'i'))) OR contains(lower(replace(s.last_name, 'İ', 'i')), lower(replace(name, 'İ', 'i'))) GROUP BY 1")
def screen_exact(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "prior_cases").select(F.col("name_queried").alias("name"))
    return matching.screen_exact(names, table(spark, d, "sanctions")).select("name", F.size("hits").cast("bigint").alias("hits"), "verdict")


@query("WITH w AS (SELECT DISTINCT name_queried AS name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(replace(name_queried, 'İ', 'i')), '\\s+'), lambda x: x <> ''))) needle FROM prior_cases), t AS (SELECT needle, count(*) c FROM w GROUP BY 1) SELECT name, count(DISTINCT id) candidates FROM w JOIN sanctions s ON contains(lower(replace(s.full_name, 'İ', 'i')), needle) GROUP BY 1")
def token_candidates(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "prior_cases").select(F.col("name_queried").alias("name"))
    return matching.candidate_counts(names, table(spark, d, "sanctions"))


def _holds(spark: SparkSession, d: str, entity, top: int) -> DataFrame:
    return review.name_counts(table(spark, d, "sanctions_alerts"), table(spark, d, "customer_kyc"), "full_name", top, entity)


@query(f"WITH {CURRENT} SELECT alert_id, least(count(k.customer_id), 20) n FROM cur LEFT JOIN customer_kyc k ON customer_name <> '' AND contains(k.full_name, customer_name) GROUP BY 1")
def media_counts(spark: SparkSession, d: str) -> DataFrame:
    return _holds(spark, d, T.falsy("customer_name"), 20)


@query(f"WITH {CURRENT}, a AS (SELECT alert_id, coalesce(nullif(matched_entity,''), nullif(customer_name,''), '') e FROM cur) SELECT alert_id, least(count(k.customer_id), 10) n FROM a LEFT JOIN customer_kyc k ON e <> '' AND contains(k.full_name, e) GROUP BY 1")
def registry_matches(spark: SparkSession, d: str) -> DataFrame:
    return _holds(spark, d, None, 10)


@query(f"WITH {CURRENT}, a AS (SELECT alert_id, coalesce(nullif(matched_entity,''), nullif(customer_name,''), '') e FROM cur) SELECT alert_id, least(count(s.id), 10) n FROM a LEFT JOIN sanctions s ON e <> '' AND (contains(s.full_name, e) OR contains(s.last_name, e)) GROUP BY 1")
def registry_either_name(spark: SparkSession, d: str) -> DataFrame:
    """Entries of which either name holds the entity."""
    return review.name_counts(table(spark, d, "sanctions_alerts"), table(spark, d, "sanctions"), ["full_name", "last_name"], 10, key="id")


@query(f"WITH {CURRENT}, a AS (SELECT alert_id, coalesce(nullif(customer_name,''), nullif(k.full_name,''), '') e FROM cur LEFT JOIN (SELECT customer_id, min(full_name) full_name FROM customer_kyc GROUP BY 1) k USING (customer_id)) SELECT alert_id, least(count(s.id), 20) n FROM a LEFT JOIN sanctions s ON e <> '' AND contains(s.full_name, e) GROUP BY 1")
def media_by_customer(spark: SparkSession, d: str) -> DataFrame:
    """By the alert's customer name, or where that is missing the customer's own."""
    return review.name_counts(table(spark, d, "sanctions_alerts"), table(spark, d, "sanctions"), "full_name", 20, T.falsy("customer_name", "kyc_name"), kyc=table(spark, d, "customer_kyc"))


@query("WITH n AS (SELECT DISTINCT customer_name AS name, dob FROM sanctions_alerts), h AS (SELECT n.name, n.dob, s.id FROM n JOIN sanctions s ON name <> '' AND (contains(lower(replace(s.full_name, 'İ', 'i')), lower(replace(n.name, 'İ', 'i'))) OR contains(lower(replace(s.last_name, 'İ', 'i')), lower(replace(n.name, 'İ', 'i')))) AND (coalesce(n.dob, '') = '' OR s.dob = n.dob)) SELECT n.name, n.dob, least(count(DISTINCT h.id), 10) hits, CASE WHEN count(h.id) > 0 THEN 'BLOCKED' ELSE 'CLEAR' END verdict FROM n LEFT JOIN h ON n.name IS NOT DISTINCT FROM h.name AND n.dob IS NOT DISTINCT FROM h.dob GROUP BY 1, 2")
def screen_exact_dob(spark: SparkSession, d: str) -> DataFrame:
    """With the date of birth, as written; the tables' dob_normalized is empty."""
    names = table(spark, d, "sanctions_alerts").select(F.col("customer_name").alias("name"), "dob")
    lists = table(spark, d, "sanctions").withColumn("dob_normalized", F.col("dob"))
    return matching.screen_exact(names, lists).select("name", "dob", F.size("hits").cast("bigint").alias("hits"), "verdict")


@query(f"WITH {CURRENT}, a AS (SELECT alert_id, coalesce(nullif(matched_entity,''), nullif(customer_name,''), '') e FROM cur) SELECT DISTINCT alert_id FROM a JOIN customer_kyc k ON e <> '' AND contains(k.full_name, e)")
def ubo_flag(spark: SparkSession, d: str) -> DataFrame:
    return _holds(spark, d, None, 5).filter("n > 0").select("alert_id")


@query("SELECT full_name, array_to_string(w, '|') tokens, array_to_string(list_transform(w, lambda x: x[1]), '') initials, len(w) n FROM (SELECT DISTINCT full_name, list_filter(regexp_split_to_array(full_name, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w FROM sanctions)")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = T.tokens("full_name")
    return table(spark, d, "sanctions").select("full_name").distinct().select("full_name", F.array_join(w, "|").alias("tokens"), T.initials(w).alias("initials"), F.size(w).cast("bigint").alias("n"))


@query()
def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return table(spark, d, "sanctions").select("full_name").distinct().withColumn("norm", T.normalise("full_name"))


_ISO, _DMY = "regexp_extract(s, '^(\\d{4})-(\\d{1,2})-(\\d{1,2})', ['a', 'b', 'c'])", "regexp_extract(s, '^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})', ['c', 'b', 'a'])"
_MADE = "CASE WHEN try_cast({x}.b AS INT) BETWEEN 1 AND 12 AND try_cast({x}.c AS INT) BETWEEN 1 AND 31 THEN {x}.a || '-' || lpad(CAST(try_cast({x}.b AS INT) AS VARCHAR), 2, '0') || '-' || lpad(CAST(try_cast({x}.c AS INT) AS VARCHAR), 2, '0') END"
_MONTH = "MAP {" + ", ".join(f"'{m}': {n}" for m, n in T._MONTHS.items()) + "}"


@query(f"""WITH v AS (SELECT id, dob, trim(coalesce(dob, ''), ' ') s FROM sanctions), w AS (SELECT *, {_ISO} i, {_DMY} j, regexp_extract_all(lower(s), '([a-z]+|\\d+)') w FROM v),
n AS (SELECT *, list_filter(list_transform(w, lambda x: try_cast(x AS INT)), lambda x: x IS NOT NULL) nums, list_filter(list_transform(w, lambda x: {_MONTH}[x]), lambda x: x IS NOT NULL)[-1] m FROM w),
y AS (SELECT *, list_filter(nums, lambda x: x BETWEEN 1900 AND 2100)[1] y, list_filter(nums, lambda x: x BETWEEN 1 AND 31)[1] d FROM n)
SELECT id, dob, coalesce({_MADE.format(x='i')}, {_MADE.format(x='j')}, CASE WHEN y IS NOT NULL AND m IS NOT NULL AND d IS NOT NULL THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') WHEN y IS NOT NULL AND m IS NOT NULL THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' WHEN y IS NOT NULL THEN y || '-01-01' END, '') dob_normalized FROM y""")
def dob_simple(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sanctions").select("id", "dob", T.simple_dob(F.col("dob")).alias("dob_normalized"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) words FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count("text").cast("bigint").alias("words"))


_U = "upper(regexp_replace(full_name, '[^A-Za-z]', '', 'g'))"
_RUNS = lambda c, digits: f"{'regexp_replace(' * len(digits)}{c}{''.join(f", '{x}+', '{x}', 'g')" for x in digits)}"


@query(f"WITH n AS (SELECT DISTINCT full_name, {_U} u FROM sanctions) SELECT full_name, CASE WHEN u = '' THEN '0000' ELSE left(rpad(u[1] || replace(substr({_RUNS(f"translate(u, '{M.SOUNDEX[0]}', '{M.SOUNDEX[1]}')", '0123456')}, 2), '0', ''), 4, '0'), 4) END soundex, CASE WHEN u = '' THEN '' ELSE u[1] || replace({_RUNS(f"translate(substr(u, 2), '{M.REFINED[0]}', '{M.REFINED[1]}')", '0123456789A')}, '0', '') END refined FROM n")
def soundex_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sanctions").select("full_name").distinct().select("full_name", M.soundex(F.col("full_name")).alias("soundex"), M.refined_soundex(F.col("full_name")).alias("refined"))


# The similarities of each query, for pairs of plain letters and for all pairs.
def _edit(a: Column, b: Column) -> list[Column]:
    return [F.round(M.levenshtein_sim(a, b), 9).alias("levenshtein_sim"), F.round(M.hamming_sim(a, b), 9).alias("hamming_sim")]


def _jaro(j: Column, a: Column, b: Column) -> list[Column]:
    return [F.round(j, 9).alias("jaro"), F.round(M.jaro_winkler(j, a, b), 9).alias("jaro_winkler")]


def _token(a: Column, b: Column) -> list[Column]:
    return [F.round(M.jaccard(a, b), 9).alias("jaccard"), F.round(M.sorensen_dice(a, b), 9).alias("sorensen_dice"), F.round(M.token_set_ratio(a, b), 9).alias("token_set_ratio")]


def _ngram(a: Column, b: Column) -> list[Column]:
    return [F.round(M.ngram_cosine(a, b, 2), 9).alias("bigram_cos"), F.round(M.ngram_cosine(a, b, 3), 9).alias("trigram_cos")]


def _whole(a: Column, b: Column) -> list[Column]:
    return [M.exact(a, b).alias("exact"), F.round(M.substring(a, b), 9).alias("substring_sim"), M.initial_collapse(a, b).alias("initial_collapse")]


@query(f"WITH {PAIRS} SELECT a, b, round(1.0 - levenshtein(a, b) / greatest(len(a), len(b), 1)::DOUBLE, 9) levenshtein_sim, round(1.0 - (greatest(len(a), len(b)) - len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]))) / greatest(len(a), len(b), 1)::DOUBLE, 9) hamming_sim FROM pairs")
def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", *_edit(F.col("a"), F.col("b")))


@query(f"WITH {PAIRS}, j AS (SELECT a, b, jaro_similarity(a, b) j, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[1:2] <> b[1:2] OR least(len(a), len(b)) < 2 THEN 1 WHEN a[1:3] <> b[1:3] OR least(len(a), len(b)) < 3 THEN 2 WHEN a[1:4] <> b[1:4] OR least(len(a), len(b)) < 4 THEN 3 ELSE 4 END p FROM pairs) SELECT a, b, round(j, 9) jaro, round(j + 0.1 * p * (1 - j), 9) jaro_winkler FROM j")
def jaro_family(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    rows = _pairs(spark, d).withColumn("j", A.of_pairs(A.jaro)("a", "b"))
    return rows.select("a", "b", *_jaro(F.col("j"), F.col("a"), F.col("b")))


_WORDS = "wp AS (SELECT a, b, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) x, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) y FROM pairs), wl AS (SELECT *, len(list_intersect(x, y)) c, trim(array_to_string(list_sort(list_intersect(x, y)), ' ') || ' ' || array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ')) p, trim(array_to_string(list_sort(list_intersect(x, y)), ' ') || ' ' || array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ')) q FROM wp)"


@query(f"WITH {PAIRS}, {_WORDS} SELECT a, b, round(c / (len(x) + len(y) - c)::DOUBLE, 9) jaccard, round(2 * c / (len(x) + len(y))::DOUBLE, 9) sorensen_dice, round(1.0 - levenshtein(p, q) / greatest(len(p), len(q), 1)::DOUBLE, 9) token_set_ratio FROM wl")
def token_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", *_token(F.col("a"), F.col("b")))


def _cosine_sql(n: int) -> str:
    grams = lambda c: f"list_transform(range(1, greatest(len({c}) + {4 - n}, 2)), lambda i: substr(' ' || {c} || ' ', i, {n}))"
    count = lambda g, t: f"len(list_filter({t}, lambda v: v = {g}))"
    return f"(SELECT a, b, list_sum(list_transform(list_distinct(gx), lambda g: {count('g', 'gx')} * {count('g', 'gy')})) / sqrt(list_sum(list_transform(list_distinct(gx), lambda g: {count('g', 'gx')} * {count('g', 'gx')})) * list_sum(list_transform(list_distinct(gy), lambda g: {count('g', 'gy')} * {count('g', 'gy')}))) c FROM (SELECT a, b, {grams('a')} gx, {grams('b')} gy FROM pairs))"


@query(f"WITH {PAIRS} SELECT a, b, round(p.c, 9) bigram_cos, round(q.c, 9) trigram_cos FROM {_cosine_sql(2)} p JOIN {_cosine_sql(3)} q USING (a, b)")
def ngram_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", *_ngram(F.col("a"), F.col("b")))


@query(f"WITH {PAIRS}, t AS (SELECT a, b, list_filter(string_split(a, ' '), lambda x: x <> '') x, list_filter(string_split(b, ' '), lambda x: x <> '') y FROM pairs), i AS (SELECT *, array_to_string(list_transform(x, lambda w: w[1]), '') = array_to_string(list_transform(y, lambda w: w[1]), '') same, list_max(list_transform(x, lambda w: len(w))) <= 2 OR list_max(list_transform(y, lambda w: len(w))) <= 2 short FROM t) SELECT a, b, (a = b)::INT::DOUBLE exact, CASE WHEN contains(a, b) OR contains(b, a) THEN round(least(len(a), len(b)) / greatest(len(a), len(b))::DOUBLE, 9) ELSE 0.0 END AS substring_sim, (CASE WHEN NOT same THEN 0.0 WHEN short THEN 1.0 ELSE 0.5 END)::DOUBLE initial_collapse FROM i")
def substring_initial(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", *_whole(F.col("a"), F.col("b")))


@query()
def name_similarities(spark: SparkSession, d: str) -> DataFrame:
    """The similarities of the five queries above over all pairs, beyond the plain letters that their SQL compares; null counts as ''."""
    ship(spark)
    x, y = (F.coalesce(c, F.lit("")) for c in ("a", "b"))
    rows = _all_pairs(spark, d).withColumns({"x": x, "y": y}).withColumn("j", A.of_pairs(A.jaro)("x", "y"))
    x, y = F.col("x"), F.col("y")
    return rows.select("a", "b", *_edit(x, y), *_jaro(F.col("j"), x, y), *_token(x, y), *_ngram(x, y), *_whole(x, y))


@query()
def phonetic_keys(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return table(spark, d, "sanctions").select("full_name").distinct().select("full_name", A.of_names(A.metaphone)("full_name").alias("metaphone"), A.of_names(A.nysiis)("full_name").alias("nysiis"))


@query()
def alignment(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _all_pairs(spark, d).select("a", "b", *(A.of_pairs(f)("a", "b").alias(f.__name__) for f in (A.damerau_sim, A.lcs_sim, A.smith_waterman, A.needleman_wunsch)))


_W = lambda s, m, u: f"CASE WHEN {s} >= 0.9 THEN log2({m}/{u}) WHEN {s} <= 0.1 THEN log2({1 - m}/{1 - u}) ELSE {s} * log2({m}/{u}) + (1 - {s}) * log2({1 - m}/{1 - u}) END"
_DOB = "CASE WHEN coalesce(a.dob,'') = '' OR coalesce(s.dob,'') = '' THEN 0.5 WHEN regexp_extract(a.dob, '\\b((?:19|20)\\d{2})\\b', 1) = '' OR regexp_extract(s.dob, '\\b((?:19|20)\\d{2})\\b', 1) = '' THEN 0.5 WHEN trim(a.dob) = trim(s.dob) THEN 1.0 WHEN regexp_extract(a.dob, '\\b((?:19|20)\\d{2})\\b', 1) = regexp_extract(s.dob, '\\b((?:19|20)\\d{2})\\b', 1) THEN 0.7 ELSE 0.0 END"
_NAT = "CASE WHEN coalesce(a.nationality,'') = '' OR coalesce(s.nationality,'') = '' THEN 0.5 WHEN substr(lower(trim(a.nationality)), 1, 2) = substr(lower(trim(s.nationality)), 1, 2) THEN 1.0 ELSE 0.0 END"


@query(f"WITH {CURRENT}, p AS (SELECT a.alert_id, s.id, {_DOB} dob_score, {_NAT} nationality_score FROM cur a JOIN sanctions s ON a.matched_entity = s.full_name AND a.source_list = s.source) SELECT alert_id, id, dob_score::DOUBLE dob_score, nationality_score::DOUBLE nationality_score, round(1 / (1 + exp(-({_W('1.0', 0.95, 0.1)} + {_W('dob_score', 0.99, 0.05)} + {_W('nationality_score', 0.9, 0.15)}) / 3)), 9) score FROM p")
def fellegi_sunter(spark: SparkSession, d: str) -> DataFrame:
    a = review.current(table(spark, d, "sanctions_alerts")).select("alert_id", "matched_entity", "source_list", F.col("dob").alias("d1"), F.col("nationality").alias("n1"))
    s = table(spark, d, "sanctions").select("id", F.col("full_name").alias("matched_entity"), F.col("source").alias("source_list"), F.col("dob").alias("d2"), F.col("nationality").alias("n2"))
    rows = a.join(s, ["matched_entity", "source_list"]).select("alert_id", "id", M.dob_score(F.col("d1"), F.col("d2")).alias("dob_score"), M.nationality_score(F.col("n1"), F.col("n2")).alias("nationality_score"))
    return rows.withColumn("score", F.round(M.probability(F.lit(1.0), F.col("dob_score"), F.col("nationality_score")), 9))


@query()
def screen_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    people = table(spark, d, "prior_cases").select(F.col("name_queried").alias("name"), F.lit(None).cast("string").alias("dob"), F.lit(None).cast("string").alias("nationality"))
    return matching.screen_fuzzy(people, table(spark, d, "sanctions"))


@query()
def prior_case_match(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    names = table(spark, d, "sanctions_alerts").select(F.col("customer_name").alias("name"))
    return review.case_counts(review.similar_cases(names, table(spark, d, "prior_cases")))


@query("SELECT id, full_name, regexp_matches(full_name, '" + T.CORPORATE.replace("'", "''") + "') organisation FROM sanctions")
def entity_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sanctions").select("id", "full_name", (T.entity_class(F.col("full_name")) == "organisation").alias("organisation"))


_PAGE = ", ".join(f"'{t}'" for t in T.PAGE_TOKENS)


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents) SELECT doc_id, count(*) lines, count(*) FILTER (WHERE len(trim(line)) BETWEEN 5 AND 250 AND NOT regexp_matches(trim(line), '^[0-9]+$') AND NOT regexp_matches(trim(line), '(?i)^(https?://|www\\.)') AND regexp_matches(line, '[A-Za-zऀ-ॿ]') AND len(list_filter([{_PAGE}], lambda t: contains(lower(trim(line)), t))) = 0) names FROM l GROUP BY 1")
def entity_name_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.valid_entity_name(F.col("line"))).alias("names"))


# --- audit -----------------------------------------------------------------------------------------------------------
_HASH = "sha256('{\"alert_id\":' || to_json(alert_id) || ',\"event\":' || to_json(event) || ',\"tool\":' || to_json(tool) || ',\"tool_input\":' || to_json(props::VARCHAR) || ',\"ts\":' || to_json(ts) || '}')"


@query(f"WITH {EVENTS} SELECT seq, {_HASH} sha256 FROM ev")
def audit_hashes(spark: SparkSession, d: str) -> DataFrame:
    return audit.append_hashes(_events(spark, d)).select("seq", "sha256")


@query(f"WITH {EVENTS} SELECT alert_id, count(*) total_events, array_to_string(list_sort(list(DISTINCT tool) FILTER (WHERE event = 'tool_call')), ',') tools_called, count(*) FILTER (WHERE event = 'tool_blocked') blocked, count(*) FILTER (WHERE seq % 97 = 0) = 0 intact FROM ev GROUP BY 1")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of a trail in which every 97th entry was changed after it was written."""
    log = audit.append_hashes(_events(spark, d)).withColumn("reason", F.when(F.col("seq") % 97 == 0, "changed").otherwise(F.col("reason")))
    return audit.summary(log).withColumn("tools_called", F.array_join("tools_called", ","))


@query(f"WITH {EVENTS} SELECT seq FROM ev WHERE seq % 97 = 0")
def tampered_entries(spark: SparkSession, d: str) -> DataFrame:
    log = audit.append_hashes(_events(spark, d)).withColumn("reason", F.when(F.col("seq") % 97 == 0, "changed").otherwise(F.col("reason")))
    return audit.tampered(log).select("seq")


@query(f"WITH {EVENTS} SELECT seq, sha256('{{\"alert_id\": ' || to_json(alert_id) || ', \"event\": ' || to_json(event) || ', \"reason\": null, \"tool\": ' || to_json(tool) || ', \"tool_input\": \"x ' || seq || '\", \"tool_output_summary\": null, \"ts\": ' || to_json(ts) || '}}') sha256 FROM ev")
def audit_hashes_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Hashes over JSON as Python writes it: blanks after separators, nulls kept."""
    ship(spark)
    rows = _events(spark, d).withColumn("tool_input", F.concat(F.lit("x "), "seq"))
    return rows.select("seq", audit.entry_hash_compatible(F.struct(*audit.HASHED)).alias("sha256"))


@query(f"WITH {EVENTS} SELECT ts, alert_id, tool, event FROM ev ORDER BY ts DESC, {_HASH} LIMIT 100")
def audit_tail(spark: SparkSession, d: str) -> DataFrame:
    return audit.tail(audit.append_hashes(_events(spark, d)), 100).select("ts", "alert_id", "tool", "event")


@query(f"WITH {EVENTS} SELECT count(*) attempts, count(*) FILTER (WHERE event = 'tool_blocked') blocked, count(*) FILTER (WHERE event = 'tool_call') successes, count(*) FILTER (WHERE event = 'tool_blocked') / count(*)::DOUBLE rate, bool_and(event = 'tool_blocked') passed FROM ev WHERE tool = (SELECT min(tool) FROM ev)")
def block_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    first = rows.agg(F.min("tool").alias("t"))  # one row
    return audit.block_rate(rows.join(first).withColumn("tool", F.when(F.col("tool") == F.col("t"), audit.BLOCKED_TOOL).otherwise(F.col("tool"))))


_FILLS = f"WITH {EVENTS}, f AS (SELECT *, max((source = 'llm')::INT) OVER (PARTITION BY alert_id, tool ORDER BY seq ROWS UNBOUNDED PRECEDING) l FROM ev)"


@query(f"{_FILLS} SELECT tool, count(*) FILTER (WHERE l = 0) true_fills, count(*) FILTER (WHERE l = 1) redundant_fills, count(*) FILTER (WHERE l = 0) / (SELECT count(DISTINCT alert_id) FROM ev)::DOUBLE rate FROM f WHERE source = 'fill' GROUP BY 1")
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return audit.fill_rates(_events(spark, d))


@query(f"WITH {EVENTS} SELECT alert_id, count(DISTINCT tool) FILTER (WHERE source = 'llm') llm_tools, count(DISTINCT tool) all_tools, count(DISTINCT tool) >= 5 complete FROM ev GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(_events(spark, d), 5)


@query(f"WITH {EVENTS}, c AS (SELECT alert_id, count(DISTINCT tool) FILTER (WHERE source = 'llm') l, count(DISTINCT tool) a FROM ev GROUP BY 1) SELECT count(*) alerts, round(avg(l), 9) mean_llm_tools, round(avg(a), 9) mean_all_tools, bool_and(a >= 5) all_complete FROM c")
def coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage_totals(audit.coverage(_events(spark, d), 5)).withColumns({c: F.round(c, 9) for c in ("mean_llm_tools", "mean_all_tools")})


@query(f"WITH {EVENTS} SELECT tool, count(*) calls, count(*) FILTER (WHERE source = 'fill') fills, count(*) FILTER (WHERE source = 'fill') / count(*)::DOUBLE fill_share FROM ev GROUP BY 1")
def fills_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return audit.fills_by_tool(_events(spark, d))


@query(f"{_FILLS}, k AS (SELECT list_sort(list(DISTINCT tool))[1:2] two FROM ev) SELECT count(*) FILTER (WHERE l = 0 AND list_contains(two, tool)) true_fills, count(*) FILTER (WHERE l = 0 AND list_contains(two, tool)) / ((SELECT count(DISTINCT alert_id) FROM ev) * 2)::DOUBLE rate FROM f, k WHERE source = 'fill'")
def headline_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    """The first two event types stand for the two tools that the model may call."""
    rows = _events(spark, d)
    two = rows.select("tool").distinct().orderBy("tool").limit(2).agg(F.collect_list("tool").alias("two"))  # one row
    named = F.when(F.col("tool") == F.col("two")[0], audit.ELIGIBLE[0]).when(F.col("tool") == F.col("two")[1], audit.ELIGIBLE[1]).otherwise(F.col("tool"))
    return audit.headline_fill_rate(rows.join(two).withColumn("tool", named).drop("two")).select("true_fills", "rate")


@query(f"WITH {EVENTS}, w AS (SELECT list_sort(list(DISTINCT tool))[1:2] two FROM ev) SELECT alert_id, len(list_filter(two, lambda x: NOT list_contains(h, x))) = 0 covered FROM (SELECT alert_id, list(DISTINCT tool) h FROM ev GROUP BY 1), w")
def required_tools(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    two = rows.select("tool").distinct().orderBy("tool").limit(2).agg(F.collect_list("tool").alias("two"))  # one row
    have = rows.groupBy("alert_id").agg(F.collect_set("tool").alias("have"))  # as many as there are tools
    return have.join(two).select("alert_id", audit.covers(F.col("have"), F.col("two")).alias("covered"))


@query("SELECT event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND contains(lower(props), '1')")
def timeline_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    first = rows.agg(F.min("event_type").alias("t"))  # one row
    named = rows.join(first).withColumn("category", F.when(F.col("event_type") == F.col("t"), "first").otherwise("other"))
    return audit.timeline(named, "first", "1", text_column="props").select("event_id", "ts")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return audit.recent(table(spark, d, "events"), "ts", "event_id").select("event_id", "ts", "event_type")


@query("SELECT event_id, CASE WHEN value / 10 > 25 THEN 'late' WHEN value / 10 > 20 THEN 'red' WHEN value / 10 > 15 THEN 'amber' WHEN value IS NOT NULL THEN 'green' END band FROM events")
def sla_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", review.sla_band(F.col("value") / 10).alias("band"))


@query(f"WITH {CURRENT}, c AS (SELECT alert_id, bool_or(tool = 'sanctions_screening') s, list(customer_id) FILTER (WHERE tool = 'dynamodb_kyc') k FROM (SELECT alert_id, 'sanctions_screening' tool, NULL customer_id FROM cur WHERE status = 'PENDING' UNION ALL SELECT alert_id, 'dynamodb_kyc', CASE WHEN status = 'PENDING' THEN customer_id ELSE 'CUST-0' END FROM cur WHERE status <> 'CLEARED') GROUP BY 1), a AS (SELECT cur.*, s, coalesce(k, []) k FROM cur LEFT JOIN c USING (alert_id)) SELECT alert_id, 'sanctions_screening' tool, 'missing' reason FROM a WHERE s IS DISTINCT FROM true UNION ALL SELECT alert_id, 'dynamodb_kyc', CASE WHEN len(list_filter(k, lambda x: x IS NOT NULL)) = 0 THEN 'missing' ELSE 'other customer' END FROM a WHERE NOT coalesce(list_contains(k, customer_id), false) UNION ALL SELECT alert_id, unnest(['adverse_media', 'company_registry', 'ubo_chain', 'prior_cases']), 'always' FROM a WHERE coalesce(customer_id, '') <> '' AND coalesce(nullif(matched_entity,''), nullif(customer_name,''), '') <> ''")
def needed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Pending alerts have been screened; customers' data were fetched for all but cleared ones, for escalated ones those of another customer."""
    alerts = table(spark, d, "sanctions_alerts")
    cur = review.current(alerts)
    screened = cur.filter("status = 'PENDING'").select("alert_id", F.lit(audit.TOOLS[0]).alias("tool"), F.lit(None).cast("string").alias("customer_id"))
    fetched = cur.filter("status <> 'CLEARED'").select("alert_id", F.lit(audit.TOOLS[1]).alias("tool"), F.when(F.col("status") == "PENDING", F.col("customer_id")).otherwise("CUST-0").alias("customer_id"))
    return audit.needed_calls(alerts, screened.unionByName(fetched))


@query("WITH r AS (SELECT CAST(user_id AS VARCHAR) alert_id, event_type verdict, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE '' END error FROM events), g AS (SELECT alert_id, count(*) FILTER (WHERE error = '') o, count(DISTINCT verdict) FILTER (WHERE error = '') v FROM r GROUP BY 1) SELECT count(*) alerts, count(*) FILTER (WHERE o = 3 AND v = 1) consistent FROM g")
def consistency_totals(spark: SparkSession, d: str) -> DataFrame:
    return audit.consistency_totals(_consistency(spark, d)).select("alerts", "consistent")


@query("WITH r AS (SELECT CAST(user_id AS VARCHAR) alert_id, event_type verdict, round(value / 1000, 6) score, event_id run, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE '' END error FROM events), g AS (SELECT alert_id, count(*) FILTER (WHERE error = '') ok_runs, count(DISTINCT verdict) FILTER (WHERE error = '') verdicts, max(score) FILTER (WHERE error = '') - min(score) FILTER (WHERE error = '') spread FROM r GROUP BY 1) SELECT alert_id, ok_runs, verdicts, round(spread, 9) spread, ok_runs = 3 AND verdicts = 1 verdict_consistent FROM g")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return _consistency(spark, d).select("alert_id", "ok_runs", "verdicts", F.round("spread", 9).alias("spread"), "verdict_consistent")


def _consistency(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("user_id").cast("string").alias("alert_id"), F.col("event_type").alias("verdict"), F.round(F.col("value") / 1000, 6).alias("score"), F.col("event_id").alias("run"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("").alias("error"))
    return audit.consistency(runs, 3)


@query("WITH g AS (SELECT user_id, epoch(max(ts)) - epoch(min(ts)) s, count(*) t FROM events GROUP BY 1) SELECT count(*) processed, CAST(sum(t) AS BIGINT) events, round(avg(s), 6) latency, least(100.0, avg(s) / 15 * 100) trend_latency FROM g")
def dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("alert_id"), "ts")
    rows = e.select("alert_id", "ts", F.explode(F.array(F.lit("alert_start"), F.lit("alert_complete"), F.lit("tool_call"))).alias("type")).withColumn("verdict", F.lit(None).cast("string"))
    return audit.dashboard(rows, 1).select("processed", F.col("tools_fired").alias("events"), F.round("latency", 6).alias("latency"), "trend_latency")


@query()
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """The generated narratives against their own numbers; they cite no list and no regulation."""
    sheet = review.worksheet(_triaged(spark, d), review.watchlist_hits(table(spark, d, "sanctions_alerts"), table(spark, d, "sanctions")))
    rows = sheet.select("alert_id", "narrative", F.transform("narrative_citations", lambda c: c["marker"]).alias("markers"), F.col("final_risk_score").alias("final"), F.array(F.format_string("%.2f", "initial_match_score")).alias("known"))
    return audit.narrative_checks(rows).drop("markers", "known")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"WITH {CURRENT} SELECT i.case_alert alert_id, c.alert_id IS NULL missing FROM (SELECT DISTINCT alert_id case_alert FROM prior_cases UNION SELECT min(alert_id) FROM sanctions_alerts) i LEFT JOIN cur c ON c.alert_id = i.case_alert")
def alerts_of_cases(spark: SparkSession, d: str) -> DataFrame:
    alerts = table(spark, d, "sanctions_alerts")
    ids = table(spark, d, "prior_cases").select("alert_id").union(alerts.agg(F.min("alert_id"))).distinct()
    return review.with_missing(ids, alerts).select("alert_id", "missing")


@query()
def name_sample(spark: SparkSession, d: str) -> DataFrame:
    """A random sample of 200 list names, as the generator of test customers draws them."""
    return sampling.random_sample(sampling.usable_names(table(spark, d, "sanctions")), 200, "id")


@query()
def synthetic_customers(spark: SparkSession, d: str) -> DataFrame:
    return sampling.synthetic_customers(table(spark, d, "sanctions"), 200)


# --- state -----------------------------------------------------------------------------------------------------------
@query("WITH n AS (SELECT source, arg_max(struct_pack(f := fetched_at, s := status, r := records), fetched_at || lpad(CAST(id AS VARCHAR), 20, '0')) x FROM fetch_log GROUP BY 1) SELECT coalesce(s.source, n.source) source, s.last_hash, CASE WHEN n.source IS NULL OR coalesce(s.last_fetched, '') > n.x.f THEN s.last_fetched ELSE n.x.f END last_fetched, CASE WHEN n.source IS NULL OR coalesce(s.last_fetched, '') > n.x.f THEN s.status ELSE n.x.s END status FROM fetch_state s FULL JOIN n ON s.source = n.source")
def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "fetch_state")
    newest = table(spark, d, "fetch_log").groupBy("source").agg(F.max_by(F.struct("fetched_at", "status", "records"), F.struct("fetched_at", "id")).alias("x"))
    have = old.select("source", "last_hash", "last_etag", "last_modified")
    new = newest.join(have, "source", "left").select("source", "last_etag", "last_modified", "last_hash", F.col("x.fetched_at").alias("last_fetched"), F.col("x.records").alias("last_count"), F.col("x.status").alias("status"))
    return state.upserted(old, new, "source", "last_fetched").select("source", "last_hash", "last_fetched", "status")


@query("SELECT source, count(*) n, min(id) lowest FROM (SELECT source, id FROM sanctions WHERE source NOT IN (SELECT DISTINCT source FROM sanctions WHERE source LIKE 'ofac%') UNION ALL SELECT source, id + 1000000000 FROM sanctions WHERE source LIKE 'ofac%') GROUP BY 1")
def source_replace(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "sanctions").select("source", "id")
    new = old.filter(F.col("source").startswith("ofac")).withColumn("id", F.col("id") + 1_000_000_000)
    return state.replaced(old, new).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lowest"))


@query("SELECT customer_id FROM customer_kyc WHERE NOT starts_with(customer_id, 'CUST-A')")
def prefix_delete(spark: SparkSession, d: str) -> DataFrame:
    return state.without_prefix(table(spark, d, "customer_kyc"), "customer_id", "CUST-A").select("customer_id")


@query("WITH l AS (SELECT source, md5(count(*) || ':' || coalesce(min(full_name), '') || ':' || coalesce(max(full_name), '') || ':' || max(id)) h FROM sanctions GROUP BY 1) SELECT l.source, h last_hash, h IS DISTINCT FROM s.last_hash changed FROM l LEFT JOIN fetch_state s USING (source)")
def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    """A summary of each source's entries stands for the content of its landed file."""
    rows = table(spark, d, "sanctions").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("full_name"), F.lit("")).alias("a"), F.coalesce(F.max("full_name"), F.lit("")).alias("b"), F.max("id").alias("c"))
    return state.changed_sources(rows.select("source", F.concat_ws(":", "n", "a", "b", "c").alias("content")), table(spark, d, "fetch_state"))


@query(f"WITH {TRIAGED} SELECT alert_id, customer_id, customer_name, round(score, 9) final_risk_score, true requires_review FROM triaged WHERE recommendation = 'FALSE_POSITIVE'")
def clearance_memory(spark: SparkSession, d: str) -> DataFrame:
    return state.clearances(_triaged(spark, d), "2025-07-01T00:00:00Z").select("alert_id", "customer_id", "customer_name", F.round("final_risk_score", 9).alias("final_risk_score"), "requires_review")


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) n FROM events GROUP BY 1, 2")
def events_per_minute_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table read as a stream of files; its windows, completed, equal the batch."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(_folder(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(spark)}/minutes-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    counted = live.per_minute(stream, "ts", "event_type")
    run = counted.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-state-{id(counted)}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """A folder that holds the table's files, as streams need one: the table itself, or a copy of a single file."""
    path = f"{d}/{name}.parquet"
    if is_folder(spark, path):
        return path
    copy = f"{shared_dir(spark)}/stream-{spark.sparkContext.applicationId}-{name}-{abs(hash(d))}"
    spark.read.parquet(path).write.mode("overwrite").parquet(copy)
    return copy


