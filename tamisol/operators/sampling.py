"""Repeatable samples and draws, and test customers made from list entries.

Every draw is a hash of a key and a seed, so a task that is run again makes the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamisol.functions.text import family_and_given

# Kinds of test customers and how often each is made: same data, another birth date, none, another nationality, a short name.
VARIANTS = {"A": 80, "B": 70, "C": 25, "D": 20, "E": 5}


def uniform(key: Column | str, seed: int) -> Column:
    """A number from 0 to 1 that follows from the key and the seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows at random: those with the smallest draws, ties by key. Each task keeps n rows, so nothing is sorted as a whole."""
    return df.withColumn("__u", uniform(key, seed)).orderBy("__u", key).limit(n).drop("__u")


def weighted_draw(u: Column, weights: dict[str, float]) -> Column:
    """The value whose part of the cumulated weights holds u."""
    total, run, out = float(sum(weights.values())), 0.0, None
    for value, w in weights.items():
        run += w
        out = F.when(u < run / total, value) if out is None else out.when(u < run / total, value)
    return out.otherwise(list(weights)[-1])


def usable_names(sanctions: DataFrame) -> DataFrame:
    """Entries of people with a name of 6 to 79 characters."""
    return sanctions.filter(F.col("full_name").isNotNull() & F.length("full_name").between(6, 79) & F.lower("entity_type").isin("individual", "person")).select("id", "full_name", "dob", "nationality")


def synthetic_customers(sanctions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(customer_id, full_name, last_name, first_name, dob, nationality, variant_type, derived_from_sanction): n test customers from list entries, by weighted variant."""
    rows = random_sample(usable_names(sanctions), n, "id", seed).withColumn("variant_type", weighted_draw(uniform("id", seed + 1), VARIANTS))
    family, given = family_and_given(F.col("full_name"))
    v = F.col("variant_type")
    year = (1950 + F.floor(uniform("id", seed + 2) * 50)).cast("string")
    return rows.select(
        F.concat(F.lit("CUST-"), F.upper(F.substring(F.sha2(F.concat_ws("-", F.lit(str(seed)), "id"), 256), 1, 8))).alias("customer_id"), F.when(v == "E", F.concat(F.substring(given, 1, 1), F.lit(". "), family)).otherwise(F.col("full_name")).alias("full_name"),
        family.alias("last_name"), given.alias("first_name"), F.when(v == "C", None).when(v == "B", F.concat(year, F.lit("-01-01"))).otherwise(F.col("dob")).alias("dob"), F.when(v == "D", "XX").otherwise(F.col("nationality")).alias("nationality"), v, F.col("full_name").alias("derived_from_sanction"),
    )


def synthetic_transactions(customers: DataFrame, each: int = 50, seed: int = 42) -> DataFrame:
    """(transaction_id, customer_id, date, amount, currency, txn_type): ``each`` payments per customer within a year."""
    rows = customers.select("customer_id", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("n")).withColumn("__k", F.concat_ws("-", "customer_id", "n"))
    return rows.select(
        F.concat(F.lit("TXN-"), F.upper(F.substring(F.sha2(F.col("__k"), 256), 1, 12))).alias("transaction_id"), "customer_id", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(uniform("__k", seed) * 365).cast("int")), "yyyy-MM-dd").alias("date"),
        F.format_string("%.2f", F.exp(uniform("__k", seed + 1) * 12)).alias("amount"), weighted_draw(uniform("__k", seed + 2), {"USD": 5, "EUR": 3, "INR": 2}).alias("currency"), weighted_draw(uniform("__k", seed + 3), {"DEBIT": 1, "CREDIT": 1}).alias("txn_type"),
    )
