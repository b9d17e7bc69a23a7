"""Changes of stored tables: replacing one source, keeping the latest state per key, appending logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamisol.functions.text import simple_dob

# The columns of a list entry, all text.
ENTRY = ["source", "authority", "region", "entity_type", "last_name", "first_name", "full_name", "program", "nationality", "dob", "listed_on", "raw_data"]


def as_entries(rows: DataFrame) -> DataFrame:
    """Rows of a parsed list with every column of ENTRY, '' where one is missing, and the normalised date of birth."""
    have = set(rows.columns)
    out = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in ENTRY))
    return out.withColumn("dob_normalized", simple_dob(F.col("dob")))


def replace_source(rows: DataFrame, path: str) -> None:
    """Write entries so that each source in ``rows`` replaces its own partition only; an empty batch changes nothing. One page of a source replaces only itself where there is a column page."""
    keys = ["source", "page"] if "page" in rows.columns else ["source"]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """What replace_source leaves: old rows of other sources, and the new ones."""
    return old.join(new.select("source").distinct(), "source", "left_anti").unionByName(new, allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``, new rows before old ones of the same. The aggregation combines before its shuffle."""
    cols = [c for c in old.columns if c != key]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(old.columns).withColumn("__new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.coalesce(F.col(order).cast("string"), F.lit("")), "__new")).alias("r")).select(key, "r.*").select(old.columns)


def append(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("append").format(fmt).save(path)


def without_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """All rows but those whose key begins with ``prefix``; rows without a key stay."""
    return rows.filter(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def changed_sources(landed: DataFrame, state: DataFrame) -> DataFrame:
    """(source, last_hash, changed): landed files (source, content) whose MD5 differs from the last one fetched, or that are new."""
    now = landed.select("source", F.md5(F.encode("content", "UTF-8") if dict(landed.dtypes)["content"] == "string" else F.col("content")).alias("last_hash"))
    known = state.select(F.col("source").alias("__s"), F.col("last_hash").alias("__h"))
    return now.join(known, now["source"] == known["__s"], "left").select("source", "last_hash", (~F.col("last_hash").eqNullSafe(F.col("__h"))).alias("changed"))


def to_fetch(landed: DataFrame, state: DataFrame) -> DataFrame:
    """(source, unchanged): whether a source's validators say that it hasn't changed: the same etag, or, where one side has none, the same last_modified. Columns: source, etag, last_modified."""
    known = state.select("source", F.nullif("last_etag", F.lit("")).alias("__e"), F.nullif("last_modified", F.lit("")).alias("__m"))
    now = landed.select("source", F.nullif("etag", F.lit("")).alias("e"), F.nullif("last_modified", F.lit("")).alias("m"))
    both = F.col("e").isNotNull() & F.col("__e").isNotNull()
    same = F.when(both, F.col("e") == F.col("__e")).otherwise(F.col("m") == F.col("__m"))
    return now.join(known, "source", "left").select("source", F.coalesce(same, F.lit(False)).alias("unchanged"))


def clearances(triaged: DataFrame, at: str, source: str = "auto") -> DataFrame:
    """What the memory of cleared customers gets: alerts that came out as false positives. Automatic ones need a review."""
    rows = triaged.filter(F.col("recommendation") == "FALSE_POSITIVE")
    return rows.select("customer_name", "customer_id", F.coalesce("dob", F.lit("")).alias("dob"), F.coalesce("nationality", F.lit("")).alias("nationality"), "alert_id", "final_risk_score", F.lit(at).alias("resolved_at"), F.lit(source).alias("source"), F.lit(source == "auto").alias("requires_review"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of prior cases with their ordinal, which is their place in the file."""
    fields = "case_id string, name_queried string, alert_id string, resolution string, resolved_by string, resolved_at string, resolution_note string"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{fields.replace(' string', ': string')}>>"))).select((F.col("pos") + 1).alias("ordinal"), "col.*")
