"""Queries of the list readers: the entries of all lists, landed as files of each format in the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamisol.plans.catalogue import query
from tamisol.session import shared_dir, ship, table
from tamisol.sources import lists

# The entries as ``_rows`` writes them.
ROWS = "r AS (SELECT id, " + ", ".join(f"trim(regexp_replace(coalesce({c}, ''), '[\\x00-\\x1F|;\"]+', ' ', 'g'), ' ') {c}" for c in ("last_name", "first_name", "full_name", "nationality", "dob", "program", "listed_on", "entity_type")) + " FROM sanctions)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Every entry, its texts without what separates fields in one of the formats."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), '[\\x00-\\x1F|;"]+', " ")).alias(c)
    return table(spark, d, "sanctions").select("id", *(plain(c) for c in ("last_name", "first_name", "full_name", "nationality", "dob", "program", "listed_on", "entity_type")))


def _land(lines: DataFrame, name: str, head: str | None = None, foot: str | None = None) -> str:
    """A folder of text files of the one column of ``lines``. With a head, and a foot, one file that begins and ends with these, as lists that are one document do."""
    spark, c = lines.sparkSession, lines.columns[0]
    path = f"{shared_dir(spark)}/landed-{name}-{uuid.uuid4().hex}"
    if head is not None:
        around = spark.createDataFrame([(k, x) for k, x in ((0, head), (2, foot)) if x is not None], "k int, x string")
        lines = lines.select(F.lit(1).alias("k"), F.col(c).alias("x")).unionByName(around).coalesce(1).sortWithinPartitions("k").select("x")
    lines.write.text(path)
    return path


def _xml(c: Column | str) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _tag(name: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), _xml(c), F.lit(f"</{name}>"))


@query(f"WITH {ROWS} SELECT id, last_name, first_name, regexp_replace(last_name || ', ' || first_name, '^[, ]+|[, ]+$', '', 'g') full_name, entity_type, program, nationality, dob FROM r")
def read_sdn_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    text = F.concat(
        F.lit("<sdnEntry>"), _tag("uid", F.col("id").cast("string")), _tag("lastName", "last_name"), _tag("firstName", "first_name"), _tag("sdnType", "entity_type"), F.lit("<programList>"), _tag("program", "program"),
        F.lit("</programList><nationalityList><nationality>"), _tag("country", "nationality"), F.lit("<mainEntry>true</mainEntry></nationality></nationalityList><dateOfBirthList><dateOfBirthItem>"), _tag("dateOfBirth", "dob"), F.lit("</dateOfBirthItem></dateOfBirthList></sdnEntry>"),
    )
    read = lists.sdn_xml(spark, _land(rows.select(text.alias("x")), "sdn", "<sdnList>", "</sdnList>"), "ofac_full_xml")
    return read.select(F.get_json_object("raw_data", "$.uid").cast("bigint").alias("id"), "last_name", "first_name", "full_name", "entity_type", "program", "nationality", "dob")


@query(f"WITH {ROWS} SELECT id, trim(split_part(full_name, ',', 1), ' ') last_name, CASE WHEN contains(full_name, ',') THEN trim(regexp_replace(full_name, '^[^,]*,', ''), ' ') ELSE '' END first_name, full_name, entity_type, program, nationality, dob FROM r WHERE full_name <> ''")
def read_consolidated_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c) if isinstance(c, str) else c, F.lit('"'))
    remarks = F.concat_ws("; ", F.when(F.col("dob") != "", F.concat(F.lit("DOB "), "dob")), F.when(F.col("nationality") != "", F.concat(F.lit("nationality "), "nationality")))
    line = F.concat_ws(",", F.col("id").cast("string"), quoted("full_name"), quoted("entity_type"), quoted("program"), *(F.lit("-0-") for _ in range(7)), quoted(remarks))
    read = lists.consolidated_csv(spark, _land(rows.select(line.alias("x")), "csv"), "ofac_consolidated_csv")
    return read.select(F.get_json_object("raw_data", "$.uid").cast("bigint").alias("id"), "last_name", "first_name", "full_name", "entity_type", "program", "nationality", "dob")


@query(f"WITH {ROWS} SELECT id, last_name, first_name, trim(last_name || CASE WHEN last_name <> '' AND first_name <> '' THEN ' ' ELSE '' END || first_name, ' ') full_name, nationality, dob, listed_on FROM r")
def read_un_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    text = F.concat(
        F.lit("<INDIVIDUAL>"), _tag("FIRST_NAME", "last_name"), _tag("SECOND_NAME", "first_name"), F.lit("<NATIONALITY>"), _tag("VALUE", "nationality"), F.lit("</NATIONALITY>"), _tag("LISTED_ON", "listed_on"),
        _tag("REFERENCE_NUMBER", F.col("id").cast("string")), F.lit("<INDIVIDUAL_DATE_OF_BIRTH>"), _tag("DATE", "dob"), F.lit("</INDIVIDUAL_DATE_OF_BIRTH></INDIVIDUAL>"),
    )
    read = lists.un_xml(spark, _land(rows.select(text.alias("x")), "un", "<CONSOLIDATED_LIST><INDIVIDUALS>", "</INDIVIDUALS></CONSOLIDATED_LIST>"))
    return read.select(F.get_json_object("raw_data", "$.un_ref").cast("bigint").alias("id"), "last_name", "first_name", "full_name", "nationality", "dob", "listed_on")


@query(f"WITH {ROWS} SELECT id, coalesce(nullif(last_name, ''), full_name) last_name, first_name, full_name, nationality, dob FROM r WHERE full_name <> ''")
def read_eu_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), _xml(c), F.lit('"'))
    text = F.concat(
        F.lit("<sanctionEntity"), attribute("logicalId", F.col("id").cast("string")), F.lit("><birthdate"), attribute("birthdate", "dob"), F.lit("/><citizenship"), attribute("countryDescription", "nationality"),
        F.lit("/><nameAlias"), attribute("wholeName", "full_name"), attribute("firstName", "first_name"), attribute("lastName", "last_name"), F.lit("/></sanctionEntity>"),
    )
    read = lists.eu_xml(spark, _land(rows.select(text.alias("x")), "eu", "<export>", "</export>"))
    return read.select(F.get_json_object("raw_data", "$.logical_id").cast("bigint").alias("id"), "last_name", "first_name", "full_name", "nationality", "dob")


@query(f"WITH {ROWS}, n AS (SELECT id, full_name, nationality, dob, coalesce(nullif(program, ''), 'UK_SANCTIONS') program, listed_on FROM r WHERE full_name <> '') SELECT id, full_name last_name, full_name, nationality, dob, program, listed_on FROM n")
def read_uk_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat_ws(",", F.lit("1"), F.col("id").cast("string"), *(quoted(c) for c in ("full_name", "nationality", "dob", "program", "listed_on")))
    read = lists.uk_csv(spark, _land(rows.select(line.alias("x")), "uk", "Last Updated,Unique ID,Name 6,Nationality(/ies),D.O.B,Regime Name,Date Designated"))
    return read.select(F.get_json_object("raw_data", "$.uid").cast("bigint").alias("id"), "last_name", "full_name", "nationality", "dob", "program", "listed_on")


@query(f"WITH {ROWS}, w AS (SELECT *, regexp_split_to_array(full_name, '[ \\t\\n\\x0B\\f\\r]+') p FROM r WHERE full_name <> '') SELECT id, p[-1] last_name, p[1] first_name, full_name, nationality, lower(entity_type) entity_type, program FROM w")
def read_search_json(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    one = F.struct(F.col("id").cast("string").alias("id"), F.col("full_name").alias("caption"), F.array("full_name").alias("names"), F.col("entity_type").alias("schema"), F.array("program").alias("datasets"), F.struct(F.array("nationality").alias("nationality")).alias("properties"))
    read = lists.search_json(spark, _land(rows.select(F.concat(F.lit(","), F.to_json(one)).alias("x")), "json", '{"results": [{}', "]}"))
    return read.select(F.get_json_object("raw_data", "$.os_id").cast("bigint").alias("id"), "last_name", "first_name", "full_name", "nationality", "entity_type", "program")


@query(f"WITH {ROWS} SELECT DISTINCT 'https://example.org/files/' || id || '.pdf' url FROM r")
def read_link_index(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    pages = _rows(spark, d).select(F.concat(F.lit('<html><a href="/files/'), "id", F.lit('.pdf">'), _xml("full_name"), F.lit('</a><a href="/files/x.html">other</a></html>')).alias("html"))
    return lists.link_index(pages, "https://example.org").select("url")
