"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamisol.operators import nested, timestamps
from tamisol.session import ship, table

# The repeating paths of the lists' raw records.
RAW_PATHS = (
    "programList.program akaList.aka akaList.aka.nameParts addressList.address addressList.address.lines idList.id idList.id.issues "
    "INDIVIDUAL_ALIAS INDIVIDUAL_ALIAS.NOTE INDIVIDUAL_DOCUMENT DESIGNATION.VALUE LAST_DAY_UPDATED.VALUE entity.nameAlias entity.nameAlias.remarks "
    "entity.citizenship entity.address entity.address.contact entity.address.contact.value names names.parts sanctions_imposed ships ships.owners "
    "ships.owners.periods datasets properties.alias properties.country properties.topics properties.ownership properties.ownership.asset.identifiers "
    "properties.ownership.asset.holders properties.ownership.asset.holders.periods orders orders.annexes orders.annexes.pages"
).split()


def raw_tables(spark: SparkSession, d: str) -> nested.NestedTables:
    ship(spark)
    return nested.NestedTables(table(spark, d, "sanctions"), "id", "raw_data", RAW_PATHS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = raw_tables(spark, d).positions()
    return rows.filter(rows.path.isin(RAW_PATHS)).select(rows.row_key.alias("id"), "path", "ord_path")


def p4_elements(spark: SparkSession, d: str) -> DataFrame:
    return raw_tables(spark, d).elements()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "sanctions"), table(spark, d, "sanctions_alerts"), table(spark, d, "list_conventions"))


def p7_normalised(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised_fields(table(spark, d, "sanctions"), table(spark, d, "sanctions_alerts"), table(spark, d, "list_conventions"))


QUERIES = {"p4_found": p4_found, "p4_elements": p4_elements, "p7_found": p7_found, "p7_normalised": p7_normalised}
