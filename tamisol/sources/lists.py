"""Readers of landed list files: XML, CSV, JSON, HTML and text, each giving entries with the columns of operators.state.ENTRY.

Every reader takes a path of landed bytes and yields a DataFrame; fetching is left to whoever lands the files.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamisol.functions.text import NUMBERED, clean_text, entity_class, family_and_given, is_name_line, name_before_status, valid_entity_name
from tamisol.operators.state import as_entries


def _t(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _named(rows: DataFrame, source: str, authority: str, region: str) -> DataFrame:
    return rows.withColumns({"source": F.lit(source), "authority": F.lit(authority), "region": F.lit(region)})


def keep_first(rows: DataFrame, key: list, order: str) -> DataFrame:
    """The first row of each key by its place in the file."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("__n = 1").drop("__n")


def _main(items: str, value: str) -> Column:
    """The value of the item marked mainEntry, else of the first one."""
    some = F.filter(F.coalesce(F.col(items), F.array()), lambda i: _t(i["mainEntry"]) == "true")
    first = F.coalesce(F.try_element_at(some, F.lit(1)), F.try_element_at(F.col(items), F.lit(1)))
    return _t(first[value])


def sdn_xml(spark: SparkSession, path: str, source: str, authority: str = "US Treasury / OFAC", region: str = "USA") -> DataFrame:
    """Specially designated nationals in XML, in any namespace. The file's date of publication is that of every entry."""
    schema = (
        "uid string, firstName string, lastName string, title string, sdnType string, remarks string, programList struct<program: array<string>>, "
        "dateOfBirthList struct<dateOfBirthItem: array<struct<dateOfBirth: string, mainEntry: string>>>, nationalityList struct<nationality: array<struct<country: string, mainEntry: string>>>"
    )
    xml = lambda tag, s: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(s).load(path)
    published = xml("publshInformation", "Publish_Date string").agg(F.coalesce(F.max(F.trim("Publish_Date")), F.lit("")).alias("listed_on"))
    rows = xml("sdnEntry", schema).withColumns({"__dob": F.col("dateOfBirthList.dateOfBirthItem"), "__nat": F.col("nationalityList.nationality")})
    rows = rows.select(
        _t("sdnType").alias("entity_type"), _t("lastName").alias("last_name"), _t("firstName").alias("first_name"), F.regexp_replace(F.concat(_t("lastName"), F.lit(", "), _t("firstName")), "^[, ]+|[, ]+$", "").alias("full_name"),
        F.array_join(F.transform(F.coalesce("programList.program", F.array()), lambda p: F.trim(p)), ",").alias("program"), _main("__nat", "country").alias("nationality"), _main("__dob", "dateOfBirth").alias("dob"),
        F.to_json(F.struct(_t("uid").alias("uid"), _t("remarks").alias("remarks"), _t("title").alias("title"))).alias("raw_data"),
    )
    return as_entries(_named(rows.join(published), source, authority, region))  # published is one row


def consolidated_csv(spark: SparkSession, path: str, source: str, authority: str = "US Treasury / OFAC", region: str = "USA") -> DataFrame:
    """The consolidated list without a header: twelve columns, date of birth and nationality inside the remarks."""
    cols = ["uid", "name", "type", "program", *(f"x{i}" for i in range(4, 11)), "remarks"]
    rows = spark.read.option("quote", '"').option("escape", '"').schema(", ".join(f"{c} string" for c in cols)).csv(path)
    rows = rows.withColumns({c: _t(c) for c in ("uid", "name", "remarks")}).filter("uid <> '' and name <> ''")
    grab = lambda word: F.trim(F.regexp_extract("remarks", rf"(?i)\b{word}\s+([^;]+?)(?=;|$)", 1))
    comma = F.col("name").contains(",")
    rows = rows.select(
        F.trim(_t("type"), F.lit('"')).alias("entity_type"), F.trim(F.substring_index("name", ",", 1)).alias("last_name"), F.when(comma, F.trim(F.regexp_replace("name", "^[^,]*,", ""))).otherwise("").alias("first_name"), F.col("name").alias("full_name"),
        F.trim(_t("program"), F.lit('"')).alias("program"), F.coalesce(F.nullif(grab("nationality"), F.lit("")), grab("citizen of")).alias("nationality"), grab("DOB").alias("dob"), F.to_json(F.struct("uid", "remarks")).alias("raw_data"),
    )
    return as_entries(_named(rows, source, authority, region))


def un_xml(spark: SparkSession, path: str, source: str = "un_xml", authority: str = "United Nations", region: str = "GLOBAL") -> DataFrame:
    """People and entities of the UN list. Family and given name are the first and second name, as in the list's own order."""
    dob = "INDIVIDUAL_DATE_OF_BIRTH array<struct<DATE: string, DAY: string, MONTH: string, YEAR: string, FROM_YEAR: string, TO_YEAR: string>>"
    xml = lambda tag, s: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(s).load(path)
    people = xml("INDIVIDUAL", f"FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, NATIONALITY struct<VALUE: array<string>>, LISTED_ON string, REFERENCE_NUMBER string, {dob}")
    d = F.try_element_at("INDIVIDUAL_DATE_OF_BIRTH", F.lit(1))
    joined = lambda sep, *c: F.concat_ws(sep, *(F.nullif(_t(x), F.lit("")) for x in c))
    born = F.coalesce(F.nullif(_t(d["DATE"]), F.lit("")), F.nullif(joined(" ", d["DAY"], d["MONTH"], d["YEAR"]), F.lit("")), joined("-", d["FROM_YEAR"], d["TO_YEAR"]))
    ref = F.to_json(F.struct(_t("REFERENCE_NUMBER").alias("un_ref"))).alias("raw_data")
    people = people.select(
        F.lit("individual").alias("entity_type"), _t("FIRST_NAME").alias("last_name"), _t("SECOND_NAME").alias("first_name"), joined(" ", "FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME").alias("full_name"),
        _t(F.try_element_at("NATIONALITY.VALUE", F.lit(1))).alias("nationality"), born.alias("dob"), _t("LISTED_ON").alias("listed_on"), ref,
    )
    entities = xml("ENTITY", "FIRST_NAME string, ENTITY_NAME string, LISTED_ON string, REFERENCE_NUMBER string")
    name = F.coalesce(F.nullif(_t("FIRST_NAME"), F.lit("")), _t("ENTITY_NAME"))
    entities = entities.select(F.lit("entity").alias("entity_type"), name.alias("last_name"), F.lit("").alias("first_name"), name.alias("full_name"), _t("LISTED_ON").alias("listed_on"), ref)
    return as_entries(_named(people.unionByName(entities, allowMissingColumns=True).withColumn("program", F.lit("UN_SANCTIONS")), source, authority, region))


def eu_xml(spark: SparkSession, path: str, source: str = "eu_xml", authority: str = "European Union", region: str = "EUROPE") -> DataFrame:
    """One entry per alias of an entity; the first date of birth and citizenship that aren't empty belong to all of them."""
    schema = (
        "_logicalId string, subjectType array<struct<_code: string>>, regulation array<struct<_programme: string, _numberTitle: string, _publicationDate: string>>, birthdate array<struct<_birthdate: string, _year: string>>, "
        "citizenship array<struct<_countryDescription: string, _countryIso2Code: string>>, nameAlias array<struct<_wholeName: string, _firstName: string, _lastName: string>>"
    )
    rows = spark.read.format("xml").option("rowTag", "sanctionEntity").option("ignoreNamespace", "true").option("attributePrefix", "_").schema(schema).load(path)
    first = lambda items, *keys: F.coalesce(F.try_element_at(F.filter(F.transform(F.coalesce(F.col(items), F.array()), lambda i: F.trim(F.coalesce(*(F.nullif(i[k], F.lit("")) for k in keys), F.lit("")))), lambda v: v != ""), F.lit(1)), F.lit(""))
    reg = F.try_element_at("regulation", F.lit(1))
    rows = rows.select(
        "*", first("birthdate", "_birthdate", "_year").alias("dob"), first("citizenship", "_countryDescription", "_countryIso2Code").alias("nationality"), F.coalesce(F.try_element_at("subjectType", F.lit(1))["_code"], F.lit("unknown")).alias("entity_type"),
        F.coalesce(F.nullif(reg["_programme"], F.lit("")), F.lit("EU_SANCTIONS")).alias("program"), F.coalesce(reg["_publicationDate"], F.lit("")).alias("listed_on"), F.explode("nameAlias").alias("a"),
    )
    rows = rows.withColumns({"first_name": _t("a._firstName"), "__last": _t("a._lastName")})
    rows = rows.withColumn("full_name", F.coalesce(F.nullif(_t("a._wholeName"), F.lit("")), F.trim(F.concat_ws(" ", "first_name", "__last")))).filter("full_name <> ''")
    rows = rows.withColumns({"last_name": F.coalesce(F.nullif(F.col("__last"), F.lit("")), "full_name"), "raw_data": F.to_json(F.struct(F.coalesce(reg["_numberTitle"], F.lit("")).alias("regulation"), F.coalesce("_logicalId", F.lit("")).alias("logical_id")))})
    return as_entries(_named(rows, source, authority, region))


def uk_csv(spark: SparkSession, path: str, source: str = "uk_csv", authority: str = "UK Treasury / OFSI", region: str = "UK") -> DataFrame:
    """The UK list behind its preamble: the header is the line that begins with Last Updated; of rows with one id and name the first counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos")).filter("trim(value) <> ''")
    header = lines.filter(F.lower("value").startswith("last updated")).orderBy("pos").limit(1).collect() or lines.orderBy("pos").limit(1).collect()
    if not header:
        return as_entries(spark.createDataFrame([], "source string"))
    line = header[0].value
    names = [r for r in spark.range(1).select(F.from_csv(F.lit(line), ", ".join(f"c{i} string" for i in range(line.count(",") + 1))).alias("h")).collect()[0].h if r is not None]
    # records, not lines: a quoted field may hold line ends; one file is one task, in the file's order
    records = spark.read.option("multiLine", "true").option("quote", '"').option("escape", '"').schema(", ".join(f"c{i} string" for i in range(len(names)))).csv(path)
    records = records.select(F.monotonically_increasing_id().alias("pos"), F.struct(*records.columns).alias("r"))
    first = records.filter(F.trim("r.c0") == names[0].strip()).agg(F.min("pos").alias("__first"))  # one row
    rows = records.join(first).filter(F.col("pos") > F.col("__first")).drop("__first")
    at = {n.strip(): i for i, n in enumerate(names)}
    get = lambda n: _t(F.col(f"r.c{at[n]}")) if n in at else F.lit("")
    given = F.trim(F.concat_ws(" ", *(get(f"Name {i}") for i in range(1, 6))))  # empty parts keep their blank inside
    rows = rows.withColumns({"first_name": given, "__last": get("Name 6"), "uid": get("Unique ID")}).withColumn("full_name", F.trim(F.concat(F.col("first_name"), F.lit(" "), F.col("__last")))).filter("full_name <> ''")
    rows = keep_first(rows, ["uid", "full_name"], "pos")
    default = lambda c, v: F.coalesce(F.nullif(c, F.lit("")), F.lit(v))
    rows = rows.withColumns({
        "last_name": F.coalesce(F.nullif(F.col("__last"), F.lit("")), "full_name"), "entity_type": default(get("Designation Type"), "unknown"), "program": default(get("Regime Name"), "UK_SANCTIONS"), "nationality": get("Nationality(/ies)"), "dob": get("D.O.B"),
        "listed_on": get("Date Designated"), "raw_data": F.to_json(F.struct("uid", get("OFSI Group ID").alias("ofsi_group_id"), get("UN Reference Number").alias("un_ref"))),
    })
    return as_entries(_named(rows, source, authority, region))


class _Page(HTMLParser):
    """Table rows, text lines and links of a page; navigation and the like is skipped."""

    SKIPPED = frozenset("nav header footer aside script style".split())
    VOID = frozenset("br img hr input meta link area base col embed source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[list[str], int]] = []
        self.lines: list[str] = []
        self.links: list[tuple[str, str]] = []
        self._stack: list[tuple[str, bool, bool]] = []
        self._tables = 0
        self._row: list[list[str]] | None = None
        self._link: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in self.VOID:
            classes = (a.get("class") or "").split()
            if tag == "table" and self._inside("field-content") and not self._inside("table"):
                self._tables += 1
            self._stack.append((tag, tag in self.SKIPPED or bool({"menu", "navbar", "sidebar"} & set(classes)), "field-content" in classes))
        if tag == "tr":
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._row.append([])
        elif tag == "a" and a.get("href"):
            self._link = (a["href"], [])

    def _inside(self, what: str) -> bool:
        return any(c if what == "field-content" else x == what for x, _, c in self._stack)

    def handle_endtag(self, tag):
        while self._stack:
            if self._stack.pop()[0] == tag:
                break
        if tag == "tr" and self._row is not None:
            scope = self._tables if self._inside("field-content") and self._inside("table") else 0
            self.rows.append(([" ".join(" ".join(c).split()) for c in self._row], scope))
            self._row = None
        elif tag == "a" and self._link:
            self.links.append((self._link[0], " ".join(" ".join(self._link[1]).split())))
            self._link = None

    def handle_data(self, data):
        if any(skip for _, skip, _ in self._stack) or not data.strip():
            return
        self.lines += [x.strip() for x in data.split("\n") if x.strip()]
        if self._row:
            self._row[-1].append(data)
        if self._link:
            self._link[1].append(data)


def html_parts(pages: DataFrame) -> DataFrame:
    """(kind, pos, cells, href, scope) of pages (column html): rows of tables, lines of text, links, in the order of each page. Broken pages give what can be read.

    scope: of a row, which table inside an element of the class field-content it is in, counted from 1; 0 outside of these.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for html in f["html"]:
                p = _Page()
                p.feed(html or "")
                p.close()
                out += [("row", i, c, "", s) for i, (c, s) in enumerate(p.rows)] + [("line", i, [t], "", 0) for i, t in enumerate(p.lines)] + [("link", i, [t], h, 0) for i, (h, t) in enumerate(p.links)]
            yield pd.DataFrame(out, columns=["kind", "pos", "cells", "href", "scope"])

    return pages.select("html").mapInPandas(scan, "kind string, pos int, cells array<string>, href string, scope int")


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "html")


def _listed(rows: DataFrame, program: str, raw: dict[str, str], source: str, authority: str, region: str) -> DataFrame:
    """Entries from names (columns full_name and pos): the last word is the family name; of equal names the first counts."""
    family, given = family_and_given(F.col("full_name"))
    rows = keep_first(rows, [F.lower("full_name")], "pos")
    have = set(rows.columns)
    rows = rows.withColumns({"last_name": F.col("last_name") if "last_name" in have else family, "first_name": F.col("first_name") if "first_name" in have else given, "program": F.col("program") if "program" in have else F.lit(program), "nationality": F.col("nationality") if "nationality" in have else F.lit("IN")})
    rows = rows.withColumn("raw_data", F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in raw.items()))))
    return as_entries(_named(rows, source, authority, region))


def banned_organisations_html(spark: SparkSession, path: str, source: str = "mha_uapa", authority: str = "Ministry of Home Affairs", region: str = "INDIA") -> DataFrame:
    """The first table of the page's content, with a serial number and a name, which is the longest cell that isn't a number."""
    cells = F.filter("cells", lambda c: c != "")
    rows = html_parts(_pages(spark, path)).filter("kind = 'row' and scope = 1").withColumn("cells", cells).filter(F.size("cells") >= 2)
    joined = F.lower(F.array_join("cells", " "))
    words = F.filter("cells", lambda c: ~c.rlike(r"^\d+$"))
    longest = F.array_max(F.transform(words, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c"))))["c"]
    rows = rows.filter(~(joined.contains("organisation") & joined.contains("sl"))).select("pos", longest.alias("full_name")).filter(valid_entity_name(F.col("full_name")))
    rows = rows.withColumns({"entity_type": F.lit("organisation"), "last_name": F.col("full_name"), "first_name": F.lit("")})
    return _listed(rows, "UAPA_BANNED", {"source_list": "MHA_UAPA", "uapa_kind": "terrorist_organisation"}, source, authority, region)


def banned_individuals_html(spark: SparkSession, path: str, source: str = "mha_uapa", authority: str = "Ministry of Home Affairs", region: str = "INDIA") -> DataFrame:
    """The same for people: the name is the first cell that isn't a number."""
    rows = html_parts(_pages(spark, path)).filter("kind = 'row' and scope = 1").withColumn("cells", F.filter("cells", lambda c: c != "")).filter(F.size("cells") >= 2)
    name = F.try_element_at(F.filter("cells", lambda c: ~c.rlike(r"^\d+$")), F.lit(1))
    joined = F.lower(F.array_join("cells", " "))
    rows = rows.filter(~(joined.contains("name") & joined.contains("sl"))).select("pos", name.alias("full_name")).filter(valid_entity_name(F.col("full_name"))).withColumn("entity_type", F.lit("individual"))
    return _listed(rows, "UAPA_INDIVIDUAL", {"source_list": "MHA_UAPA", "uapa_kind": "individual"}, source, authority, region)


def numbered_names(lines: DataFrame, line: str = "line", order: str = "pos") -> DataFrame:
    """(pos, full_name, entity_type) of numbered lines that hold a name, without the status behind it."""
    name = clean_text(name_before_status(F.regexp_extract(line, NUMBERED, 1)))
    rows = lines.select(F.col(order).alias("pos"), name.alias("full_name")).filter(F.col("full_name") != "")
    return rows.filter(is_name_line(F.col("full_name")) & valid_entity_name(F.col("full_name"))).withColumn("entity_type", entity_class(F.col("full_name")))


def debarred_html(spark: SparkSession, path: str, source: str = "sebi_debarred", authority: str = "Securities regulator", region: str = "INDIA") -> DataFrame:
    lines = html_parts(_pages(spark, path)).filter("kind = 'line'").select("pos", F.col("cells")[0].alias("line"))
    return _listed(numbered_names(lines), "SEBI_DEBARRED", {"source_list": "SEBI_DEBARRED"}, source, authority, region)


def table_names(rows: DataFrame) -> DataFrame:
    """(pos, full_name, entity_type) from tables that were cut out of an order: (table, pos, cells), the first row of each being its header.

    The name stands in the column whose heading says so, else in the second one; tables of a single row or column give nothing.
    """
    first = rows.groupBy("table").agg(F.min_by("cells", "pos").alias("__head"), F.min("pos").alias("__at"))
    heads = F.transform("__head", lambda h: F.lower(F.coalesce(h, F.lit(""))))
    named = F.array_position(F.transform(heads, lambda h: h.contains("name")), True)
    column = F.when(named > 0, named).when(F.size("__head") >= 2, 2).cast("int")
    name = clean_text(name_before_status(clean_text(F.coalesce(F.try_element_at("cells", F.col("__column")), F.lit("")))))
    found = rows.join(first, "table").withColumn("__column", column).filter((F.col("pos") > F.col("__at")) & F.col("__column").isNotNull()).select("pos", name.alias("full_name"))
    return found.filter(is_name_line(F.col("full_name")) & valid_entity_name(F.col("full_name"))).withColumn("entity_type", entity_class(F.col("full_name")))


def debarred_tables(rows: DataFrame, source: str = "sebi_debarred", authority: str = "Securities regulator", region: str = "INDIA") -> DataFrame:
    """Entries from the tables of an order (table, pos, cells)."""
    return _listed(table_names(rows), "SEBI_DEBARRED", {"source_list": "SEBI_DEBARRED", "extracted_via": "table"}, source, authority, region)


def debarred_text(spark: SparkSession, path: str, source: str = "sebi_debarred", authority: str = "Securities regulator", region: str = "INDIA") -> DataFrame:
    """The same from the text of an order, one line per row; decoding PDF files is outside of this library."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    return _listed(numbered_names(lines), "SEBI_DEBARRED", {"source_list": "SEBI_DEBARRED"}, source, authority, region)


def linked_lists_html(spark: SparkSession, path: str, source: str = "rbi_wilful_defaulter", authority: str = "Ministry of Corporate Affairs", region: str = "INDIA") -> DataFrame:
    """Names that are the text of links to PDF and spreadsheet files."""
    rows = html_parts(_pages(spark, path)).filter("kind = 'link'").filter(F.lower(F.trim("href")).rlike(r"\.(pdf|xlsx)$")).select("pos", F.col("cells")[0].alias("full_name"))
    rows = rows.filter(valid_entity_name(F.col("full_name"))).withColumn("entity_type", entity_class(F.col("full_name")))
    return _listed(rows, "RBI_MCA_DISQUALIFIED", {"source_list": "RBI_MCA_DISQUALIFIED"}, source, authority, region)


def link_index(pages: DataFrame, base: str) -> DataFrame:
    """(pos, url): absolute addresses of the PDF files a page links to, each once, in their order."""
    rows = html_parts(pages).filter("kind = 'link'").filter(F.lower("href").endswith(".pdf"))
    url = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("href", "^/+", "")))
    return keep_first(rows.select("pos", url.alias("url")), ["url"], "pos").orderBy("pos")


_ENTITY = "struct<id: string, caption: string, names: array<string>, schema: string, first_seen: string, datasets: array<string>, properties: struct<nationality: array<string>, country: array<string>, topics: array<string>>>"


def _results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(f"results array<{_ENTITY}>").json(path).select(F.posexplode("results").alias("pos", "r"))


def entities_json(spark: SparkSession, path: str, source: str = "rbi_wilful_defaulter", authority: str = "OpenSanctions", region: str = "INDIA") -> DataFrame:
    """Entities of an API response: people and organisations by schema, nationality before country, topics as programme."""
    some = lambda c: F.try_element_at(c, F.lit(1))
    rows = _results(spark, path).withColumn("full_name", clean_text(F.coalesce("r.caption", F.lit("")))).filter(valid_entity_name(F.col("full_name")))
    topics = F.array_join(F.coalesce("r.properties.topics", F.array()), ",")
    rows = rows.withColumns({
        "entity_type": F.when(F.lower("r.schema") == "person", "individual").otherwise("organisation"), "nationality": F.coalesce(some(F.col("r.properties.nationality")), some(F.col("r.properties.country")), F.lit("IN")),
        "program": F.coalesce(F.nullif(topics, F.lit("")), F.lit("RBI_MCA_DISQUALIFIED")), "listed_on": F.left(F.coalesce("r.first_seen", F.lit("")), F.lit(10)),
    })
    return _listed(rows, "RBI_MCA_DISQUALIFIED", {"source_list": "RBI_MCA_DISQUALIFIED"}, source, authority, region)


def search_json(spark: SparkSession, path: str, source: str = "opensanctions_api", authority: str = "OpenSanctions", region: str = "GLOBAL") -> DataFrame:
    """Results of a search: the first of the names, else the caption; data sets joined as programme."""
    rows = _results(spark, path).withColumn("full_name", _t(F.coalesce(F.try_element_at("r.names", F.lit(1)), "r.caption"))).filter("full_name <> ''")
    words = F.split("full_name", r"\s+")
    rows = rows.withColumns({"last_name": F.element_at(words, -1), "first_name": F.element_at(words, 1), "entity_type": F.lower(F.coalesce("r.schema", F.lit(""))), "program": F.array_join(F.coalesce("r.datasets", F.array()), ","), "nationality": F.coalesce(F.try_element_at("r.properties.nationality", F.lit(1)), F.lit("")), "raw_data": F.to_json(F.struct(F.col("r.id").alias("os_id")))})
    return as_entries(_named(rows, source, authority, region))


READERS = {"ofac_full_xml": sdn_xml, "ofac_delta_xml": sdn_xml, "ofac_consolidated_csv": consolidated_csv, "un_xml": un_xml, "eu_xml": eu_xml, "uk_csv": uk_csv, "opensanctions_api": search_json, "rbi_wilful_defaulter": entities_json, "sebi_debarred": debarred_html, "mha_uapa": banned_organisations_html}


def ingest(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Entries of one source from its landed files, by the source's own reader."""
    reader = READERS[source]
    return reader(spark, path, source)
