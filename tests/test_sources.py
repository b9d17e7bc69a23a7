"""Readers on tiny hand-written files of each format, and streams against batches."""

import json

from pyspark.sql import functions as F

from tamisol.sources import lists
from tamisol.streaming import live

SDN = """<?xml version="1.0"?><sdnList xmlns="http://example.org/x"><publshInformation><Publish_Date>01/02/2025</Publish_Date></publshInformation>
<sdnEntry><uid>7</uid><lastName>BERG</lastName><firstName>Anna</firstName><sdnType>Individual</sdnType><programList><program>A</program><program>B</program></programList>
<nationalityList><nationality><country>X</country><mainEntry>false</mainEntry></nationality><nationality><country>Y</country><mainEntry>true</mainEntry></nationality></nationalityList>
<dateOfBirthList><dateOfBirthItem><dateOfBirth>1960</dateOfBirth><mainEntry>false</mainEntry></dateOfBirthItem></dateOfBirthList></sdnEntry>
<sdnEntry><uid>8</uid><lastName>FIRM LTD</lastName><sdnType>Entity</sdnType></sdnEntry></sdnList>"""
UN = """<CONSOLIDATED_LIST><INDIVIDUALS><INDIVIDUAL><FIRST_NAME>Ali</FIRST_NAME><SECOND_NAME>Bey</SECOND_NAME><FOURTH_NAME>Can</FOURTH_NAME><NATIONALITY><VALUE>TR</VALUE></NATIONALITY><LISTED_ON>2001-01-01</LISTED_ON><REFERENCE_NUMBER>QDi.1</REFERENCE_NUMBER>
<INDIVIDUAL_DATE_OF_BIRTH><YEAR>1970</YEAR><MONTH>May</MONTH></INDIVIDUAL_DATE_OF_BIRTH></INDIVIDUAL><INDIVIDUAL><FIRST_NAME>Zed</FIRST_NAME><INDIVIDUAL_DATE_OF_BIRTH><FROM_YEAR>1960</FROM_YEAR><TO_YEAR>1962</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH></INDIVIDUAL></INDIVIDUALS>
<ENTITIES><ENTITY><ENTITY_NAME>Group X</ENTITY_NAME></ENTITY></ENTITIES></CONSOLIDATED_LIST>"""
EU = """<export xmlns="http://example.org/eu"><sanctionEntity logicalId="5"><subjectType code="person"/><regulation programme="PRG" numberTitle="1/2" publicationDate="2020-01-01"/><birthdate birthdate="" year=""/><birthdate year="1955"/><citizenship countryIso2Code="RU"/>
<nameAlias wholeName="Ivan Petrov" firstName="Ivan" lastName="Petrov"/><nameAlias firstName="Vanya" lastName="Petrov"/><nameAlias wholeName=""/></sanctionEntity></export>"""


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_xml_lists(spark, tmp_path):
    a, b = lists.sdn_xml(spark, put(tmp_path, "sdn.xml", SDN), "ofac_full_xml").orderBy("full_name").collect()
    assert (a.full_name, a.program, a.nationality, a.dob, a.dob_normalized, a.listed_on, a.entity_type) == ("BERG, Anna", "A,B", "Y", "1960", "1960-01-01", "01/02/2025", "Individual") and json.loads(a.raw_data)["uid"] == "7"
    assert (b.full_name, b.first_name, b.nationality, b.dob) == ("FIRM LTD", "", "", "")
    rows = {r.full_name: r for r in lists.un_xml(spark, put(tmp_path, "un.xml", UN)).collect()}
    assert rows["Ali Bey Can"].dob == "May 1970" and rows["Ali Bey Can"].last_name == "Ali" and rows["Zed"].dob == "1960-1962" and rows["Group X"].entity_type == "entity" and rows["Group X"].nationality == ""
    rows = {r.full_name: r for r in lists.eu_xml(spark, put(tmp_path, "eu.xml", EU)).collect()}
    assert set(rows) == {"Ivan Petrov", "Vanya Petrov"} and all(r.dob == "1955" and r.nationality == "RU" and r.program == "PRG" for r in rows.values())


def test_csv_lists(spark, tmp_path):
    text = '7,"BERG, Anna",individual,PRG,-0-,-0-,-0-,-0-,-0-,-0-,-0-,"DOB 1962; POB Shati; nationality Palestinian"\n8,FIRM,,PRG\n,x,,\n9,"A, B",,P,,,,,,,,"citizen of Iran; DOB 5 May 1950"\n'
    rows = {r.full_name: r for r in lists.consolidated_csv(spark, put(tmp_path, "c.csv", text), "ofac_consolidated_csv").collect()}
    assert set(rows) == {"BERG, Anna", "FIRM", "A, B"} and (rows["BERG, Anna"].dob, rows["BERG, Anna"].nationality, rows["BERG, Anna"].first_name) == ("1962", "Palestinian", "Anna") and rows["A, B"].nationality == "Iran" and rows["FIRM"].last_name == "FIRM"
    uk = "Report Date: 1\nLast Updated,Unique ID,Name 6,Name 1,Name 2,Name 3,D.O.B,Nationality(/ies),Regime Name\n1,U1,BERG,Anna,,Lena,01/01/1960,German,R\n2,U1,BERG,Anna,,Lena,,,\n3,U2,,,,,,,\n4,U3,Firm,,,,,,\n"
    rows = lists.uk_csv(spark, put(tmp_path, "uk.csv", uk)).orderBy("full_name").collect()
    assert [(r.full_name, r.dob, r.nationality, r.program) for r in rows] == [("Anna  Lena BERG", "01/01/1960", "German", "R"), ("Firm", "", "", "UK_SANCTIONS")]
    assert lists.uk_csv(spark, put(tmp_path, "none.csv", "")).count() == 0
    torn = 'Last Updated,Unique ID,Name 6,Regime Name\n1,U1,"BERG\nHANSEN, ""X""",R\n2,U2,Firm,"a, b"\n'
    assert [(" ".join(r.full_name.split()), r.program) for r in lists.uk_csv(spark, put(tmp_path, "torn.csv", torn)).orderBy("full_name").collect()] == [('BERG HANSEN, "X"', "R"), ("Firm", "a, b")]


PAGE = """<html><nav><table><tr><td>1</td><td>Menu Home Entry</td></tr></table></nav><div class="field-content"><table><tr><th>Sl No</th><th>Organisation</th></tr><tr><td>1</td><td>Long <b>Organised</b> Front</td></tr><tr><td>2</td><td>long organised front</td></tr><tr><td>3</td><td>Second&nbsp;Army</td><td>x</td></tr><tr><td>4</td></tr></table></div>
<p>1. Some Person Kumar debarred from trading</p><p>2) Acme Projects Ltd.</p><p>no number</p><a href="/files/a.pdf">Alpha Traders Limited</a><a href="http://h/b.PDF">Beta Person Name</a><a href="c.html">Gamma Person</a><a href="/files/a.pdf">again same</a></html>"""


def test_tables_of_orders(spark):
    rows = [("a", 0, ["S.No", "Status", "Name of the person"]), ("a", 1, ["1", "x", "Ravi Kumar Menon debarred from trading"]), ("a", 2, ["2", "x"]), ("b", 0, ["1", "Party"]), ("b", 1, ["2", "Acme Projects Limited"]), ("c", 0, ["Lone Column"]), ("c", 1, ["Nobody Here"])]
    got = lists.debarred_tables(spark.createDataFrame(rows, "table string, pos int, cells array<string>")).collect()
    assert {r.full_name: r.entity_type for r in got} == {"Ravi Kumar Menon": "individual", "Acme Projects Limited": "organisation"}


def test_html_lists(spark, tmp_path):
    path = put(tmp_path, "p.html", PAGE.replace("<p>1.", "<table><tr><td>9</td><td>Outside Army Front</td></tr></table><p>1.", 1))
    assert sorted(r.full_name for r in lists.banned_organisations_html(spark, path).collect()) == ["Long Organised Front", "Second Army"]
    people = lists.banned_individuals_html(spark, path).filter("full_name = 'Second Army'").collect()[0]
    assert (people.first_name, people.last_name, people.entity_type) == ("Second", "Army", "individual")
    rows = {r.full_name: r.entity_type for r in lists.debarred_html(spark, path).collect()}
    assert rows == {"Some Person Kumar": "individual", "Acme Projects Ltd": "organisation"} or rows == {"Some Person Kumar": "individual", "Acme Projects Ltd.": "organisation"}
    assert {r.full_name: r.entity_type for r in lists.linked_lists_html(spark, path).collect()} == {"Alpha Traders Limited": "organisation", "Beta Person Name": "individual", "again same": "individual"}
    pages = spark.createDataFrame([(PAGE,), (None,), ("<td>broken",)], "html string")
    assert [r.url for r in lists.link_index(pages.limit(1), "http://site/").collect()] == ["http://site/files/a.pdf", "http://h/b.PDF"]
    assert lists.html_parts(pages).count() > 0
    text = put(tmp_path, "o.txt", "1. Some Person Kumar\n(2) Some person kumar\nStatus page 3\n")
    assert [r.full_name for r in lists.debarred_text(spark, text).collect()] == ["Some Person Kumar"]


def test_json_lists(spark, tmp_path):
    body = {"results": [{"id": "n1", "caption": " Ravi  Kumar ", "schema": "Person", "first_seen": "2020-05-06T00:00:00", "properties": {"country": ["in"], "topics": ["a", "b"]}}, {"id": "n2", "caption": "ravi kumar", "schema": "Company"}, {"id": "n3", "caption": "x"}, {"id": "n4", "caption": "Big Company", "schema": "Company", "properties": {}}]}
    rows = {r.full_name: r for r in lists.entities_json(spark, put(tmp_path, "e.json", json.dumps(body))).collect()}
    assert set(rows) == {"Ravi Kumar", "Big Company"} and (rows["Ravi Kumar"].program, rows["Ravi Kumar"].nationality, rows["Ravi Kumar"].listed_on, rows["Ravi Kumar"].entity_type) == ("a,b", "in", "2020-05-06", "individual") and rows["Big Company"].nationality == "IN"
    body = {"results": [{"id": "n1", "names": ["Ann B"], "caption": "c", "datasets": ["d", "e"]}, {"id": "n2", "caption": ""}]}
    r = lists.ingest(spark, "opensanctions_api", put(tmp_path, "s.json", json.dumps(body))).collect()
    assert [(x.full_name, x.program, x.first_name, x.last_name) for x in r] == [("Ann B", "d,e", "Ann", "B")]


def test_streamed_review_equals_batch(spark, tmp_path):
    rows = [{"alert_id": f"A{i}", "score": i / 10} for i in range(6)]
    for k in range(3):
        put(tmp_path / "in" if (tmp_path / "in").exists() else (tmp_path / "in").mkdir() or tmp_path / "in", f"{k}.json", "\n".join(json.dumps(r) for r in rows[2 * k : 2 * k + 2]) + "\nbroken\n")
    pipeline = lambda df: df.withColumn("high", F.col("score") > 0.25)
    stream = live.files(spark, str(tmp_path / "in"), "alert_id string, score double", per_trigger=1)
    live.review(stream, pipeline, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r.alert_id, r.high) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r["alert_id"], r["score"] > 0.25) for r in rows)
    # nothing new: nothing is written again
    live.review(stream, pipeline, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_counts_by_minute(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    put(tmp_path / "ev", "1.json", "\n".join(json.dumps({"ts": t, "kind": k}) for t, k in [("2025-01-01T00:00:01", "a"), ("2025-01-01T00:00:59", "a"), ("2025-01-01T00:01:00", "b")]))
    s = live.files(spark, str(tmp_path / "ev"), "ts timestamp, kind string")
    q = live.per_minute(s, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("minutes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("SELECT * FROM minutes").collect()) == [1, 2]
