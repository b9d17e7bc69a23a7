"""Nested records and mixed timestamps: fixtures with known results and the defined edge cases."""

import json

from tamisol.operators import nested, timestamps

CONV = [("us", "America/New_York", "MDY"), ("eu", "Europe/Brussels", "DMY"), ("in", "Asia/Kolkata", "DMY")]


def norm(spark, rows):
    df = spark.createDataFrame([(i, s, v, f == "listed_on") for i, (s, v, f) in enumerate(rows)], "k long, source string, v string, inst boolean")
    df = timestamps.with_conventions(df, spark.createDataFrame(CONV, "source string, time_zone string, day_order string"), "source")
    out = timestamps.normalise(df, "v", "inst", "__order", "__zone").select("k", "value_norm").collect()
    return [v for _, v in sorted((r.k, r.value_norm) for r in out)]


def test_days(spark):
    cases = {
        "10 Dec 1948": "1948-12-10", "28 Apr 1937": "1937-04-28", "1937-04-28": "1937-04-28", "25/01/2001": "2001-01-25", "1962": "1962-01-01",
        "circa 1950": "1950-01-01", "dd/mm/1958": "1958-01-01", "": None, "N/A": None, "-0-": None, "0000-00-00": None, "1952-02-31": None,
        "29/02/1999": None, "29/02/2000": "2000-02-29", "18 de marzo de 1965": "1965-03-18", "11. Juni 1996": "1996-06-11", "9 août 1990": "1990-08-09",
        "between 1963 and 1965": "1963-01-01", "1946-1948": "1946-01-01", "1964 to 1966": "1964-01-01", "1954-05": "1954-05-01", "June 1975": "1975-06-01",
        " 1949-02-05 ": "1949-02-05", "1977-12-22T00:00:00+03:00": "1977-12-22", "26-FEB-1976": "1976-02-26", "Feb 22, 1938": "1938-02-22", "00/00/1968": "1968-01-01",
        "19760717": "1976-07-17", "x" * 500_000: None, "31 Jun 1982": None, "1 Jan 1980" + " " * 80: "1980-01-01", " " * 50_000 + "1 Jan" + " " * 50_000 + "1980": "1980-01-01",
        "15 августа 1970": "1970-08-15", "15 Ağustos 1970": "1970-08-15", "20 foobar 1999": None, "foobar 1999": None, "foobar 20, 1999": None,
    }
    assert norm(spark, [("eu", v, "dob") for v in cases]) == list(cases.values())
    assert norm(spark, [("us", "05/10/1950", "dob"), ("eu", "05/10/1950", "dob"), (None, "05/10/1950", "dob"), ("eu", None, "dob")]) == ["1950-05-10", "1950-10-05", "1950-10-05", None]


def test_instants_and_daylight_saving(spark):
    cases = [
        ("eu", "2021-03-28T02:42:39.831", "2021-03-28T01:42:39Z"),  # missing hour: ahead by the gap
        ("eu", "2023-10-29T02:47:52.860810", "2023-10-29T00:47:52Z"),  # doubled hour: the first
        ("us", "2021-11-07 01:30:00", "2021-11-07T05:30:00Z"),
        ("us", "2021-03-14 02:30:00", "2021-03-14T07:30:00Z"),
        ("in", "2011-06-04 03:50:37 IST", "2011-06-03T22:20:37Z"),
        ("us", "2019-12-23 12:21:02 EST", "2019-12-23T17:21:02Z"),
        ("eu", "1683693097", "2023-05-10T04:31:37Z"),
        ("eu", "1347288371333", "2012-09-10T14:46:11Z"),
        ("eu", "20100621T124530Z", "2010-06-21T12:45:30Z"),
        ("eu", "Mon, 15 Dec 2008 06:19:20 GMT", "2008-12-15T06:19:20Z"),
        ("us", "Oct 25, 2020 12:39 AM", "2020-10-25T04:39:00Z"),
        ("us", "Oct 25, 2020 13:39 AM", None),
        ("eu", "2019-03-12T00:34:59-0400", "2019-03-12T04:34:59Z"),
        ("eu", "08/09/2014", "2014-09-08"),
        (None, "2014-09-08 10:00:00", "2014-09-08T10:00:00Z"),
        ("eu", "2014-09-08 25:00:00", None),
        ("eu", "TBC", None),
    ]
    assert norm(spark, [(s, v, "listed_on") for s, v, _ in cases]) == [x for _, _, x in cases]


def test_found_skips_normal_forms_and_repeats(spark):
    lists = spark.createDataFrame([(1, "eu", "1990-01-02", "2020-01-01"), (2, "eu", "2 Jan 1990", None)], "id long, source string, dob string, listed_on string")
    alerts = spark.createDataFrame([("A", "us", "01/02/1990"), ("A", "us", "01/02/1990"), ("B", None, None)], "alert_id string, source_list string, dob string")
    conv = spark.createDataFrame(CONV, "source string, time_zone string, day_order string")
    got = sorted(tuple(r) for r in timestamps.found(lists, alerts, conv).collect())
    assert got == [("sanctions", "2", "dob", "1990-01-02"), ("sanctions_alerts", "A", "dob", "1990-01-02")]
    assert timestamps.found(lists.limit(0), alerts.limit(0), conv.limit(0)).count() == 0


def brute(value, path="", up=""):
    """All elements below arrays, by plain recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}" if path else k, up)
    elif isinstance(value, list):
        for n, x in enumerate(value, 1):
            if x is not None:
                at = f"{up}.{n}" if up else str(n)
                yield path, at
                yield from brute(x, path, at) if isinstance(x, dict) else ()


def test_nested_matches_brute_force(spark):
    records = [
        {"a": {"b": [{"c": [1, 2], "t": "x"}, {"c": []}]}, "z": 1},
        {"a": {"b": [{"c": [3], "d": [{"e": [True, None, "s"]}]}]}},
        {"a": None},
        {"a": {"b": []}},
    ]
    texts = [json.dumps(r) for r in records] + [json.dumps(json.dumps(records[0])), '{"a": {"b": [', "", None, "[1", "NaN"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, raw string, path string")
    got = sorted((r.row_key, r.path, r.ord_path) for r in nested.NestedTables(df, "id", "raw").elements().collect())
    want = sorted((i, *e) for i, r in enumerate([*records, records[0]]) for e in brute(r))
    assert got == want


def test_single_value_of_a_repeating_path_and_links(spark):
    texts = ['{"o": [{"p": "q"}, {"p": ["r", "s"]}]}', '{"o": {"p": "t", "value": 1}}', '{"o": null}']
    t = nested.NestedTables(spark.createDataFrame(list(enumerate(texts)), "id long, raw string"), "id", "raw")
    rows = t.elements().collect()
    assert sorted((r.row_key, r.path, r.ord_path, r.parent_path, r.parent_ord) for r in rows) == [
        (0, "o", "1", "", ""), (0, "o", "2", "", ""), (0, "o.p", "1.1", "o", "1"), (0, "o.p", "2.1", "o", "2"), (0, "o.p", "2.2", "o", "2"), (1, "o", "1", "", ""), (1, "o.p", "1.1", "o", "1"),
    ]
    keys = {r.node_key for r in rows}
    assert len(keys) == len(rows) and all(r.parent_key in keys for r in rows if r.parent_path)
    assert sorted(r.value for r in t.table("o.p").collect()) == ["q", "r", "s", "t"]
    assert sorted(str(r.field_value) for r in t.table("o").collect()) == ["1", "None", "None"]


def test_tables_hold_everything(spark):
    records = [
        {"id": 7, "name": {"first": "A", "last": "B"}, "addresses": [{"city": "X", "geo": {"lat": 1, "lon": 2.5}, "lines": ["p", "q"]}, {"city": "Y", "geo": {"lat": 2.5}}], "big": 2**70},
        {"id": 8, "name": {"first": "C"}, "active": True, "addresses": []},
    ]
    texts = [json.dumps(r) for r in records]
    wrapped = texts[0]
    for _ in range(7):
        wrapped = json.dumps(wrapped)
    df = spark.createDataFrame(list(enumerate([*texts, wrapped])), "id long, raw string")
    t = nested.NestedTables(df, "id", "raw")
    root, places, lines = (t.table(p) for p in ("", "addresses", "addresses.lines"))
    assert dict(root.dtypes) == {"row_key": "bigint", "node_key": "bigint", "id": "bigint", "name.first": "string", "name.last": "string", "active": "boolean", "big": "string"}
    assert dict(places.dtypes)["geo.lat"] == dict(places.dtypes)["geo.lon"] == "double"
    # the records can be built again from the tables
    built = {}
    for r in root.collect():
        name = {k: r[f"name.{k}"] for k in ("first", "last") if r[f"name.{k}"] is not None}
        built[r.node_key] = {"id": r.id, "name": name, "addresses": []} | ({"active": r.active} if r.active is not None else {}) | ({"big": int(r.big)} if r.big else {})
    inner = {}
    for r in sorted(places.collect(), key=lambda r: (r.row_key, r.ordinal)):
        inner[r.node_key] = {"city": r.city, "geo": {k: r[f"geo.{k}"] for k in ("lat", "lon") if r[f"geo.{k}"] is not None}}
        built[r.parent_key]["addresses"].append(inner[r.node_key])
    for r in sorted(lines.collect(), key=lambda r: (r.row_key, r.ord_path)):
        inner[r.parent_key].setdefault("lines", []).append(r.value)
    keys = [r.node_key for r in root.orderBy("row_key").collect()]
    assert [built[k] for k in keys] == [*records, records[0]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, raw string")
    assert nested.NestedTables(df, "id", "raw", ["a.b"]).elements().count() == 0
