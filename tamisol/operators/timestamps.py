"""Mixed date and time formats into one unambiguous form.

All formats are compiled into one regex alternation with named groups. ``regexp_replace`` runs it once per value and writes
the groups side by side, so a value is parsed in a single pass inside code generation. Calendar ranges are checked with
integer arithmetic, and instants are assembled from days since the epoch.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month words of the languages in use, lower case without a final dot.
MONTHS = {
    1: "jan january januar jänner janvier enero ene janeiro gennaio janv ocak oca январь января styczeń stycznia",
    2: "feb february februar février fevrier febrero fevereiro febbraio févr fev fév şubat şub февраль февраля luty lutego",
    3: "mar march märz maerz mars marzo março marco mär mrz mart март марта marzec marca",
    4: "apr april avril abril abr aprile avr nisan nis апрель апреля kwiecień kwietnia",
    5: "may mai mayo maio maggio mayıs май мая maj maja",
    6: "jun june juni juin junio junho giugno haziran haz июнь июня czerwiec czerwca",
    7: "jul july juli juillet julio julho luglio juil temmuz tem июль июля lipiec lipca",
    8: "aug august août aout agosto ago ağustos ağu август августа sierpień sierpnia",
    9: "sep sept september septembre septiembre setiembre setembro settembre eylül eyl сентябрь сентября wrzesień września",
    10: "oct october oktober octobre octubre outubro ottobre okt ekim eki октябрь октября październik października",
    11: "nov november novembre noviembre novembro kasım kas ноябрь ноября listopad listopada",
    12: "dec december dezember décembre decembre diciembre dezembro dicembre dez dic déc aralık ara декабрь декабря grudzień grudnia",
}

# Minutes east of UTC of zone abbreviations, by zone where an abbreviation has several meanings.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "CET": 60, "CEST": 120, "BST": 60, "WEST": 60, "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "IST": 330, "PKT": 300}
BY_ZONE = {("Europe/Dublin", "IST"): 60, ("Asia/Jerusalem", "IST"): 120, ("Asia/Shanghai", "CST"): 480, ("Asia/Dhaka", "BST"): 360}

_SEP = "\u0001"
_QUALIFIER = r"(?:circa|ca\.?|c\.?|approx\.?|approximately|about|around|est\.?|born|year|yob:?|~)"
_DATES = [
    r"(?<aY>\d{4})[-/.](?<aM>\d{1,2})[-/.](?<aD>\d{1,2})",
    r"(?<bY>\d{4})(?<bM>\d{2})(?<bD>\d{2})",
    r"(?<cA>\d{1,2})[-/.](?<cB>\d{1,2})[-/.](?<cY>\d{4})",
    r"(?<dD>\d{1,2})(?:\.|st|nd|rd|th)?[\s-]*(?:de\s+)?(?<dW>\p{L}{3,12})\.?,?[\s-]*(?:del?\s+)?(?<dY>\d{4})",
    r"(?<eW>\p{L}{3,12})\.?\s*(?<eD>\d{1,2})(?:st|nd|rd|th)?,?\s+(?<eY>\d{4})",
    r"(?<fY>\d{4})[-/](?<fM>\d{1,2})",
    r"(?<mM>\d{1,2})[-/](?<mY>\d{4})",
    r"(?:" + _QUALIFIER + r"\s*)*(?<gY>\d{4})s?",
    r"(?:" + _QUALIFIER + r"\s*)?(?<hW>\p{L}{3,12})\.?,?\s+(?:de\s+)?(?<hY>\d{4})",
    r"(?:between|from)?\s*(?<iY>\d{4})\s*(?:to|and|or|-|–|/)\s*\d{4}",
    r"[dDxX?_*-]{1,2}[-/.][mMxX?_*-]{1,2}[-/.](?<jY>\d{4})",
    r"(?<kY>\d{4})[-/.][mMxX?_*-]{1,2}[-/.][dDxX?_*-]{1,2}",
]
_TIME = (
    r"(?:(?:T|,?\s+)(?:(?<tH>\d{1,2}):(?<tI>\d{2})(?::(?<tS>\d{2})(?:[.,]\d+)?)?|(?<uH>\d{2})(?<uI>\d{2})(?<uS>\d{2})?(?:\.\d+)?)"
    r"\s*(?<tP>[AaPp]\.?[Mm]\.?)?\s*(?<tZ>[A-Za-z]{1,5}|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?"
)
#: One alternation for every format; at most one branch takes part in a match, so groups of the same role can be written side by side.
PATTERN = rf"(?i)^\s*(?:(?:(?:mon|tue|wed|thu|fri|sat|sun)\p{{L}}*,?\s+)?(?:{'|'.join(_DATES)}){_TIME}|(?<nS>\d{{9,10}})(?<nF>\d{{3}})?)\s*$"
_PARTS = {
    "y": "aY bY cY dY eY fY mY gY hY iY jY kY", "m": "aM bM fM mM", "w": "dW eW hW", "d": "aD bD dD eD", "a": "cA", "b": "cB",
    "h": "tH uH", "i": "tI uI", "s": "tS uS", "p": "tP", "z": "tZ", "n": "nS",
}
_REPLACEMENT = _SEP + _SEP.join("".join(f"${{{g}}}" for g in groups.split()) for groups in _PARTS.values())


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("long").cast("string"), n, "0")


def _map(pairs: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def normalise(df: DataFrame, value: str, instant: str, order: str, zone: str, out: str = "value_norm") -> DataFrame:
    """Append ``out``: the unambiguous form of the text column ``value``, or null where it names no day.

    ``instant``: boolean column; true: a time of day is kept and the result is UTC ``yyyy-MM-ddTHH:mm:ssZ``, false: the day as
    written. ``order``: DMY or MDY for numeric dates (null: DMY); ``zone``: zone of values without one (null: UTC).
    Defined cases: null, empty, placeholder and impossible values and words that are no month give null, whatever their length; a month or day that isn't given is 01; of several years the
    first; of an hour that occurs twice the first; a missing local time moves ahead by the gap. Other columns stay as they are;
    working columns are named ``__ts_*`` and removed again.
    """
    roles = list(_PARTS)
    # runs of blanks in long values are cut short, so that the pattern never tries many ways to divide them
    text = F.when(F.length(value) <= 80, F.col(value)).otherwise(F.regexp_replace(value, r"\s+", " "))
    p = F.col("__ts_parts")
    df = df.withColumn("__ts_parts", F.split(F.regexp_replace(text, PATTERN, _REPLACEMENT), _SEP))
    df = df.withColumn("__ts_parts", F.when((F.size("__ts_parts") == len(roles) + 1) & (F.element_at(p, 1) == ""), p))
    part = {k: F.nullif(F.element_at(p, i + 2), F.lit("")) for i, k in enumerate(roles)}
    df = df.withColumns({f"__ts_{k}": part[k] if k in "wpz" else part[k].cast("long" if k == "n" else "int") for k in roles}).drop("__ts_parts")
    c = {k: F.col(f"__ts_{k}") for k in roles}
    months = _map({w: n for n, words in MONTHS.items() for w in words.split()})
    mdy = F.coalesce(F.upper(order) == "MDY", F.lit(False))
    month = F.coalesce(c["m"], F.try_element_at(months, F.lower(c["w"])), F.when(mdy, c["a"]).otherwise(c["b"]), F.when(c["w"].isNull(), 0))
    day = F.coalesce(c["d"], F.when(mdy, c["b"]).otherwise(c["a"]), F.lit(0))
    half, zoned = F.upper(F.substring(c["p"], 1, 1)), F.upper(c["z"])
    hour = F.when(half.isNull(), c["h"]).when(c["h"].between(1, 12), c["h"] % 12 + F.when(half == "P", 12).otherwise(0)).otherwise(99)
    signed = F.regexp_replace(zoned, ":", "")
    minutes = F.substring(signed, 2, 2).cast("int") * 60 + F.coalesce(F.nullif(F.substring(signed, 4, 2), F.lit("")).cast("int"), F.lit(0))
    by_zone = _map({f"{a} {b}": v for (a, b), v in BY_ZONE.items()})
    named = F.coalesce(F.try_element_at(by_zone, F.concat_ws(" ", F.col(zone), zoned)), F.try_element_at(_map(ABBREVIATIONS), zoned))
    offset = F.when(zoned.rlike(r"^[+-]"), F.when(zoned.startswith("-"), -minutes).otherwise(minutes)).otherwise(named)
    df = df.withColumns({"__ts_mm": F.when(month.isNotNull(), F.greatest(month, F.lit(1))), "__ts_dd": F.greatest(day, F.lit(1)), "__ts_hh": hour, "__ts_ss": F.coalesce(c["s"], F.lit(0)), "__ts_off": offset})
    y, m, d, h, off = (F.col(f"__ts_{k}") for k in ("y", "mm", "dd", "hh", "off"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    clock = c["h"].isNull() | (h.between(0, 23) & c["i"].between(0, 59) & F.col("__ts_ss").between(0, 60))
    valid = F.coalesce(y.between(1, 9999) & m.between(1, 12) & (d <= last) & clock & (c["z"].isNull() | off.between(-1080, 1080)), F.lit(False))
    # A filter on the result, pushed down through these projections, would copy every expression into every use of it; the optimizer
    # pushes none below a column that isn't deterministic.
    df = df.withColumns({"__ts_ok": valid, "__ts_day": days_from_civil(y, m, d), "__ts_bar": F.rand(0)})
    df = df.withColumn("__ts_local", F.when(F.col("__ts_ok"), F.col("__ts_day") * 86400 + h.cast("long") * 3600 + c["i"] * 60 + F.col("__ts_ss")))
    local = F.col("__ts_local")
    # Spark's conversion takes the earlier offset of an overlap and moves a gap ahead by its length.
    placed = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), F.coalesce(F.col(zone), F.lit("UTC"))))
    df = df.withColumn("__ts_u", F.when(F.col(instant), F.coalesce(c["n"], F.when(off.isNotNull(), local - off * 60).otherwise(placed))))
    u, sod = F.col("__ts_u"), F.pmod(F.col("__ts_u"), F.lit(86400))
    stamp = F.concat(F.date_from_unix_date(F.floor(u / 86400).cast("int")).cast("string"), F.lit("T"), _pad(F.floor(sod / 3600), 2), F.lit(":"), _pad(F.floor(sod / 60) % 60, 2), F.lit(":"), _pad(sod % 60, 2), F.lit("Z"))
    written = F.date_from_unix_date(F.col("__ts_day").cast("int")).cast("string")
    df = df.withColumn(out, F.when(F.col("__ts_bar") < 0, None).when(u.isNotNull(), stamp).when(F.col("__ts_ok"), written))
    return df.drop(*[f"__ts_{k}" for k in [*roles, "mm", "dd", "hh", "ss", "off", "ok", "day", "local", "u", "bar"]])


def with_conventions(df: DataFrame, conventions: DataFrame, source: str) -> DataFrame:
    """Append ``__zone`` and ``__order`` of the list named in ``source``; lists without a row get null (UTC, DMY)."""
    rules = conventions.groupBy(F.col("source").alias("__rule")).agg(F.min("time_zone").alias("__zone"), F.min("day_order").alias("__order"))
    return df.join(rules, F.col(source) == F.col("__rule"), "left").drop("__rule")


def normalised_fields(sanctions: DataFrame, alerts: DataFrame, conventions: DataFrame) -> DataFrame:
    """(table_name, row_key, field, value, value_norm) of every date field of the lists and the alerts; distinct rows."""
    lists = sanctions.select(
        F.col("source").alias("__source"), F.lit("sanctions").alias("table_name"), F.col("id").cast("string").alias("row_key"),
        F.explode(F.array(F.struct(F.lit("dob").alias("field"), F.col("dob").alias("value")), F.struct(F.lit("listed_on").alias("field"), F.col("listed_on").alias("value")))).alias("f"),
    ).select("__source", "table_name", "row_key", "f.field", "f.value")
    typed = alerts.select(F.col("source_list").alias("__source"), F.lit("sanctions_alerts").alias("table_name"), F.col("alert_id").alias("row_key"), F.lit("dob").alias("field"), F.col("dob").alias("value")).distinct()
    rows = lists.unionByName(typed).filter(F.trim("value") != "")
    rows = with_conventions(rows, conventions, "__source").withColumn("__instant", F.col("field") == "listed_on")
    return normalise(rows, "value", "__instant", "__order", "__zone").select("table_name", "row_key", "field", "value", "value_norm")


def found(sanctions: DataFrame, alerts: DataFrame, conventions: DataFrame) -> DataFrame:
    """The values that name a day or instant and are not already in normal form."""
    rows = normalised_fields(sanctions, alerts, conventions)
    return rows.filter(F.col("value_norm") != F.col("value")).select("table_name", "row_key", "field", "value_norm").distinct()
