"""Scalar functions on names and free text, as column expressions wherever built-ins can say it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Page furniture that no entity name contains.
PAGE_TOKENS = (
    "skip to main content", "skip to content", "home", "menu", "search", "login", "logout", "register", "sign in", "sign up", "navigation", "breadcrumb", "footer", "header", "sidebar", "click here", "read more", "view all", "back to top",
    "press release", "annual report", "sitemap", "feedback", "privacy policy", "terms of use", "accessibility", "screen reader", "select your language", "government of india", "ministry of home affairs", "national portal",
)
# Words by which organisations are known.
CORPORATE = (
    r"(?i)\b(ltd|limited|llp|llc|inc|incorporated|corp|corporation|pvt|private|company|co\.|services|finance|capital|securities|investments?|enterprises?|industries|holdings|group|brokers?|stock|trading|consultancy|advisors?|fund|"
    r"foundation|trust|society|association|institute|technologies|agencies|media|infotech|infrastructure|projects|developers?|realtors?|properties|exports?|imports?|chits?|cooperative)\b"
)
# What lines of an order hold that aren't names; short lines with a date; heads of addresses; status verbs after a name; numbered lines.
ORDER_TOKENS = (
    "sebi", "securities and exchange board", "order", "vide", "regulation", "market", "ground floor", "stock exchange", "registration", "circular", "annexure", "show cause", "interim", "final", "act,", "rule", "section", "prohibition", "prohibited",
    "manipulati", "fraud", "adjudicating", "whole time", "wtm", "chairman", "no.", "page", "issued", "received", "dated", "in re", "in the matter of", "respondent", "name of the entity", "name of entity", "name of company", "status as on", "sl no",
    "sl. no", "serial no", "list of", "statement of",
)
DATED = r"(?i)\b(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}|\d{4}-\d{2}-\d{2})\b"
ADDRESS_HEAD = r"^\d{1,6}[/\-,]\s*\w"
STATUS = r"(?i)\b(did\s+not|failed\s+to|has\s+not|has\s+been|debarred|prohibited|banned|restrained|vide\s+order|status\s*[:\-]|wind\s+up|applied\s+for|filed\s+for|registration\s+(?:granted|denied))\b"
NUMBERED = r"^\s*(?:\(?\d{1,3}[\.\)]|\d{1,3}\.\d{1,3}\.?)\s+(.{4,180}?)\s*$"


def falsy(*columns: Column | str) -> Column:
    """The first text that is neither null nor empty; '' if there is none."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns), F.lit(""))


def safe_float(c: Column | str) -> Column:
    """Text as a number; 0.0 where it is none. NaN and infinities count as unreadable."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def falsy_number(first: Column | str, second: Column | str) -> Column:
    """The first number unless it is missing, unreadable or zero, else the second one, else 0."""
    return F.coalesce(F.nullif(safe_float(first), F.lit(0.0)), safe_float(second))


def clean_text(c: Column | str) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    """Non-empty words divided by white space; an empty array for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def word_count(c: Column | str) -> Column:
    return F.size(tokens(c))


def valid_entity_name(c: Column) -> Column:
    """5 to 250 characters once trimmed, not only digits, no address, no page furniture, at least one Latin or Devanagari letter. False for null."""
    n = F.trim(c)
    good = F.length(n).between(5, 250) & ~n.rlike(r"^\d+$") & ~n.rlike(r"(?i)^(https?://|www\.)") & n.rlike(r"[A-Za-zऀ-ॿ]")
    return F.coalesce(good & ~_holds_any(F.lower(n), PAGE_TOKENS), F.lit(False))


def _holds_any(low: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: low.contains(p))


def entity_class(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).rlike(CORPORATE), "organisation").otherwise("individual")


def name_before_status(c: Column) -> Column:
    """A listed name without the status that follows it on the same line."""
    cut = F.regexp_replace(F.regexp_replace(c, f"{STATUS}(?s:.*)$", ""), r"[ ,.;:-]+$", "")
    return F.coalesce(F.when(c.rlike(STATUS), cut).otherwise(F.trim(c)), F.lit(""))


def is_name_line(c: Column) -> Column:
    """Whether a line of an order can be a name: not bracketed, no order word, no address head, half letters at least, no short line with a date."""
    s = F.trim(c)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    good = (F.length(s) > 0) & ~(s.startswith("(") & s.endswith(")")) & ~_holds_any(F.lower(s), ORDER_TOKENS) & ~s.rlike(ADDRESS_HEAD) & (letters * 2 >= F.length(s)) & ~(s.rlike(DATED) & (F.length(s) < 60))
    return F.coalesce(good, F.lit(False))


def family_and_given(full: Column) -> tuple[Column, Column]:
    """(family, given) of ``LAST, First Middle`` or ``First Middle Last``; a single word is the family name."""
    words = tokens(full)
    comma = full.contains(",")
    family = F.when(comma, F.trim(F.substring_index(full, ",", 1))).otherwise(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    rest = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return family, F.when(comma, F.trim(F.regexp_replace(full, r"^[^,]*,", ""))).otherwise(rest)


def safe_year(c: Column, default: int) -> Column:
    """The first number between 1901 and 2099 among a date's parts, else ``default``."""
    years = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[^0-9]+"), lambda p: p.try_cast("int")), lambda n: (n > 1900) & (n < 2100))
    return F.coalesce(F.try_element_at(years, F.lit(1)), F.lit(default))


_MONTHS = {m: n for n, words in enumerate("january jan|february feb|march mar|april apr|may|june jun|july jul|august aug|september sep sept|october oct|november nov|december dec".split("|"), 1) for m in words.split()}


def simple_dob(c: Column) -> Column:
    """The date-of-birth rule of the screening index: ISO, then day/month/year, then a walk over words and numbers (last month word, first year
    from 1900 to 2100, first number up to 31). A year alone gives its first of January; nothing gives ''. Days aren't checked against the calendar."""
    s = F.trim(F.coalesce(c, F.lit("")))
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    part = lambda p, i: F.regexp_extract(s, p, i).try_cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    made = lambda y, m, d: F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), two(m), two(d)))
    words = F.regexp_extract_all(F.lower(s), F.lit(r"([a-z]+|\d+)"))
    months = F.create_map(*(x for m, n in _MONTHS.items() for x in (F.lit(m), F.lit(n))))
    month = F.try_element_at(F.filter(F.transform(words, lambda w: F.try_element_at(months, w)), lambda m: m.isNotNull()), F.lit(-1))
    numbers = F.filter(F.transform(words, lambda w: w.try_cast("int")), lambda n: n.isNotNull())
    year = F.try_element_at(F.filter(numbers, lambda n: n.between(1900, 2100)), F.lit(1))
    day = F.try_element_at(F.filter(numbers, lambda n: n.between(1, 31)), F.lit(1))
    walked = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), made(year, month, day)).when(year.isNotNull() & month.isNotNull(), F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-01"))).when(year.isNotNull(), F.concat(year.cast("string"), F.lit("-01-01")))
    return F.coalesce(made(part(iso, 1), part(iso, 2), part(iso, 3)), made(part(dmy, 3), part(dmy, 2), part(dmy, 1)), walked, F.lit(""))


def fold(text: str | None) -> str:
    """Compatibility-decomposed, without accents, lower case, everything but letters, digits and _ as one blank."""
    if not text:
        return ""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in t).split())


def _normalise(names: pd.Series) -> pd.Series:
    return names.map(fold)


#: ``fold`` for a column; decomposition isn't a built-in, so it is one Arrow stage, meant for distinct names.
normalise = F.pandas_udf(_normalise, StringType())


def low(c: Column | str) -> Column:
    """Lower case, with the dotted capital I as a plain i instead of an i and a separate dot."""
    return F.lower(F.translate(c, "İ", "i"))
