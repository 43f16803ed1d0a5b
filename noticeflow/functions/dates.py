"""Dates of notices: several written forms, tried in a fixed order, and two looser searches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import strip

# The written forms in the order in which they are tried; the first one follows a weekday.
WEEKDAY_FORM = "d MMMM yyyy"
FORMS = ("M/d/yyyy", "MMMM d, yyyy", "yyyy-M-d", "d MMMM yyyy", "MMMM d yyyy", "M-d-yyyy", "d-M-yyyy")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMERIC = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})"
SPELLED = r"(?U)(\w+)\s+([0-9]{1,2})[,]?\s+([0-9]{4})"

_WEEKDAY = r"(?i)^(?:mon|tues|wednes|thurs|fri|satur|sun)day,\s*"
#: Patterns of the date parser take further digits than the written forms allow, so each text is gated by its shape.
_SHAPE = (
    r"^(?:[0-9]{1,2}([/-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"|[A-Za-z]+ [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} [A-Za-z]+ [0-9]{4})$"
)
#: The shape of a written form by its parts: a text that the date parser refuses costs an exception, so it gets only those that can be right.
_PARTS = {"M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "yyyy": "[0-9]{4}", "MMMM": "[A-Za-z]+"}


def _shape(form: str) -> str:
    """The pattern of the texts that a form of FORMS can fit."""
    return "^" + re.sub("[A-Za-z]+", lambda m: _PARTS[m[0]], form) + "$"


def _spaced(c: Column) -> Column:
    """White space runs as one space, and none after a slash or dash before a digit."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", " "), r"([/-]) ([0-9])", "$1$2")


def _as_date(c: Column, form: str) -> Column:
    return F.try_to_timestamp(c, F.lit(form)).cast("date")


def _of_form(c: Column, form: str) -> Column:
    return F.when(c.rlike(_shape(form)), _as_date(c, form))


def _of_parts(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(year, month, day, zero, zero, F.lit(0).cast("decimal(16,6)")).cast("date")


def one_form(c: Column, form: str = "MMMM d, yyyy") -> Column:
    """The date of a text in exactly one written form, else null."""
    t = _spaced(c)
    return F.when(t.rlike(_SHAPE), _as_date(t, form))


def parse_date(c: Column) -> Column:
    """The date of a text, or null.

    First the whole text in one of the written forms; then the first numeric date anywhere in it, read as month, day,
    year, with two-digit years in the 2000s; then the first ``month day year`` with a full English month name or a number.
    """
    t = _spaced(c)
    after_weekday = F.regexp_replace(t, _WEEKDAY, "")
    strict = F.coalesce(
        F.when(t.rlike(_WEEKDAY), _of_form(after_weekday, WEEKDAY_FORM)),
        *[_of_form(t, f) for f in FORMS],
    )
    raw = strip(c)
    part = lambda pattern, k: F.regexp_extract(raw, pattern, k)
    year = part(NUMERIC, 3).try_cast("int")
    numeric = _of_parts(F.when(year < 100, year + 2000).otherwise(year), part(NUMERIC, 1).try_cast("int"), part(NUMERIC, 2).try_cast("int"))
    word = F.lower(part(SPELLED, 1))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word).cast("int")
    month = F.when(word.rlike("^[0-9]+$"), word.try_cast("int")).otherwise(F.when(named > 0, named))
    spelled = _of_parts(part(SPELLED, 3).try_cast("int"), month, part(SPELLED, 2).try_cast("int"))
    return F.coalesce(strict, numeric, spelled)


def numeric_date_text(c: Column) -> Column:
    """The first numeric date in a text, as it is written there, else null."""
    found = F.regexp_extract(c, rf"(?U)\b{NUMERIC}\b", 0)
    return F.when(found != "", found)


def quarter_label(ts: Column) -> Column:
    """``2025_Q2``."""
    return F.concat(F.year(ts).cast("string"), F.lit("_Q"), F.quarter(ts).cast("string"))


def snapshot_label(ts: Column, daily: bool = False) -> Column:
    """A label whose order as text is the order in time."""
    return F.date_format(ts, "yyyy-MM-dd" if daily else "yyyy-MM-dd_HH-mm")
