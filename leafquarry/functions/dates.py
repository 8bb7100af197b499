"""Dates in Spanish texts as Column functions (F01-F06): ISO texts, null where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafquarry.functions.text import collapse

# Fixed values.
MONTHS = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06", "julio": "07", "agosto": "08",
    "septiembre": "09", "setiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12",
}


def month(name: Column) -> Column:
    """two digits; null for what is no month."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), F.lower(name))


def padded(c: Column) -> Column:
    return F.when(F.length(c) >= 2, c).otherwise(F.concat(F.lit("0"), c))


def found(text: Column, pattern: str | Column, group: int) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group) if isinstance(pattern, str) else F.regexp_substr(text, pattern), F.lit(""))


def text_date(text: Column) -> Column:
    """"5 de marzo de 2020" among the first 2000 characters, else an ISO date among the first 1000."""
    names = "|".join(m for m in MONTHS if m != "setiembre")
    # fixed values: the patterns of dates in texts
    pattern = rf"(?iU)(\d{{1,2}})\s+de\s+({names})\s+de\s+(\d{{4}})"
    start = F.substring(text, 1, 2000)
    long = F.concat_ws("-", found(start, pattern, 3), month(found(start, pattern, 2)), padded(found(start, pattern, 1)))
    return F.coalesce(F.nullif(long, F.lit("")), found(F.substring(text, 1, 1000), r"\d{4}-\d{2}-\d{2}", 0))


def new_year(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-01-01"))


def circular_date(text: Column, year: Column) -> Column:
    """"1 de setiembre del 2019"; the year's first day where there is none or its month is unknown."""
    # fixed value: the pattern of dates in circulars' titles
    t, pattern = collapse(text), r"(?i)(\d{1,2})\s+de\s+([a-zA-Z]+)\s+del?\s+(\d{4})"
    parts = F.concat(found(t, pattern, 3), F.lit("-"), month(found(t, pattern, 2)), F.lit("-"), padded(found(t, pattern, 1)))
    return F.coalesce(parts, new_year(year))


def api_date(text: Column, year: Column) -> Column:
    """dd/mm/yyyy at the start, or what starts like an ISO date as it is, or the year's first day."""
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    parts = F.concat(found(text, pattern, 3), F.lit("-"), padded(found(text, pattern, 2)), F.lit("-"), padded(found(text, pattern, 1)))
    return F.coalesce(parts, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text), new_year(year))


def office_date(text: Column, number: Column) -> Column:
    """a date beside the office's number among the first 3000 characters, by three patterns; then beside any number."""
    # fixed values: the patterns of offices' numbers and dates
    start, day = F.substring(F.coalesce(text, F.lit("")), 1, 3000), r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
    own = F.concat(F.lit(r"\Q"), F.trim(number), F.lit(r"\E"))
    patterns = [F.concat(F.lit("(?i)" + head + r"N[°ºo]?\s*"), own, F.lit(r"\s*,?\s*DE\s*" + day)) for head in (r"ORD\.\s*", r"OFICIO\s+ORDINARIO\s*", "")]
    hits = [F.when(F.trim(number) != "", F.regexp_substr(start, p)) for p in patterns]
    hits.append(F.nullif(F.regexp_extract(start, r"(?i)ORD\.\s*N[°ºo]?\s*\d+\s*,?\s*DE\s*" + day, 0), F.lit("")))
    at_end, hit = day + "$", F.coalesce(*hits)
    return F.concat(found(hit, at_end, 3), F.lit("-"), padded(found(hit, at_end, 2)), F.lit("-"), padded(found(hit, at_end, 1)))


def document_date(tipo: Column, published: Column, text: Column, number: Column, year: Column) -> Column:
    """for offices the published date, then the office's own, then one in the text; for others the text's first."""
    api = F.when(F.coalesce(published, F.lit("")) != "", api_date(published, year))
    office = F.coalesce(api, office_date(text, number), text_date(text))
    return F.coalesce(F.when(tipo.startswith("oficio"), office).otherwise(F.coalesce(text_date(text), api)), new_year(year))


def leading_number(c: Column) -> Column:
    """The number with which a text starts, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))
