"""Cleaning, dates, slugs, activity codes and address texts."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapulse.constants import ADDRESS_TAIL, CITY

MISSING = "***"


@cache
def _spaces() -> str:
    """All characters that count as white space, so no-break spaces are stripped too."""
    return "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())


def _ascii_of(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")


@cache
def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions of all characters that leave some ASCII: of one character, for `translate`, and longer ones."""
    every = {chr(i): a for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF and (a := _ascii_of(chr(i)))}
    return {c: a for c, a in every.items() if len(a) == 1}, {c: a for c, a in every.items() if len(a) > 1}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(_col(value), F.lit(_spaces()))


def clean(value: Column | str) -> Column:
    """Trimmed text; blank and `***` become null."""
    text = strip(value)
    return F.when(~text.isin("", MISSING), text)


def iso_date(value: Column | str) -> Column:
    """Day/month/year text to ISO text; missing or impossible dates become null."""
    text = clean(value)
    parsed = F.try_to_date(
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text), "d/M/yyyy"
    )
    return F.date_format(parsed, "yyyy-MM-dd")


def slug(value: Column | str) -> Column:
    """Lower-case ASCII words joined by `-`; what has no ASCII form is dropped."""
    text = _col(value)
    single, long = _decomposed()
    singles = F.translate(text, "".join(single), "".join(single.values()))
    longer = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])
    chars = F.transform(F.split(singles, ""), lambda c: F.when(c <= "\x7f", c).otherwise(F.coalesce(longer[c], F.lit(""))))
    # Most names are plain ASCII already, and most others are after the one-to-one pairs.
    other = r"[^\x00-\x7F]"
    plain = F.when(~text.rlike(other), text).when(~singles.rlike(other), singles).otherwise(F.array_join(chars, ""))
    return F.btrim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def activity_code(value: Column | str) -> Column:
    """`S.96.0.2-5/01-00` to `9602501`; every other notation becomes null."""
    text = strip(value)
    known = text.rlike(r"^[A-U]\.\d{2}\.\d\.\d-\d/\d{2}-\d{2}$")
    digits = F.concat(*[F.substring(text, at, n) for at, n in ((3, 2), (6, 1), (8, 1), (10, 1), (12, 2))])
    return F.when(known, digits)


def display_name(trade: Column | str, legal: Column | str) -> Column:
    """Trade name, else legal name."""
    return F.coalesce(_col(trade), _col(legal))


def display_address(street: Column | str, number: Column | str, district: Column | str) -> Column:
    """`street, number - district`, skipping what is null."""
    return F.concat_ws(" - ", F.concat_ws(", ", street, number), district)


def house_number(value: Column | str) -> Column:
    """Leading zeros go when the number is all digits."""
    text = strip(value)
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text)


def postal_code(value: Column | str) -> Column:
    """Eight digits become `ddddd-ddd`; anything else stays."""
    return F.regexp_replace(strip(value), "^([0-9]{5})([0-9]{3})$", "$1-$2")


def geocoding_address(
    street: Column | str, number: Column | str, district: Column | str, postal: Column | str
) -> Column:
    """Query text for the second geocoder; empty parts are skipped."""
    parts = [strip(street), house_number(number), strip(district), postal_code(postal)]
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts], F.lit(ADDRESS_TAIL))


def complete_search_text(value: Column | str) -> Column:
    """Adds the city to a search text that does not name it."""
    text = _col(value)
    named = F.lower(text).contains(CITY.lower())
    return F.when(named, text).otherwise(F.concat(text, F.lit(", " + ADDRESS_TAIL)))


def number_text(value: Column | str) -> Column:
    """Shortest decimal text of a double: `0.0005`, `9.99e-06`; null becomes `None`."""
    text = _col(value).cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    exponent = F.regexp_extract(text, r"E-([0-9]+)$", 1)
    return (
        F.when(text.isNull(), F.lit("None"))
        .when(exponent == "4", F.concat(sign, F.lit("0.000"), F.replace(digits, F.lit("."), F.lit(""))))
        .when(exponent != "", F.concat(sign, digits, F.lit("e-"), F.lpad(exponent, 2, "0")))
        .otherwise(text)
    )
