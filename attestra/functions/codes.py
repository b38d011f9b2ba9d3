"""Country codes and account-number lengths."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@cache
def _iso() -> tuple[tuple[str, str], ...]:
    """ISO 3166-1 alpha-2 and alpha-3 of the officially assigned entries, from the JVM's locale data."""
    locale = SparkSession.active()._jvm.java.util.Locale
    return tuple((a2, locale("", a2).getISO3Country()) for a2 in sorted(locale.getISOCountries()))


def alpha2() -> list[str]:
    return [a for a, _ in _iso()]


def alpha3() -> list[str]:
    return [b for _, b in _iso()]


def is_alpha2(c: Column) -> Column:
    return c.isin(alpha2())


def is_alpha3(c: Column) -> Column:
    return c.isin(alpha3())


def alpha2_to_alpha3(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _iso() for x in pair])
    return F.try_element_at(table, c)


def state_to_alpha3(c: Column) -> Column:
    """A travel document's state code: fillers dropped; "D" is the one code of a single letter."""
    bare = F.replace(c, F.lit("<"), F.lit(""))
    return F.when(bare == "D", "DEU").otherwise(bare)


#: Account-number lengths by country (IBAN registry); other countries are only bounded by 15 to 34.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LT": 20, "LU": 20, "LV": 21,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}


def iban_length(country: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), country)
