"""Check digits: the 7-3-1 digit of machine-readable zones and the mod-97 check of account numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.bound import let
from attestra.functions.codes import iban_length

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def symbol_value(c: Column) -> Column:
    """0-9, A-Z as 0 to 35, the filler as 0, anything else null."""
    at = F.call_function("instr", F.lit(_ALPHABET), c)
    return F.when(c == "<", 0).when((F.char_length(c) == 1) & (at > 0), at - 1)


def check_digit(data: Column) -> Column:
    """Weights 7, 3, 1 repeating, sum modulo 10, as text; null if a character has no value."""
    weighed = F.transform(F.split(data, ""), lambda c, i: symbol_value(c) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3 + 1))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.when(data == "", "0").otherwise((total % 10).cast("string"))


def digit_valid(data: Column, printed: Column) -> Column:
    """A filler may stand for the digit of a field of fillers alone."""
    return ((printed == "<") & (F.replace(data, F.lit("<"), F.lit("")) == "") & (data != "")) | (printed == check_digit(data))


def compact_account(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def mod97(c: Column) -> Column:
    """The remainder of the number that the text spells when letters are read as 10 to 35. Folded, as it has up to 68 digits."""
    return F.aggregate(
        F.transform(F.split(c, ""), symbol_value),
        F.lit(0),
        lambda a, x: F.when(x < 10, (a * 10 + x) % 97).otherwise((a * 100 + x) % 97).cast("int"),
    )


def account_problem(c: Column) -> Column:
    """Null if the account number is valid, else the first problem: shape, length of its country, checksum."""
    return let(compact_account(c), _problem)


def _problem(v: Column) -> Column:
    country = F.substring(v, 1, 2)
    length = iban_length(country)
    return (
        F.when(~v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), "not shaped as country, two digits and 11 to 30 characters")
        .when(
            length.isNotNull() & (F.char_length(v) != length),
            F.concat(F.lit("numbers of "), country, F.lit(" have "), length.cast("string"), F.lit(" characters, not "), F.char_length(v).cast("string")),
        )
        .when(mod97(F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))) != 1, "mod-97 remainder is not 1")
    )


def account_number(country: Column, basic: Column) -> Column:
    """A valid account number of a country and a basic number."""
    return F.concat(country, F.lpad((98 - mod97(F.concat(basic, country, F.lit("00")))).cast("string"), 2, "0"), basic)
