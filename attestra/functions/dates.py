"""Date rules. The business date is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.bound import let


def iso_date(c: Column) -> Column:
    """A date that is written YYYY-MM-DD and exists, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def age_on(birth: Column, today: Column) -> Column:
    """Whole years; born on 29 February, a year is full on 1 March."""
    before = F.struct(F.month(today), F.dayofmonth(today)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(today) - F.year(birth) - before.cast("int")


def short_date(raw: Column, today: Column, future: bool) -> Column:
    """A YYMMDD date: of this century, but for a past date that would lie after today, of the last."""
    of = lambda century: F.when(raw.rlike(r"^\d{6}$"), F.try_to_date(F.concat(F.lit(century), raw), "yyyyMMdd"))
    return of("20") if future else F.when(of("20") > today, of("19")).otherwise(of("20"))


#: The first three letters of the English months.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def date_in(value: Column, words: Column) -> Column:
    """Do three neighbouring words (of those that are numbers or months) say the date? The date gives a pattern of all its
    spellings, day first or year first, with short years, leading zeros, and after the day a month by name."""
    return let(value, lambda day: _said_in(day, words))


def _said_in(value: Column, words: Column) -> Column:
    kept = F.array_join(F.filter(words, lambda w: w.rlike(r"^\d+$") | F.substring(w, 1, 3).isin(*MONTHS)), " ")
    number = lambda n: F.concat(F.lit("0*"), n.cast("string"))
    day, month = number(F.dayofmonth(value)), number(F.month(value))
    year = F.concat(F.lit("("), number(F.year(value)), F.lit("|"), F.lpad((F.year(value) % 100).cast("string"), 2, "0"), F.lit(")"))
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(value))
    day_first = F.concat(day, F.lit(" ("), month, F.lit("|"), name, F.lit("[^ ]*) "), year)
    year_first = F.concat_ws(" ", year, month, day)
    return F.rlike(kept, F.concat(F.lit("(^| )("), day_first, F.lit("|"), year_first, F.lit(")( |$)")))
