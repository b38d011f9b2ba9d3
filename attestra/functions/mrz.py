"""Machine-readable zones of identity cards (three lines of 30) and passports (two lines of 44)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.bound import let
from attestra.functions.codes import state_to_alpha3
from attestra.functions.digits import check_digit, digit_valid

CARD, PASSPORT = 30, 44


def zone_lines(value: Column) -> Column:
    """Lines that hold something, trimmed, in upper case, without spaces."""
    lines = F.split(value, r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.upper(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), " ", ""))
    return F.filter(bare, lambda x: x != "")


def zone_problem(lines: Column) -> Column:
    """Why the lines are no zone at all; null if they are one. A wrong check digit is no such reason."""
    odd = F.filter(lines, lambda x: ~x.rlike("^[A-Z0-9<]+$"))
    sizes = F.transform(lines, lambda x: F.char_length(x))
    card = (F.size(lines) == 3) & F.forall(sizes, lambda n: n == CARD)
    passport = (F.size(lines) == 2) & F.forall(sizes, lambda n: n == PASSPORT)
    shape = F.array_join(F.transform(sizes, lambda n: n.cast("string")), ", ")
    return F.when(F.size(odd) > 0, F.concat(F.lit("characters outside the zone's alphabet: "), F.get(odd, F.lit(0)))).when(
        ~(card | passport), F.concat(F.lit("neither 3 x 30 nor 2 x 44 characters: got "), F.size(lines).cast("string"), F.lit(" ("), shape, F.lit(")"))
    )


def _cut(line: Column, start: int, end: int) -> Column:
    """Characters start (from 0) up to end."""
    return F.substring(line, start + 1, end - start)


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit(""))


def _digit(name: str, data: Column, printed: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), data.alias("data"), printed.alias("printed"))


def _zone(form: str, head: Column, names: Column, number: Column, nationality: Column, birth: Column, sex: Column, expiry: Column, digits: list[Column]) -> Column:
    surname = F.substring_index(names, "<<", 1)
    rest = F.when(F.instr(names, "<<") > 0, F.substr(names, F.char_length(surname) + 3)).otherwise("")
    spaced = lambda c: F.trim(F.replace(c, F.lit("<"), F.lit(" ")))
    return F.struct(
        F.lit(form).alias("format"),
        _bare(_cut(head, 0, 2)).alias("document_code"),
        state_to_alpha3(_cut(head, 2, 5)).alias("issuing_state"),
        _bare(number).alias("document_number"),
        spaced(surname).alias("surname"),
        spaced(rest).alias("given_names"),
        state_to_alpha3(nationality).alias("nationality"),
        birth.alias("birth_raw"),
        sex.alias("sex"),
        expiry.alias("expiry_raw"),
        (~F.endswith(names, F.lit("<"))).alias("names_truncated"),
        F.array(*digits).alias("digits"),
    )


def parse_zone(lines: Column) -> Column:
    """The zone's fields and check digits; null if the lines are no zone."""
    a, b, c = (F.get(lines, i) for i in range(3))
    card = _zone(
        "TD1", a, c, _cut(a, 5, 14), _cut(b, 15, 18), _cut(b, 0, 6), _cut(b, 7, 8), _cut(b, 8, 14),
        [
            _digit("document_number", _cut(a, 5, 14), _cut(a, 14, 15)),
            _digit("birth_date", _cut(b, 0, 6), _cut(b, 6, 7)),
            _digit("expiry_date", _cut(b, 8, 14), _cut(b, 14, 15)),
            _digit("composite", F.concat(_cut(a, 5, 30), _cut(b, 0, 7), _cut(b, 8, 15), _cut(b, 18, 29)), _cut(b, 29, 30)),
        ],
    )
    passport = _zone(
        "TD3", a, _cut(a, 5, 44), _cut(b, 0, 9), _cut(b, 10, 13), _cut(b, 13, 19), _cut(b, 20, 21), _cut(b, 21, 27),
        [
            _digit("document_number", _cut(b, 0, 9), _cut(b, 9, 10)),
            _digit("birth_date", _cut(b, 13, 19), _cut(b, 19, 20)),
            _digit("expiry_date", _cut(b, 21, 27), _cut(b, 27, 28)),
            _digit("personal_number", _cut(b, 28, 42), _cut(b, 42, 43)),
            _digit("composite", F.concat(_cut(b, 0, 10), _cut(b, 13, 20), _cut(b, 21, 43)), _cut(b, 43, 44)),
        ],
    )
    return F.when(zone_problem(lines).isNotNull(), None).when(F.size(lines) == 3, card).when(F.size(lines) == 2, passport)


def wrong_digits(zone: Column) -> Column:
    return F.transform(F.filter(zone["digits"], lambda d: ~digit_valid(d["data"], d["printed"])), lambda d: d["name"])


def _field(c: Column, n: int) -> Column:
    return F.rpad(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "<"), n, "<")


def _names(surname: Column, given: Column, n: int) -> Column:
    part = lambda c: F.btrim(F.regexp_replace(F.upper(c), "[^A-Z]+", "<"), F.lit("<"))
    return F.rpad(F.concat(part(surname), F.lit("<<"), part(given)), n, "<")


def compose_zone(passport: bool, state: Column, number: Column, birth: Column, sex: Column, expiry: Column, nationality: Column, surname: Column, given: Column) -> Column:
    """The zone's lines as an array, with right check digits."""
    born, ends = F.date_format(birth, "yyMMdd"), F.date_format(expiry, "yyMMdd")
    doc = _field(number, 9)
    dated = F.concat(born, check_digit(born), sex, ends, check_digit(ends))
    if passport:
        head = F.concat(F.lit("P<"), _field(state, 3), _names(surname, given, 39))
        personal = F.lit("<" * 14)
        body = F.concat(doc, check_digit(doc), _field(nationality, 3), dated, personal, check_digit(personal))
        whole = lambda x: F.concat(x, check_digit(F.concat(_cut(x, 0, 10), _cut(x, 13, 20), _cut(x, 21, 43))))
        return F.array(head, let(body, whole))
    head = F.concat(F.lit("I<"), _field(state, 3), doc, check_digit(doc), F.lit("<" * 15))
    body = F.concat(dated, _field(nationality, 3), F.lit("<" * 11))
    last = check_digit(F.concat(_cut(head, 5, 30), _cut(body, 0, 7), _cut(body, 8, 15), _cut(body, 18, 29)))
    return F.array(head, F.concat(body, last), _names(surname, given, CARD))
