"""Amounts from text.  Two readings exist on purpose: header fields and line cells follow different rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.plan import bound

AMOUNT = "decimal(38,10)"
MONEY = "decimal(18,4)"


def _kept(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9.,-]", "")


def parse_amount(value: Column) -> Column:
    """A header amount: of ``,`` and ``.`` the rightmost is the decimal mark.

    With one kind only it marks thousands if it occurs twice, or once before exactly three digits with one
    to three characters in front; else decimals.
    """
    return bound(_kept(value), _amount)


def _amount(s: Column) -> Column:
    comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
    parts = F.split(s, "[.,]")
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    thousands = (F.size(parts) > 2) | ((F.length(last) == 3) & (F.length(first) <= 3) & (F.regexp_replace(first, "^-+", "") != ""))
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.translate(s, ",.", "."))
        .when((comma > 0) & (dot > 0), F.translate(s, ",", ""))
        .when((comma > 0) | (dot > 0), F.when(thousands, F.translate(s, ",.", "")).otherwise(F.translate(s, ",", ".")))
        .otherwise(s)
    )
    return plain.try_cast(AMOUNT)


def parse_decimal(value: Column) -> Column:
    """A line cell: dots group thousands only in a fully grouped number; a lone comma marks decimals."""
    return bound(_kept(value), _decimal)


def _decimal(s: Column) -> Column:
    has_comma, has_dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    plain = (
        F.when(s.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"), F.translate(s, ",.", "."))
        .when(has_comma & ~has_dot, F.translate(s, ",", "."))
        .when(has_comma & has_dot, F.translate(s, ",", ""))
        .otherwise(s)
    )
    return plain.try_cast(AMOUNT)


def money(value: Column) -> Column:
    return value.cast(MONEY)


def display_amount(value: Column, symbol: Column | str = "") -> Column:
    """Symbol, thousands and two decimals, as on a printed invoice."""
    s = F.lit(symbol) if isinstance(symbol, str) else symbol
    return F.concat(s, F.format_number(value, 2))
