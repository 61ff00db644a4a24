"""Casts of values that may be na, and amounts between currencies. NULL is na; NaN counts as na too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def to_int(x: Column) -> Column:
    """Towards 0; na stays na, and what a long does not hold is na."""
    x = to_float(x)
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when(F.abs(x) < float(2**63), whole)


def to_bool(x: Column) -> Column:
    """False for na and 0."""
    return F.coalesce(to_float(x) != 0, F.lit(False))


def to_string(x: Column) -> Column:
    return x.cast("string")


def to_account(value: Column, symbol_currency: Column, account: str = "USD") -> Column:
    """value in the account's currency: itself where the symbol's is the same or not known, na where it is another. No rates are known."""
    return F.when(symbol_currency.isNull() | (symbol_currency == "") | (symbol_currency == account), value)


to_symbol = to_account
