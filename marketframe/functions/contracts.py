"""Contract symbols: ROOT + month code + two-digit year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month codes, January to December.
MONTH_CODES = "FGHJKMNQUVXZ"
PATTERN = rf"^(.+)([{MONTH_CODES}])([0-9]{{2}})$"


def is_contract(symbol: Column) -> Column:
    return symbol.rlike(PATTERN)


def contract_root(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, PATTERN, 1), F.lit(""))


def contract_code(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, PATTERN, 2), F.lit(""))


def contract_month(symbol: Column) -> Column:
    return F.when(is_contract(symbol), F.instr(F.lit(MONTH_CODES), contract_code(symbol)))


def contract_year(symbol: Column) -> Column:
    """Years up to 49 belong to the 2000s."""
    yy = F.nullif(F.regexp_extract(symbol, PATTERN, 3), F.lit("")).cast("int")
    return F.when(yy <= 49, yy + 2000).otherwise(yy + 1900)


def contract_symbol(root: Column, code: Column, year: Column) -> Column:
    return F.concat(root, code, F.lpad((year % 100).cast("string"), 2, "0"))
