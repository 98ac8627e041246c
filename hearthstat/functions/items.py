"""Row expressions on microdata: ids, annual value, annual income."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOUSEHOLD_KEYS = ("cod_upa", "num_dom", "num_uc")
PERSON_KEYS = HOUSEHOLD_KEYS + ("cod_informante",)


def ids_to_string(df: DataFrame, columns=HOUSEHOLD_KEYS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def pasted(columns) -> Column:
    """Concatenate as text without padding; a missing part reads NA."""
    return F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def household_id(keys=HOUSEHOLD_KEYS) -> Column:
    """Display id.  Group on the typed columns instead: unpadded text can collide."""
    return pasted(keys)


def person_id(keys=PERSON_KEYS) -> Column:
    return pasted(keys)


def annual_value() -> Column:
    """Deflated amount times yearly factor, times months when months are given."""
    yearly = F.col("v8000_defla") * F.col("fator_anualizacao")
    return F.when(F.col("v9011").isNull(), yearly).otherwise(yearly * F.col("v9011"))


def annual_income() -> Column:
    """Twelve monthly incomes, deflated when a deflator is given."""
    yearly = F.col("renda_total") * 12
    return F.when(F.col("deflator").isNull(), yearly).otherwise(yearly * F.col("deflator"))


def with_annual_amounts(items: DataFrame) -> DataFrame:
    return items.withColumns({"gasto": annual_value(), "renda_anual": annual_income()})
