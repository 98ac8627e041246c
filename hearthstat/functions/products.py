"""Transport product dimension and item filters."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, functions as F

# Published product codes and labels.
FUEL = {
    2301401: "GASOLINA COMUM",
    2301501: "GASOLINA ADITIVADA",
    2301502: "GASOLINA ESPECIAL",
    2301601: "ALCOOL",
    2301801: "GAS VEICULAR",
}
PUBLIC = {
    2300101: "ONIBUS URBANO",
    2300201: "ONIBUS INTERMUNICIPAL",
    2300301: "ONIBUS INTERESTADUAL",
    2300401: "TRANSPORTE ALTERNATIVO (VAN, KOMBI, LOTADA, ETC.)",
    2300402: "VAN",
    2300403: "KOMBI",
    2300404: "LOTADA",
    2300409: "CARONA EM MOTO",
    2300502: "AUTOMOVEL DE ALUGUEL (TAXI)",
    2300601: "MOTO-TAXI",
    2300602: "TAXI-MOTO",
    2300701: "METRO",
    2300801: "TREM",
    2300901: "TRANSPORTE AQUAVIARIO (BARCA, BALSA, NAVIO, ETC.)",
    2300902: "BARCA",
    2300903: "BARCO",
    2300904: "BALSA",
    2300906: "FERRY-BOAT",
    2300907: "AEROBARCO",
    2300908: "CATAMARA",
    2300911: "CANOA MOTORIZADA",
    2301101: "INTEGRACAO TREM-METRO",
    2301201: "INTEGRACAO TREM-ONIBUS",
    2301301: "INTEGRACAO METRO-ONIBUS",
    2302301: "BONDE, BONDINHO, ETC",
    2302302: "VLT",
    2302801: "INTEGRACAO BARCA-TREM",
    2302901: "INTEGRACAO BARCA-ONIBUS",
    2303001: "INTEGRACAO BARCA-METRO",
    2303101: "UBER",
    2303102: "CABIFY",
    2303201: "TRANSPORTE ESCOLAR DIARIO",
}
# Used by the reports although the published code list lacks it.
UNLISTED = {2300404}

CODES = {
    "fuel": tuple(FUEL),
    "public": tuple(PUBLIC),
    "all": tuple(FUEL) + tuple(PUBLIC),
}


def product_dim(spark: SparkSession) -> DataFrame:
    """``product(code, label, category, in_code_list)``, 37 rows."""
    rows = [
        (code, label, category, code not in UNLISTED)
        for category, labels in (("fuel", FUEL), ("public", PUBLIC))
        for code, label in labels.items()
    ]
    return spark.createDataFrame(
        rows, "code int, label string, category string, in_code_list boolean"
    )


def items_in(items: DataFrame, codes: str | Collection[int], column: str = "v9001") -> DataFrame:
    """Keep items of a named set or of given codes.

    Literal codes, not a join, so that the filter reaches the Parquet scan.
    """
    wanted = CODES[codes] if isinstance(codes, str) else codes
    return items.filter(F.col(column).isin(*sorted(set(wanted))))
