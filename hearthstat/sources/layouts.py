"""Record layouts of the two fixed-width microdata files.

A layout is text, one field per word: ``name:width`` with an optional type letter
(``l`` long, ``d`` double; int when omitted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}


@dataclass(frozen=True)
class Field:
    name: str
    start: int
    width: int
    dtype: T.DataType


def parse_layout(text: str) -> list[Field]:
    fields, start = [], 1
    for word in text.split():
        name, width, kind = (word.split(":") + [""])[:3]
        fields.append(Field(name.lower(), start, int(width), _TYPES[kind]))
        start += int(width)
    return fields


def record_width(layout: list[Field]) -> int:
    return layout[-1].start + layout[-1].width - 1


# Field names and widths of the published files.
LIVING_CONDITIONS = parse_layout("""
    UF:2 ESTRATO_POF:4 TIPO_SITUACAO_REG:1 COD_UPA:9:l NUM_DOM:2 NUM_UC:1 COD_INFORMANTE:2
    V6101:1 V6102:6 V6103:5
    V61041:1 V61042:1 V61043:1 V61044:1 V61045:1 V61046:1
    V61051:1 V61052:1 V61053:1 V61054:1 V61055:1 V61056:1 V61057:1 V61058:1
    V61061:1 V61062:1 V61063:1 V61064:1 V61065:1 V61066:1 V61067:1 V61068:1 V61069:1
    V610610:1 V610611:1 V61071:1 V61072:1 V61073:1
    V6108:1 V6109:1 V6110:1 V6111:1 V6112:1 V6113:1 V6114:1 V6115:1 V6116:1
    V6117:1 V6118:1 V6119:1 V6120:1 V6121:1
    PESO:14:d PESO_FINAL:14:d RENDA_TOTAL:10:d
""")

INDIVIDUAL_EXPENSES = parse_layout("""
    UF:2 ESTRATO_POF:4 TIPO_SITUACAO_REG:1 COD_UPA:9:l NUM_DOM:2 NUM_UC:1 COD_INFORMANTE:2
    QUADRO:2 SEQ:2 V9001:7 V9002:2 V8000:10:d V9010:2 V9011:2 V9012:1 V4104:1 V4105:1
    DEFLATOR:12:d V8000_DEFLA:10:d COD_IMPUT_VALOR:1 FATOR_ANUALIZACAO:2
    PESO:14:d PESO_FINAL:14:d RENDA_TOTAL:10:d V9004:5
""")
