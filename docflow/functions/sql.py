"""The scalar functions for SQL text: temporary SQL functions, which Catalyst inlines, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docflow.functions.labels import ROMAN
from docflow.operators.search import DROPPED_CLASS, FOLDS


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _roman() -> str:
    place = lambda digits, unit: f"element_at(array({', '.join(map(_text, digits))}), cast(floor(n / {unit}) % 10 + 1 AS int))"
    return f"CASE WHEN n = 0 THEN '0' ELSE concat(repeat('m', cast(floor(n / 1000) AS int)), {place(ROMAN[1], 100)}, {place(ROMAN[2], 10)}, {place(ROMAN[3], 1)}) END"


FUNCTIONS = {
    "docflow_half_up(x DOUBLE) RETURNS BIGINT": "floor(x + 0.5)",
    "docflow_page_of(y DOUBLE, height DOUBLE) RETURNS BIGINT": "greatest(floor((y + 0.25D) / height), 0)",
    "docflow_spread_of(page BIGINT, mode STRING) RETURNS BIGINT": "CASE mode WHEN 'single' THEN page - 1 WHEN 'double' THEN floor((page - 1) / 2) ELSE floor(page / 2) END",
    "docflow_letter(n BIGINT) RETURNS STRING": "chr(97 + pmod(pmod(n, 256) - 1, 256) % 26)",
    "docflow_roman(n BIGINT) RETURNS STRING": _roman(),
    "docflow_normalize(s STRING) RETURNS STRING": f"translate(regexp_replace(s, {_text(DROPPED_CLASS)}, ''), {_text(''.join(FOLDS))}, {_text(''.join(FOLDS.values()))})",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql and returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
