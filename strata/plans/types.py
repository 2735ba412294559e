"""Expression types: what the dialect needs to know beyond Spark's own typing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from strata.errors import StrataError


@dataclass(frozen=True)
class Kind:
    name: str  # text, integer, real, boolean, decimal, timestamp, date, json, null, other
    scale: int = 0

    @property
    def numeric(self) -> bool:
        return self.name in ("integer", "real", "decimal")

    @property
    def textual(self) -> bool:
        return self.name in ("text", "json")


TEXT, INTEGER, REAL, BOOLEAN, NULL, JSON, OTHER, TIMESTAMP, DATE = (Kind(x) for x in ("text", "integer", "real", "boolean", "null", "json", "other", "timestamp", "date"))


def kind_of(spark_type: T.DataType) -> Kind:
    match spark_type:
        case T.StringType():
            return TEXT
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return INTEGER
        case T.FloatType() | T.DoubleType():
            return REAL
        case T.BooleanType():
            return BOOLEAN
        case T.DecimalType():
            return Kind("decimal", spark_type.scale)
        case T.TimestampType() | T.TimestampNTZType():
            return TIMESTAMP
        case T.DateType():
            return DATE
        case T.NullType():
            return NULL
    return OTHER


def mixed(op: str, a: Kind, b: Kind) -> None:
    """Exact and inexact numbers do not meet without a CAST."""
    if {"decimal", "real"} == {a.name, b.name}:
        raise StrataError("TYPE_MISMATCH", f"{op} between decimal and real", "CAST the decimal AS real, or round the real yourself")


def common(kinds: list[Kind]) -> Kind:
    """The kind of a value that is one of several."""
    real = [k for k in kinds if k != NULL]
    if not real:
        return NULL
    if all(k.numeric for k in real):
        for k in real[1:]:
            mixed("a choice", real[0], k)
        if any(k.name == "decimal" for k in real):
            return Kind("decimal", max(k.scale for k in real))
        return REAL if REAL in real else INTEGER
    if all(k == real[0] for k in real):
        return real[0]
    if all(k.textual for k in real):
        return TEXT
    raise StrataError("TYPE_MISMATCH", f"values of kind {real[0].name} and {next(k.name for k in real if k != real[0])} cannot stand for one another")
