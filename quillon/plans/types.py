"""The four types, schemas and the rules by which operators accept and widen types."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from quillon.errors import SchemaError, SqlTypeError


class LType(Enum):
    """A logical type; the value is its name in messages."""

    INT64 = "Int64"
    FLOAT64 = "Float64"
    UTF8 = "Utf8"
    BOOLEAN = "Boolean"

    @property
    def numeric(self) -> bool:
        return self in (LType.INT64, LType.FLOAT64)

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    def __str__(self) -> str:
        return self.value


_SPARK = {LType.INT64: T.LongType(), LType.FLOAT64: T.DoubleType(), LType.UTF8: T.StringType(), LType.BOOLEAN: T.BooleanType()}
#: Spark types that columns of a source are read as; others are outside the model.
FROM_SPARK: dict[type, LType] = {
    T.ByteType: LType.INT64,
    T.ShortType: LType.INT64,
    T.IntegerType: LType.INT64,
    T.LongType: LType.INT64,
    T.FloatType: LType.FLOAT64,
    T.DoubleType: LType.FLOAT64,
    T.StringType: LType.UTF8,
    T.BooleanType: LType.BOOLEAN,
    T.TimestampNTZType: LType.UTF8,
    T.TimestampType: LType.UTF8,
    T.DateType: LType.UTF8,
}
#: Names of types in casts, in lower case: fixed values.
TYPE_NAMES = {
    "int64": LType.INT64,
    "int": LType.INT64,
    "float64": LType.FLOAT64,
    "float": LType.FLOAT64,
    "double": LType.FLOAT64,
    "utf8": LType.UTF8,
    "string": LType.UTF8,
    "varchar": LType.UTF8,
    "text": LType.UTF8,
    "boolean": LType.BOOLEAN,
    "bool": LType.BOOLEAN,
}


@dataclass(frozen=True)
class LField:
    """A named column: its type and whether it may hold nulls."""

    name: str
    type: LType
    nullable: bool = True


class LSchema:
    """An ordered list of fields with distinct, case-sensitive names."""

    def __init__(self, fields: Iterable[LField]):
        self.fields = tuple(fields)
        self._at: dict[str, int] = {}
        for i, f in enumerate(self.fields):
            if self._at.setdefault(f.name, i) != i:
                raise SchemaError(f"duplicate column name '{f.name}'")

    def __iter__(self) -> Iterator[LField]:
        return iter(self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, LSchema) and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(self.fields)

    def __repr__(self) -> str:
        return f"LSchema({list(self.fields)})"

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def index_of(self, name: str) -> int | None:
        return self._at.get(name)

    def field(self, name: str) -> LField | None:
        at = self._at.get(name)
        return None if at is None else self.fields[at]

    def project(self, indices: Iterable[int]) -> LSchema:
        picked = list(indices)
        if any(not 0 <= i < len(self.fields) for i in picked):
            raise SchemaError(f"no column {max(picked)} in a schema of {len(self.fields)}")
        return LSchema(self.fields[i] for i in picked)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark, f.nullable) for f in self.fields])

    @classmethod
    def of_spark(cls, schema: T.StructType, known: LSchema | None = None) -> LSchema:
        """The logical schema of a DataFrame; nullability of equal fields is taken from ``known``."""
        fields = []
        for f in schema.fields:
            if (kind := FROM_SPARK.get(type(f.dataType))) is None:
                raise SchemaError(f"column '{f.name}' has type {f.dataType.simpleString()}, which the engine does not have")
            old = known.field(f.name) if known else None
            fields.append(LField(f.name, kind, old.nullable if old and old.type is kind else f.nullable))
        return cls(fields)


ARITHMETIC = frozenset(["+", "-", "*", "/", "%"])
COMPARISON = frozenset(["=", "<>", "<", "<=", ">", ">="])
LOGICAL = frozenset(["AND", "OR"])


@dataclass(frozen=True)
class Coercion:
    """Result type of a binary operator and the type both operands are brought to."""

    operands: LType
    result: LType


def coerce(op: str, left: LType, right: LType) -> Coercion:
    """How an operator takes two types: equal ones as they are, mixed numbers as doubles."""
    mixed = left.numeric and right.numeric and left is not right
    operands = LType.FLOAT64 if mixed else left
    fits = mixed or left is right
    if op in ARITHMETIC and fits and left.numeric:
        return Coercion(operands, operands)
    if op in COMPARISON and fits:
        return Coercion(operands, LType.BOOLEAN)
    if op in LOGICAL and fits and left is LType.BOOLEAN:
        return Coercion(operands, LType.BOOLEAN)
    raise SqlTypeError(f"operator {op} does not take {left} and {right}")
