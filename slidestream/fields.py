"""Fields, row schemas and aggregation schemas.

A field is an object, not a name: two fields called ``eventTime`` are different columns, so the sides of a join never clash. Each field
owns a unique column name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import types as T

_numbers = count()
#: Wire types of the data model and the Spark types that hold them.
TYPES: dict[str, T.DataType] = {"int": T.IntegerType(), "long": T.LongType(), "uint64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType(), "local_timestamp": T.TimestampNTZType()}
KINDS = ("key", "sum", "min", "max", "noop")


@dataclass(frozen=True, eq=False)
class Field:
    """One column of one stream; equal only to itself."""

    name: str
    type: str
    column: str = field(init=False)

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type!r} of field {self.name!r}; known: {', '.join(TYPES)}")
        object.__setattr__(self, "column", f"{self.name}_{next(_numbers)}")

    @property
    def spark_type(self) -> T.DataType:
        return TYPES[self.type]


@dataclass(frozen=True)
class Schema:
    """The fields of a row, in wire order."""

    fields: tuple[Field, ...]

    @classmethod
    def of(cls, *fields: Field) -> Schema:
        if len({id(f) for f in fields}) != len(fields):
            raise ValueError("a schema names a field twice")
        return cls(fields)

    def __iter__(self) -> Iterator[Field]:
        return iter(self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.column, f.spark_type) for f in self.fields])

    def require(self, *fields: Field) -> None:
        """Raises if a field isn't a column here."""
        for f in fields:
            if not any(f is own for own in self.fields):
                raise ValueError(f"field {f.name!r} isn't among the columns: {', '.join(x.name for x in self.fields)}")

    def plus(self, *fields: Field) -> Schema:
        return Schema.of(*self.fields, *fields)


@dataclass(frozen=True)
class AggSchema:
    """What becomes of each field in an aggregation; bound by field, whatever the order."""

    parts: tuple[tuple[Field, str], ...]

    @classmethod
    def of(cls, *parts: tuple[Field, str]) -> AggSchema:
        for f, kind in parts:
            if kind not in KINDS:
                raise ValueError(f"unknown aggregation {kind!r} of field {f.name!r}; known: {', '.join(KINDS)}")
        if not any(kind == "key" for _, kind in parts):
            raise ValueError("an aggregation needs a key")
        Schema.of(*[f for f, _ in parts])
        return cls(parts)

    def keys(self) -> list[Field]:
        return [f for f, kind in self.parts if kind == "key"]

    def values(self) -> list[tuple[Field, str]]:
        return [(f, kind) for f, kind in self.parts if kind != "key"]

    def schema(self) -> Schema:
        return Schema.of(*[f for f, _ in self.parts])
