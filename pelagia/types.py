"""Type widening: how columns of one name in several files, or in UNION BY NAME, get one type."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import types as T


class WideningError(TypeError):
    """Two types of one column have no common type."""


_SIGNED = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
#: Integers that a floating type represents exactly, by width in bytes.
_EXACT_IN_FLOAT = 2


def _is(t: T.DataType, *kinds: type) -> bool:
    return isinstance(t, kinds)


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both; same family only. Null yields to anything; strings never absorb numbers."""
    if a == b:
        return a
    if _is(a, T.NullType):
        return b
    if _is(b, T.NullType):
        return a
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    floats = (T.FloatType, T.DoubleType)
    if _is(a, *ints) and _is(b, *ints):
        return _SIGNED[max(next(i for i, t in enumerate(_SIGNED) if t == x) for x in (a, b))]
    if _is(a, *ints, *floats) and _is(b, *ints, *floats):
        if _is(a, *floats) and _is(b, *floats):
            return T.DoubleType()
        whole = a if _is(a, *ints) else b
        real = b if whole is a else a
        size = _SIGNED.index(whole)
        return real if _is(real, T.FloatType) and size < _EXACT_IN_FLOAT else T.DoubleType()
    if _is(a, T.DecimalType) and _is(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if scale + whole > 38:
            raise WideningError(f"{a.simpleString()} and {b.simpleString()} need more than 38 digits")
        return T.DecimalType(scale + whole, scale)
    if _is(a, T.DecimalType) and _is(b, *floats) or _is(b, T.DecimalType) and _is(a, *floats):
        return T.DoubleType()
    if _is(a, T.DecimalType) and _is(b, *ints) or _is(b, T.DecimalType) and _is(a, *ints):
        dec, whole = (a, b) if _is(a, T.DecimalType) else (b, a)
        digits = (3, 5, 10, 19)[_SIGNED.index(whole)]
        return widen(dec, T.DecimalType(digits, 0))
    stamps = (T.TimestampType, T.TimestampNTZType)
    if _is(a, *stamps) and _is(b, *stamps):
        return T.TimestampType()
    raise WideningError(f"{a.simpleString()} and {b.simpleString()} are of different families")


Widening = Callable[[T.DataType, T.DataType], T.DataType]


def merge_schemas(schemas: Sequence[tuple[str, T.StructType]], rule: Widening = widen) -> T.StructType:
    """One schema of several named ones: fields in first-seen order, widened; an error names column, types and files.

    A field is nullable unless every schema has it and requires it."""
    order: list[str] = []
    seen: dict[str, tuple[str, T.DataType]] = {}
    required: dict[str, int] = {}
    meta: dict[str, dict] = {}
    for source, schema in schemas:
        for f in schema.fields:
            if f.name not in seen:
                order.append(f.name)
                seen[f.name] = (source, f.dataType)
                meta[f.name] = f.metadata
            else:
                first, have = seen[f.name]
                try:
                    seen[f.name] = (first, rule(have, f.dataType))
                except WideningError as e:
                    raise WideningError(
                        f"column {f.name}: {have.simpleString()} in {first} and {f.dataType.simpleString()} in {source}: {e}"
                    ) from None
            required[f.name] = required.get(f.name, 0) + (not f.nullable)
    return T.StructType([T.StructField(n, seen[n][1], required[n] < len(schemas), meta[n]) for n in order])


#: Arrow type names to Spark SQL types, for try_arrow_cast and schema listings.
ARROW = {
    "boolean": "boolean", "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float",
    "float32": "float", "float64": "double", "utf8": "string", "largeutf8": "string", "utf8view": "string",
    "binary": "binary", "largebinary": "binary", "binaryview": "binary", "date32": "date", "date64": "date",
    "null": "void",
}


def arrow_to_spark(name: str) -> str:
    """`Int64`, `Timestamp(Nanosecond, None)`, `Decimal128(10, 2)`, `List(Int32)` as Spark SQL types."""
    name = name.strip()
    if not name:
        raise ValueError("an Arrow type name is needed")
    low = name.lower().replace(" ", "")
    if low in ARROW:
        return ARROW[low]
    if m := re.fullmatch(r"timestamp\((\w+),(.*)\)", low):
        return "timestamp_ntz" if m[2] == "none" else "timestamp"
    if m := re.fullmatch(r"decimal(?:128|256)\((\d+),(-?\d+)\)", low):
        return f"decimal({m[1]},{m[2]})"
    if m := re.fullmatch(r"(?:large)?list\((.*)\)", low):
        return f"array<{arrow_to_spark(m[1])}>"
    if re.fullmatch(r"duration\(\w+\)", low):
        return "interval day to second"
    raise ValueError(f"unknown Arrow type {name}")


def spark_to_arrow(t: T.DataType) -> str:
    """The Arrow name of a Spark type."""
    plain = {
        T.BooleanType: "Boolean", T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64",
        T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "Utf8", T.BinaryType: "Binary", T.DateType: "Date32",
        T.NullType: "Null", T.TimestampNTZType: "Timestamp(Microsecond, None)",
        T.TimestampType: 'Timestamp(Microsecond, Some("UTC"))',
    }
    if type(t) in plain:
        return plain[type(t)]
    if isinstance(t, T.DecimalType):
        return f"Decimal128({t.precision}, {t.scale})"
    if isinstance(t, T.ArrayType):
        return f"List({spark_to_arrow(t.elementType)})"
    if isinstance(t, T.StructType):
        return "Struct(" + ", ".join(f"{f.name}: {spark_to_arrow(f.dataType)}" for f in t.fields) + ")"
    return t.simpleString()


def widen_all(types: Sequence[T.DataType]) -> T.DataType:
    return reduce(widen, types, T.NullType())
