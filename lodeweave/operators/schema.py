"""Schemas as tables, and walks over nested schemas."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def columns_of(df: DataFrame) -> DataFrame:
    """One row for each column: its name, type and place."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, place int")


def paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Every field path of a nested type."""
    if isinstance(kind, T.StructType):
        for f in kind:
            here = f"{at}.{f.name}" if at else f.name
            yield here
            yield from paths(f.dataType, here)
    elif isinstance(kind, T.ArrayType):
        yield from paths(kind.elementType, at)
    elif isinstance(kind, T.MapType):
        yield from paths(kind.valueType, at)


def forbid(df: DataFrame, names: set[str]) -> None:
    """Raise if a field of any depth has one of these names."""
    found = sorted(p for p in paths(df.schema) if p.rsplit(".", 1)[-1] in names)
    if found:
        raise ValueError(f"forbidden fields: {found}")
