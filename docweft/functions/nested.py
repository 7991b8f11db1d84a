"""Nested values, driven by their type: map over string leaves, collect them, merge two structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .text import some

Leaf = Callable[[Column, str], Column]


def map_strings(value: Column, kind: DataType, leaf: Leaf, path: str = "") -> Column:
    """value with each string leaf replaced by leaf(leaf value, path); paths of array items end in []."""
    if isinstance(kind, StringType):
        return leaf(value, path)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, leaf, f"{path}[]"))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: map_strings(v, kind.valueType, leaf, f"{path}{{}}"))
    if isinstance(kind, StructType):
        parts = [map_strings(value[f.name], f.dataType, leaf, f"{path}.{f.name}".lstrip(".")).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def all_strings(value: Column, kind: DataType) -> Column:
    """The string leaves of value as one array, in the order of the type; nulls are left out."""
    none = F.array().cast("array<string>")
    if isinstance(kind, StringType):
        return F.array_compact(F.array(value))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: all_strings(x, kind.elementType))), none)
    if isinstance(kind, MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: all_strings(x, kind.valueType))), none)
    if isinstance(kind, StructType):
        return F.concat(none, *[all_strings(value[f.name], f.dataType) for f in kind])
    return none


def merge(primary: Column, fallback: Column, kind: StructType, unite: frozenset[str] = frozenset(), facts: frozenset[str] = frozenset()) -> Column:
    """Field by field: the primary's value where it isn't empty, else the fallback's.

    Arrays are taken whole, or united without repeats if named in ``unite``; fields named
    in ``facts`` come from the fallback first.
    """

    def field(name: str, of: DataType) -> Column:
        a, b = (fallback[name], primary[name]) if name in facts else (primary[name], fallback[name])
        if isinstance(of, StructType):
            return merge(a, b, of, unite, facts)
        if isinstance(of, ArrayType):
            empty = F.coalesce(F.size(a), F.lit(0)) <= 0
            if name in unite:
                none = F.array().cast(of)
                return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))
            return F.when(empty, b).otherwise(a)
        if isinstance(of, StringType):
            return F.when(F.trim(some(a)) != "", a).otherwise(b)
        return F.coalesce(a, b)

    return F.struct(*[field(f.name, f.dataType).alias(f.name) for f in kind])
