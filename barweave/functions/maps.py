"""Maps as values: what changes a map returns the new one. Spark maps keep the order in which keys came first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new(key: str = "string", value: str = "double") -> Column:
    return F.create_map().cast(f"map<{key},{value}>")


contains, keys, values, size = F.map_contains_key, F.map_keys, F.map_values, F.size
copy = lambda m: m


def get(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def put(m: Column, key: Column, value: Column) -> Column:
    """An entry that is there keeps its place; get() on the old map gives the previous value."""
    there = F.map_contains_key(m, key)
    return F.when(there, F.transform_values(m, lambda k, v: F.when(k == key, value).otherwise(v))).otherwise(F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value)))


def put_all(m: Column, other: Column) -> Column:
    """Of keys in both, other's values."""
    mine = F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))
    return F.map_concat(mine, other)


def remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def clear(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.lit(False))
