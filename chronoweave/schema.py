"""Logical tables and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "ids": "release int, stable_id string, version int",
    "history": "old_id string, old_version int, new_id string, new_version int, score double, old_release int, new_release int",
    "relation": "release int, gene string, transcript string, translation string",
    "xref": "release int, graph_id string, id_db string, name_db string, assembly int",
    "hist_edges": "src string, dst string, old_release int, new_release int, weight double, kind string",
    "conn_edges": "src string, dst string, db string, assembly int, release int",
    "queries": "query_id string, from_release int, to_release int, final_database string",
    "matrix": "dataset string, obs string, feature string, value double",
}
#: Rank of an assembly: 1 is the main one.
PRIORITY = {38: 1, 37: 2}
FORMS = ("gene", "transcript", "translation")
#: The open end of a range inside comparisons; NULL outside.
OPEN = 2147483647


class ContractError(ValueError):
    """A table breaks a promise that a join or a build relies on."""


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if (bad := duplicates(df, *keys).take(3)):
        raise ContractError(f"not unique on {keys}: {bad}")
    return df


def assert_subset(small: DataFrame, large: DataFrame, on: list[str]) -> None:
    if (bad := small.join(large, on, "left_anti").take(3)):
        raise ContractError(f"missing on the other side: {bad}")


def assert_absent(df: DataFrame, column: str, part: str) -> DataFrame:
    """No value of the column may hold part (the delimiter of versioned ids)."""
    if (bad := df.filter(F.instr(column, part) > 0).take(3)):
        raise ContractError(f"{part!r} occurs in {column}: {bad}")
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a logical table in its types; a missing one is an error."""
    fields = [x.split(" ") for x in TABLES[table].split(", ")]
    if lost := [n for n, _ in fields if n not in df.columns]:
        raise ContractError(f"{table} lacks {lost}")
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


#: Types that a stored table may have.
STORABLE = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string", "date", "timestamp", "timestamp_ntz", "binary")


def assert_storable(df: DataFrame) -> DataFrame:
    """No column of a type that the store does not take; names are text and differ also in lower case."""
    if bad := [(n, t) for n, t in df.dtypes if not (t in STORABLE or t.startswith(("decimal", "interval")))]:
        raise ContractError(f"can't be stored: {bad}")
    names = [c.lower() for c in df.columns]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ContractError(f"columns occur twice: {twice}")
    return df
