"""Deletes by vectors that readers merge, and cascades along foreign keys (OP-J8).

A table is a folder of appended rows plus a folder of delete vectors: key values whose rows no longer
count.  Deleting writes the keys only; ``live`` drops their rows when it reads.  A cascade
writes the vectors of all tables that depend on the deleted rows, children before parents, so a
reader between two writes never sees a child without its parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """``key`` names a row; ``parents`` maps a column to the table whose key it refers to."""
    name: str
    key: str
    parents: tuple[tuple[str, str], ...] = ()


def store(rows: DataFrame, root: str, table: Table) -> None:
    """Append rows to a table, which starts with empty delete vectors."""
    rows.write.mode("append").parquet(f"{root}/{table.name}/rows")
    for column in _columns(table):
        _write_vector(rows.select(column).limit(0), root, table, column)


def _columns(table: Table) -> tuple[str, ...]:
    return (table.key, *(c for c, _ in table.parents))


def live(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """Rows of the table without those that a delete vector names."""
    rows = spark.read.parquet(f"{root}/{table.name}/rows")
    for column in _columns(table):
        rows = rows.join(spark.read.parquet(f"{root}/{table.name}/deleted-by-{column}").distinct(), column, "left_anti")
    return rows


def _write_vector(keys: DataFrame, root: str, table: Table, column: str) -> None:
    keys.distinct().write.mode("append").parquet(f"{root}/{table.name}/deleted-by-{column}")


def cascade_delete(spark: SparkSession, root: str, tables: list[Table], name: str, keys: DataFrame) -> None:
    """Delete the rows of table ``name`` whose key is in ``keys`` (one column) and all rows that depend on them."""
    by_name = {t.name: t for t in tables}
    if name not in by_name:
        raise ValueError(f"unknown table {name!r}")

    def remove(table: Table, gone: DataFrame) -> None:
        for child in tables:
            for column, parent in child.parents:
                if parent != table.name:
                    continue
                if any(p == child.name for t in tables for _, p in t.parents):  # its own children first
                    rows = live(spark, root, child).join(gone.withColumnRenamed(gone.columns[0], column), column, "left_semi")
                    remove(child, rows.select(child.key))
                _write_vector(gone.select(F.col(gone.columns[0]).alias(column)), root, child, column)
        _write_vector(gone.select(F.col(gone.columns[0]).alias(table.key)), root, table, table.key)

    remove(by_name[name], keys.distinct())


def orphans(spark: SparkSession, root: str, tables: list[Table]) -> DataFrame:
    """(table, column, rows) that refer to a parent row which is not there."""
    out = None
    by_name = {t.name: t for t in tables}
    for t in tables:
        for column, parent in t.parents:
            have = live(spark, root, by_name[parent]).select(F.col(by_name[parent].key).alias(column))
            lost = live(spark, root, t).join(have, column, "left_anti").agg(F.count(F.lit(1)).alias("rows"))
            one = lost.select(F.lit(t.name).alias("table"), F.lit(column).alias("column"), "rows")
            out = one if out is None else out.unionByName(one)
    return out
