"""Data dictionary: coverage audit and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "table_name string, column_name string, description string, source string, optional boolean"


def coverage(dictionary: DataFrame, columns: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(table_name, column_name, finding): columns that the dictionary lacks, and required ones that a table lacks.

    ``columns`` has table_name and column_name of the tables there are; tables that aren't there are skipped.
    """
    real = columns.where(~F.col("column_name").isin(*hidden)) if hidden else columns
    keys = ["table_name", "column_name"]
    there = dictionary.join(columns.select("table_name").distinct(), "table_name", "left_semi")
    undocumented = real.join(dictionary, keys, "left_anti").select(*keys, F.lit("undocumented").alias("finding"))
    missing = there.where("not coalesce(optional, false)").join(columns, keys, "left_anti").select(*keys, F.lit("missing").alias("finding"))
    return undocumented.union(missing)


def table_columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """Columns of the tables that exist, from the catalogue."""
    rows = [(n, c.name) for n in names if spark.catalog.tableExists(n) for c in spark.catalog.listColumns(n)]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def comment(spark: SparkSession, table: str, description: str, columns: dict[str, str], properties: dict[str, str] | None = None) -> None:
    """Set comments of a table and of those of its columns that exist; tags go to table properties."""
    spark.sql(f"COMMENT ON TABLE {table} IS {quoted(description)}")
    have = set(spark.table(table).columns)
    for name, text in columns.items():
        if name in have:
            spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{name}` COMMENT {quoted(text)}")
    if properties:
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({', '.join(f'{quoted(k)} = {quoted(v)}' for k, v in properties.items())})")


def apply_all(spark: SparkSession, dictionary: DataFrame, tables: dict[str, str], strict: bool = False) -> DataFrame:
    """Comment all tables that exist (name -> description) and return the audit; with ``strict``, findings are an error."""
    found = coverage(dictionary, table_columns(spark, list(tables)))
    if strict and not found.isEmpty():
        raise ValueError("the dictionary and the tables differ: " + ", ".join(f"{r.table_name}.{r.column_name} {r.finding}" for r in found.limit(20).collect()))
    for name, description in tables.items():
        if spark.catalog.tableExists(name):
            rows = dictionary.where(F.col("table_name") == name).select("column_name", "description").collect()  # a row a column
            comment(spark, name, description, {r.column_name: r.description for r in rows})
    return found
