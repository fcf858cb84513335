"""Looking into tables: layout, counts, JSON lines, vertical view, data dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor import schemas
from jobharbor.descriptions import CATALOGUE, default_descriptions
from jobharbor.functions import json_values as J
from jobharbor.operators import analytics
from jobharbor.sources.versions import VersionedTables

# Order in which each known table is shown.
ORDER = {
    "jobs": lambda: [F.desc("_fetched_utc"), F.desc("pandaid")],
    "selectionsummary": lambda: [F.col("_queue"), F.col("id")],
    "errors_by_count": lambda: [F.col("_queue"), F.col("id")],
    "snapshots": lambda: [F.desc("fetched_utc"), F.col("snapshot_id")],
}


def describe(spark: SparkSession, schema: T.StructType) -> DataFrame:
    rows = [(i, f.name, schemas.sql_type(f)) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, column_type string")


def known_tables(spark: SparkSession) -> list[str]:
    """The tables of interest that exist, in display order."""
    existing = {t.name for t in spark.catalog.listTables()}
    return [t for t in schemas.INSPECTED if t in existing]


def published_tables(store: VersionedTables) -> list[str]:
    """The same of what cycles have published."""
    existing = set(store.tables())
    return [t for t in schemas.INSPECTED if t in existing]


def published_layout(store: VersionedTables) -> DataFrame:
    """table_name, n_rows and the layout of every published table of interest, one row per column."""
    layouts = schemas.empty(store.spark, schemas.layout("table_name STRING, position INT, column_name STRING, column_type STRING"))
    names = published_tables(store)
    for name in names:
        layouts = layouts.unionByName(describe(store.spark, schemas.INSPECTED[name]).withColumn("table_name", F.lit(name)))
    if not names:
        return layouts.withColumn("n_rows", F.lit(0).cast("bigint"))
    counts = analytics.row_counts({name: store.read(name, schemas.INSPECTED[name]) for name in names})
    return layouts.join(counts, "table_name")


def select_rows(table: str, rows: DataFrame, queue: str | None = None, limit: int = 10) -> DataFrame:
    """Rows of a table in its display order; a limit of 0 gives all of them."""
    ordered = analytics.of_queue(rows, queue)
    if table in ORDER:
        ordered = ordered.orderBy(*ORDER[table]())
    return ordered.limit(limit) if limit > 0 else ordered


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(J.json_line(rows.schema).alias("line"))


def vertical(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per non-null cell, identified by ``keys``, shortened for display."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("cell"))
            for c in rows.columns
            if c not in keys
        ]
    )
    return rows.select(*keys, F.inline(cells)).where("cell is not null").select(
        *keys, "column_name", J.display_value(F.col("cell")).alias("display")
    )


# --- data dictionary --------------------------------------------------------------------------


def dictionary(spark: SparkSession, descriptions: DataFrame | None = None) -> DataFrame:
    """table_name, position, column_name, column_type, description of the known tables.

    Descriptions come from a table (table_name, column_name, description), or short ones of ours.
    """
    layouts = [
        describe(spark, schema).select(F.lit(name).alias("table_name"), "*")
        for name, schema in schemas.TABLES.items()
    ]
    columns = reduce(DataFrame.unionByName, layouts)
    texts = default_descriptions(spark) if descriptions is None else descriptions
    return columns.join(texts, ["table_name", "column_name"], "left").withColumn(
        "description", F.coalesce("description", F.lit(""))
    )


def catalogue_dictionary(fields: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """The same columns for the wide queue table, whose ``fields`` (field, type) its refresh has published.

    ``descriptions`` (column_name, description) takes the place of our short ones.
    """
    spark = fields.sparkSession
    texts = spark.createDataFrame(list(CATALOGUE.items()), "column_name string, description string") if descriptions is None else descriptions
    columns = fields.where(F.col("field") != "queue").select(F.col("field").alias("column_name"), F.col("type").alias("column_type"))
    columns = spark.createDataFrame([("queue", "TEXT")], "column_name string, column_type string").unionByName(columns)
    # the key first, then by name; a table has few columns
    order = Window.orderBy(F.col("column_name") != "queue", "column_name")
    placed = columns.withColumn("position", F.row_number().over(order) - 1).withColumn("table_name", F.lit("queuedata"))
    described = placed.join(texts, "column_name", "left").withColumn("description", F.coalesce("description", F.lit("")))
    return described.select("table_name", "column_name", "position", "column_type", "description")


def pad(text: Column, width: int) -> Column:
    """Pad on the right; longer text stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def first_sentence(text: Column) -> Column:
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    return F.concat(F.split_part(line, F.lit("."), F.lit(1)), F.lit("."))


def context_lines(entries: DataFrame, short: bool = False) -> DataFrame:
    """The dictionary as lines of text, one per column, to be ordered by table and position.

    ``short`` keeps the first sentence of each description and sets columns a little wider.
    """
    gap = "  " if short else " "
    text = first_sentence(F.col("description")) if short else F.col("description")
    line = F.concat(
        F.lit("  "), pad(F.col("column_name"), 30), F.lit(gap),
        pad(F.col("column_type"), 10), F.lit("  "), text,
    )
    return entries.select("table_name", "position", line.alias("line"))


def schema_context(entries: DataFrame, tables: Sequence[str] | None = None, short: bool = False) -> str:
    """The dictionary as one text for a prompt. A dictionary is as long as its tables are wide."""
    names = list(tables or schemas.table_names())
    rows = context_lines(entries.where(F.col("table_name").isin(names)), short)
    by_table: dict[str, list[str]] = {name: [] for name in names}
    for row in rows.orderBy("position").collect():
        by_table[row["table_name"]].append(row["line"])
    return "\n".join("\n".join([f"Table: {n}", *by_table[n], ""]) for n in names)
