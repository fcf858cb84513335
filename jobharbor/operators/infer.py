"""Wide tables from JSON objects of objects, with column types inferred from all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor.functions import json_values as J
from jobharbor.functions.frames import once

# The id column and the fields that are never loaded.
ID_COLUMN = "queue"
SKIP_FIELDS = ("coreenergy_data", "corepower_data", "maxdiskio_data")
VALUE_COLUMN = "data"


def catalogue_entries(snapshots: DataFrame, *keep: str) -> DataFrame:
    """One row per top-level key of each landed object: its key and its payload.

    Entries are parsed one by one and spread over tasks again, so one large file is neither one value nor one
    task. Of a repeated key the last entry counts.
    """
    opened = snapshots.select(*keep, F.from_json("content", "map<string, variant>").alias("_map"))
    entries = once(opened, _keys=F.map_keys("_map"))
    repeats = F.size(F.array_distinct("_keys")) < F.size("_keys")
    sorted_keys = F.array_sort(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    entries = once(entries, _sorted=F.when(repeats, sorted_keys))
    places = F.expr(
        "CASE WHEN _sorted IS NOT NULL THEN transform(filter(_sorted, (e, i) -> i + 1 = size(_sorted) OR _sorted[i + 1].k <> e.k), e -> e.i) "
        "WHEN size(_keys) > 0 THEN sequence(0, size(_keys) - 1) END"
    )
    entries = once(entries, _values=F.map_values("_map"), _places=places)
    placed = entries.select(*keep, "_keys", "_values", F.explode("_places").alias("_at"))
    return placed.select(*keep, F.col("_keys")[F.col("_at")].alias("name"), F.col("_values")[F.col("_at")].alias("payload")).hint("rebalance")


def fields_of(payload: Column) -> Column:
    """Fields of a payload as a map; a payload that is no object is the single field ``data``."""
    fields = F.when(
        J.is_object(payload), F.try_variant_get(payload, "$", "map<string,variant>")
    ).otherwise(F.create_map(F.lit(VALUE_COLUMN), payload))
    return F.map_filter(fields, lambda k, _: ~k.isin(*SKIP_FIELDS))


def catalogue_cells(entries: DataFrame, *keep: str) -> DataFrame:
    """One row per entry and field."""
    return entries.select(*keep, "name", F.explode(fields_of(F.col("payload"))).alias("field", "value"))


def type_state(cells: DataFrame, *keep: str) -> DataFrame:
    """The types of each field as counts: ``keep``, field, rank, cells. States of different rows add up; one row per group and task is shuffled."""
    ranked = cells.select(*keep, "field", J.type_rank(F.col("value")).alias("rank"))
    return ranked.groupBy(*keep, "field", "rank").agg(F.count("*").alias("cells"))


def widest_types(state: DataFrame) -> DataFrame:
    """Field and type from counts: the widest type that any value has."""
    ranked = state.where("cells > 0").groupBy("field").agg(F.max("rank").alias("rank"))
    widest = F.when(F.col("field") == ID_COLUMN, len(J.TYPE_ORDER) - 1).otherwise(F.col("rank"))
    return ranked.select("field", J.type_name(widest).alias("type"))


def infer_types(cells: DataFrame) -> DataFrame:
    """Field and type: the widest type of any value."""
    return widest_types(type_state(cells))


def field_list(types: DataFrame) -> list[tuple[str, str]]:
    """The inferred columns: the layout of the wide table, which the driver must plan with."""
    return sorted((r["field"], r["type"]) for r in types.collect())


def wide_rows(entries: DataFrame, fields: list[tuple[str, str]], *keep: str) -> DataFrame:
    """Entries as rows with one typed column per field.

    Every entry is one value, so its columns are picked out of it in place: no pivot, no shuffle.
    An absent field is null; a payload field named like the id column takes its place.
    """
    opened = once(entries.select(*keep, "name", "payload"), fields=fields_of(F.col("payload")))
    own_id = J.cell_text(F.col("fields")[ID_COLUMN])
    queue = F.when(F.map_contains_key("fields", ID_COLUMN), own_id).otherwise(F.col("name"))
    columns = [
        J.cell_value(F.col("fields")[name], type_).alias(name)
        for name, type_ in fields
        if name != ID_COLUMN
    ]
    return opened.select(*keep, queue.alias(ID_COLUMN), *columns)


def wide_schema(fields: list[tuple[str, str]]) -> T.StructType:
    columns = [T.StructField(n, J.SPARK_TYPE[t]) for n, t in fields if n != ID_COLUMN]
    return T.StructType([T.StructField(ID_COLUMN, T.StringType()), *columns])
