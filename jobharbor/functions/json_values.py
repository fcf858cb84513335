"""JSON cells: inferred types, storable values, paths, membership, export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type order from narrow to wide.
TYPE_ORDER = ("BIGINT", "DOUBLE", "TEXT")
SPARK_TYPE = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "TEXT": T.StringType()}


def variant_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_nested(value: Column) -> Column:
    kind = variant_kind(value)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def is_object(value: Column) -> Column:
    return F.coalesce(variant_kind(value).startswith("OBJECT"), F.lit(False))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it.

    Spark's parsers stop behind the first value. Putting the text inside an object, before keys
    it cannot foresee, makes anything left over show. The keys are the digits of its hash: the parser
    remembers every name it has met, so a name of its own for each text would slow down all later ones.
    """
    end = F.lpad(F.hex(F.xxhash64(text)), 16, "0")
    digits = [F.substring(end, at, 1) for at in range(1, 17)]
    tail = F.concat(*[part for digit in digits for part in (F.lit(',"'), digit, F.lit('":0'))])
    wrapped = F.concat(F.lit('{"v":'), text, tail, F.lit("}"))
    return F.coalesce(F.json_object_keys(wrapped) == F.array(F.lit("v"), *digits), F.lit(False))


def is_json_object(text: Column) -> Column:
    return is_json(text) & text.rlike(r"^\s*\{")


def type_rank(value: Column) -> Column:
    """Position in TYPE_ORDER. Null, boolean, string and nested values are text."""
    kind = variant_kind(value)
    return (
        F.when(kind == "BIGINT", 0)
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), 1)
        .otherwise(2)
    )


def type_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPE_ORDER)), rank + 1)


def cell_text(value: Column) -> Column:
    """Text form of a cell: compact JSON for lists and objects, plain text otherwise."""
    kind = variant_kind(value)
    return (
        F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value))
        .when(kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double").cast("string"))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def cell_value(value: Column, type_: str) -> Column:
    if type_ == "BIGINT":
        return F.try_variant_get(value, "$", "bigint")
    if type_ == "DOUBLE":
        return F.try_variant_get(value, "$", "double")
    return cell_text(value)


def json_path(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def json_has(text: Column, member: str) -> Column:
    """Whether a JSON array of strings holds ``member``."""
    return F.array_contains(F.from_json(text, "array<string>"), member)


def json_rows(text: Column, element: str) -> Column:
    """A JSON array of objects as an array of structs, for ``inline`` or ``explode``."""
    return F.from_json(text, f"array<{element}>")


def finite(value: Column) -> Column:
    """NaN and infinities have no place in strict JSON."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def timestamp_text(value: Column) -> Column:
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def export_value(field: T.StructField) -> Column:
    """A column as it appears in an exported JSON line."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = finite(value)
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        value = timestamp_text(value)
    elif field.name.endswith("_json") and isinstance(field.dataType, T.StringType):
        value = F.coalesce(F.try_parse_json(value), value.cast(T.VariantType()))
    return value.alias(field.name)


def json_line(schema: T.StructType) -> Column:
    """A whole row as one strict JSON object, nulls written out."""
    return F.to_json(F.struct(*map(export_value, schema.fields)), {"ignoreNullFields": "false"})


def display_value(value: Column, width: int = 120) -> Column:
    text = value.cast("string")
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    ).otherwise(F.coalesce(text, F.lit("NULL")))
