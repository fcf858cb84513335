"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    An ordinary derived column is copied by the optimizer into every later filter and selection
    that uses it, so an expensive parse would run several times. Nothing is pushed below a
    generator; this one merely hands the finished values on.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", made.alias("_once")).select(*rows.columns, F.inline(F.array("_once")))
