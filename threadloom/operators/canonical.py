"""One canonical row of each message id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_rows(df: DataFrame, key: Column, order: Column, **columns: Column) -> DataFrame:
    """``id``, ``first_record`` and the given columns of the row with the smallest ``order`` of each key.

    Rows without a key are left out; nulls in ``columns`` stay null. One shuffle with a map-side combine, so the copies of a hot
    key are reduced before they move. Columns of fixed width keep it a hash aggregate: parse before calling.
    """
    found = df.select(key.alias("id"), order.alias("first_record"), *[c.alias(k) for k, c in columns.items()]).where("id is not null")
    return found.groupBy("id").agg(*[F.min_by(F.col(k), F.col("first_record")).alias(k) for k in columns], F.min("first_record").alias("first_record"))
