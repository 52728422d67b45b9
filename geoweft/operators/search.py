"""Property searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(hits: DataFrame, limit: int | None) -> DataFrame:
    ids = hits.select(F.col("entity_id").alias("id")).distinct()
    return ids if limit is None else ids.orderBy("id").limit(limit)


def by_key(properties: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Distinct entities that have the key (parity: values are not compared)."""
    return _ids(properties.where(F.col("key") == key), limit)


def by_value(properties: DataFrame, key: str, value, limit: int | None = None) -> DataFrame:
    """Extension: entities whose property equals the value, by the value's type."""
    tag = F.col("value_type").bitwiseAND(F.lit(255))
    if isinstance(value, bool):
        hit = (tag == 4) & ((F.coalesce("value_int", F.lit(0)) != 0) == F.lit(value))
    elif isinstance(value, int):
        hit = (tag == 1) & (F.coalesce("value_int", F.lit(0)) == value)
    elif isinstance(value, float):
        hit = (tag == 2) & (F.coalesce("value_float", F.lit(0.0)) == value)
    else:
        hit = (tag == 3) & (F.coalesce("value_text", F.lit("")) == value)
    return _ids(properties.where((F.col("key") == key) & hit), limit)


def by_range(properties: DataFrame, key: str, low: float, high: float, limit: int | None = None) -> DataFrame:
    """Extension: entities whose Int or Float property lies in [low, high]."""
    tag = F.col("value_type").bitwiseAND(F.lit(255))
    number = F.when(tag == 1, F.coalesce(F.col("value_int"), F.lit(0)).cast("double")).when(tag == 2, F.coalesce("value_float", F.lit(0.0)))
    return _ids(properties.where((F.col("key") == key) & number.between(low, high)), limit)
