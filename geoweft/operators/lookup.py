"""Entity lookups: existence, positions, properties and blob references by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions.scalar import decode_value


def decoded_properties(properties: DataFrame) -> DataFrame:
    return properties.select("entity_id", "key", decode_value("value_type", "value_int", "value_float", "value_text").alias("value"))


def blob_refs(blobs: DataFrame) -> DataFrame:
    """(entity_id, key, hash, mime, size); the bytes are never read."""
    return blobs.select("entity_id", "key", "hash", F.coalesce("mime", F.lit("")).alias("mime"), F.col("size_bytes").alias("size"))


def of_ids(df: DataFrame, column: str, ids: DataFrame | list[int]) -> DataFrame:
    """Rows of the ids asked for: a semi join with a frame (column ``id``), or a pushed filter for a list."""
    if isinstance(ids, list):
        return df.where(F.col(column).isin(ids))
    return df.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def get_entities(entities, properties, blobs, ids: DataFrame | list[int], want_properties: bool, want_blobs: bool) -> DataFrame:
    """One row per known id of ``ids`` (a frame with column ``id``, or a short list): id, properties, blob_refs.

    Unknown ids give no row. A list that is not wanted is empty and its table is not read.
    The aggregations run only over rows whose entity was asked for.
    """
    out = of_ids(entities, "id", ids)

    def attach(rows: DataFrame, name: str, item) -> None:
        nonlocal out
        lists = of_ids(rows, "entity_id", ids).groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias(name))
        out = out.join(lists, "id", "left")

    prop_type = "array<struct<key:string,value:struct<type:tinyint,int:bigint,float:double,text:string,bool:boolean,blob:struct<hash:bigint,size:bigint>>>>"
    ref_type = "array<struct<key:string,hash:bigint,size:bigint>>"
    if want_properties:
        attach(decoded_properties(properties), "properties", F.struct("key", "value"))
    else:
        out = out.withColumn("properties", F.lit(None).cast(prop_type))
    if want_blobs:
        attach(blob_refs(blobs), "blob_refs", F.struct("key", "hash", "size"))
    else:
        out = out.withColumn("blob_refs", F.lit(None).cast(ref_type))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return out.select("id", empty("properties", prop_type), empty("blob_refs", ref_type))


def known(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, known) for every id asked for."""
    found = entities.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.lit(True).alias("known"))
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


def positions_of(positions: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    return of_ids(positions.select("entity_id", "x", "y"), "entity_id", ids)
