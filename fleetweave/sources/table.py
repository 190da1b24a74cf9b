"""Tables as fleets: a row is an entity, a column an attribute; leaves are (entity_id, section, path, value_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.values import as_text, value_type


def leaves(df: DataFrame, key: str, paths: list[str], section: str, keep: list[str] | None = None) -> DataFrame:
    """One narrow pass: an array of structs a row, exploded. Null values are absent."""
    kinds = dict(df.dtypes)
    each = [F.struct(F.lit(p).alias("path"), F.lit(value_type(kinds[p])).alias("value_type"), as_text(p, kinds[p]).alias("value")) for p in paths]
    out = df.select(F.col(key).cast("string").alias("entity_id"), *(keep or []), F.inline(F.array(*each)))
    return out.where("value is not null").select("entity_id", F.lit(section).alias("section"), *(keep or []), "path", "value_type", "value")
