"""Factoring: signatures, identity fields, majority classes, deltas, overlay and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signature_groups(leaves: DataFrame) -> DataFrame:
    """Entities of equal (path, type, value) sets: (signature, n_entities, first_entity). The signature is JSON, so no mark in a path or value can be taken for another."""
    sig = leaves.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list(F.to_json(F.array("path", "value_type", "value")))), ",").alias("signature"))
    return sig.groupBy("signature").agg(F.count("*").alias("n_entities"), F.min("entity_id").alias("first_entity"))


def identity_fields(leaves: DataFrame, group: str) -> DataFrame:
    """Paths that all entities of a group have, each with a value of its own."""
    size = leaves.groupBy(group).agg(F.countDistinct("entity_id").alias("total"))
    per = leaves.groupBy(group, "path").agg(F.count("*").alias("n"), F.countDistinct("value").alias("d"))
    return per.join(size, group).where("n = total and d = total and total >= 2").select(group, "path", "n")


def majority(leaves: DataFrame, group: str, threshold: int = 100) -> DataFrame:
    """(group, path, value, n): the commonest value of paths all entities have, if enough have it; the first entity decides ties."""
    size = leaves.groupBy(group).agg(F.countDistinct("entity_id").alias("total"))
    each = leaves.groupBy(group, "path", "value").agg(F.count("*").alias("n"), F.min("entity_id").alias("first"))
    w = Window.partitionBy(group, "path")
    best = each.withColumn("present", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "first"))).where("rn = 1")
    return best.join(size, group).where(f"present = total and n >= greatest(1, total * {threshold} div 100)").select(group, "path", "value", "n")


def universal(leaves: DataFrame, group: str) -> DataFrame:
    """Paths with one value on every entity of the group: the base class."""
    return majority(leaves, group, 100).select(group, "path", "value")


def deltas(leaves: DataFrame, classes: DataFrame, group: str) -> DataFrame:
    """(entity_id, path, op, value) against the class of the entity's group: what differs is set, what lacks is absent."""
    ids = leaves.select(group, "entity_id").distinct()
    want = ids.join(classes.select(group, "path", F.col("value").alias("want")), group)
    both = leaves.select(group, "entity_id", "path", "value").join(want, [group, "entity_id", "path"], "full_outer")
    return both.where("not (value <=> want)").select("entity_id", "path", F.when(F.col("value").isNull(), "absent").otherwise("set").alias("op"), "value")


def overlay(leaves: DataFrame, classes: DataFrame, delta: DataFrame, group: str) -> DataFrame:
    """(entity_id, path, value, layer): class values, overridden by deltas; an absent path goes."""
    ids = leaves.select(group, "entity_id").distinct()
    low = ids.join(classes, group).select("entity_id", "path", "value", F.lit("set").alias("op"), F.lit(0).alias("rank"), F.lit("class").alias("layer"))
    high = delta.select("entity_id", "path", "value", "op", F.lit(1).alias("rank"), F.lit("delta").alias("layer"))
    top = low.unionByName(high).groupBy("entity_id", "path").agg(F.max_by(F.struct("value", "op", "layer"), "rank").alias("t"))
    return top.where("t.op = 'set'").select("entity_id", "path", F.col("t.value").alias("value"), F.col("t.layer").alias("layer"))


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Null-safe full outer comparison of (entity_id, path, value)."""
    both = a.select("entity_id", "path", F.col("value").alias("left_value")).join(b.select("entity_id", "path", F.col("value").alias("right_value")), ["entity_id", "path"], "full_outer")
    return both.where("not (left_value <=> right_value)")


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose numbers differ, with the surplus of a over b: one aggregation of signed counts."""
    both = a.select(*columns, F.lit(1).alias("s")).unionByName(b.select(*columns, F.lit(-1).alias("s")))
    return both.groupBy(*columns).agg(F.sum("s").alias("surplus")).where("surplus <> 0")
