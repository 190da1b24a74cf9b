"""Relationships: by hints, by name, by known references, and lookups in class assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hinted(attrs: DataFrame, hints: list[tuple[str, str, str]]) -> DataFrame:
    """(src, label, dst): entities whose source field equals another's target field, for hints (source, target, label).

    A hash join on hint and value; an entity doesn't refer to itself. Where one value is on very many entities of both
    sides, ``hinted_groups`` keeps the result in proportion to the entities.
    """
    spec = attrs.sparkSession.createDataFrame([(k, *h) for k, h in enumerate(hints)], "hint int, source string, target string, label string")
    side = lambda c, name: attrs.join(F.broadcast(spec), F.col("path") == F.col(c)).select("hint", "label", "value", F.col("entity_id").alias(name))  # noqa: E731  (a specification)
    return side("source", "src").join(side("target", "dst").drop("label"), ["hint", "value"]).where("src <> dst").select("src", "label", "dst").distinct()


def hinted_groups(attrs: DataFrame, hints: list[tuple[str, str, str]]) -> DataFrame:
    """(label, value, sources, targets): a row a hint and value with the number of entities of either side, without making the pairs."""
    spec = attrs.sparkSession.createDataFrame([(k, *h) for k, h in enumerate(hints)], "hint int, source string, target string, label string")
    side = lambda c, name: attrs.join(F.broadcast(spec), F.col("path") == F.col(c)).groupBy("hint", "label", "value").agg(F.count_distinct("entity_id").alias(name))
    return side("source", "sources").join(side("target", "targets").drop("label"), ["hint", "value"]).select("label", "value", "sources", "targets")


def named(members: DataFrame, names: DataFrame, key: str, label: str) -> DataFrame:
    """(src, label, dst) of lists of keys (entity_id, members): each member's display name (key, name); unknown keys are left out."""
    each = members.select("entity_id", F.explode("members").alias(key))
    return each.join(names, key).select(F.col("entity_id").alias("src"), F.lit(label).alias("label"), F.col("name").alias("dst")).distinct()


def known(attrs: DataFrame, paths: list[str], entities: DataFrame, label: str, separator: str = r",\s*") -> DataFrame:
    """(src, label, dst): the names in comma lists that are entities, by a semi join."""
    each = attrs.where(F.col("path").isin(paths)).select(F.col("entity_id").alias("src"), F.lit(label).alias("label"), F.explode(F.split("value", separator)).alias("dst")).where("dst <> ''")
    return each.join(entities.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "label", "dst").distinct()


def unknown(attrs: DataFrame, paths: list[str], entities: DataFrame, separator: str = r",\s*") -> DataFrame:
    """(src, dst): the names that are no entity."""
    each = attrs.where(F.col("path").isin(paths)).select(F.col("entity_id").alias("src"), F.explode(F.split("value", separator)).alias("dst")).where("dst <> ''")
    return each.join(entities.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_anti").distinct()


def class_of(entities: DataFrame, members: DataFrame, sub_members: DataFrame) -> DataFrame:
    """(entity_id, class, subclass) of the entities asked for; nulls for what they aren't in."""
    asked = entities.select("entity_id").distinct()
    return asked.join(members.select("entity_id", "class"), "entity_id", "left").join(sub_members.select("entity_id", "subclass"), "entity_id", "left")


def anti_unify(attrs: DataFrame, pairs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(a, b, common, variables) for pairs of entities: paths on which they agree, and all others.

    With ``paths`` (path) only those are looked at, and one that both lack is a variable too; without, those that either has.
    """
    some = attrs if paths is None else attrs.join(paths.select("path").distinct(), "path", "left_semi")
    side = lambda of: pairs.select("a", "b").distinct().join(some.select(F.col("entity_id").alias(of), "path", F.col("value").alias(f"v{of}")), of)
    both = side("a").join(side("b"), ["a", "b", "path"], "full_outer").groupBy("a", "b").agg(F.count_if(F.expr("va = vb")).alias("common"), F.count("*").alias("seen"))
    out = pairs.select("a", "b").distinct().join(both, ["a", "b"], "left").na.fill(0)
    if paths is None:
        return out.select("a", "b", "common", (F.col("seen") - F.col("common")).alias("variables"))
    n = paths.select("path").distinct().agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(n)).select("a", "b", "common", (F.col("n") - F.col("common")).alias("variables"))  # n is one row
