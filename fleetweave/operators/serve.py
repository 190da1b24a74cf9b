"""Serving: id ranges, retrieval within a budget, host order, references, Jaccard similarity, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetweave.session import cut


def id_ranges(ids: DataFrame, name: str) -> DataFrame:
    """(prefix, width, first, last, n): runs of consecutive numbers behind equal prefixes of equal width; ids without a
    number at the end, or with one of more than 37 digits, are in no run."""
    p = ids.select(F.regexp_extract(name, r"^(.*?)(\d+)$", 1).alias("prefix"), F.regexp_extract(name, r"^(.*?)(\d+)$", 2).alias("d")).where("d <> '' and length(d) <= 37").distinct()
    p = p.select("prefix", F.length("d").cast("long").alias("width"), F.col("d").cast("decimal(38,0)").alias("v"))
    w = Window.partitionBy("prefix", "width").orderBy("v")
    return p.withColumn("island", F.col("v") - F.row_number().over(w)).groupBy("prefix", "width", "island").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("n")).drop("island")


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """The ids of the ranges again."""
    step = F.explode(F.sequence(F.lit(0), F.expr("cast(n - 1 as int)"))).alias("k")
    return ranges.select("prefix", "width", "first", step).select(F.concat("prefix", F.expr("lpad(cast(first + k as string), cast(width as int), '0')")).alias("id"))


def ranked(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """The rows with their place from 0 on: ranges are sorted each by itself, and the numbers of rows before them, one a
    range, are added. The ranges are written, for their borders come from a sample."""
    parts = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = parts.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    k = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return parts.withColumn(name, k.cast("long")).join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def fits(costs: DataFrame, cost: str, limit: float, place: str = "place", size: int = 100_000) -> DataFrame:
    """The rows, with ``used``, before the first whose running sum of costs is above the limit: sums of ranges of places carry over."""
    ranges = costs.withColumn("_range", F.floor(F.col(place) / size))
    before = ranges.groupBy("_range").agg(F.sum(cost).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    used = F.sum(cost).over(Window.partitionBy("_range").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("used", used).join(before, "_range").withColumn("used", F.col("used") + F.col("_before")).drop("_range", "_before").where(F.col("used") <= limit)


def budget(rows: DataFrame, order: list, cost: str, limit: int, slack: float = 0.05) -> DataFrame:
    """Rows in order until one would overdraw the budget by more than the slack; that one and all later ones are out."""
    return fits(ranked(rows, order), cost, limit * (1 + slack)).drop("place")


def jaccard_pairs(sets: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """(a, b, jaccard) of all pairs of keys whose sets reach ``least``, which must be above 0; null items don't count.

    Equal sets are one until the end. A pair of that similarity shares one of the first items of either set, items in
    order from the rarest, so only those bring sets together (prefix filter), and only sets of near enough size.
    """
    bag = sets.select(F.col(key).alias("k"), F.col(item).alias("i")).where("i is not null").distinct()
    freq = bag.groupBy("i").agg(F.count("*").alias("f"))
    whole = bag.join(freq, "i").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("items")).withColumn("s", F.sha2(F.to_json(F.transform("items", lambda x: x["i"])), 256))
    whole = cut(whole)
    one = whole.groupBy("s").agg(F.first("items").alias("items")).withColumn("n", F.size("items"))
    first = one.select("s", "n", "items", F.explode(F.slice("items", F.lit(1), F.expr(f"n - cast(ceil({least} * n - 1e-9) as int) + 1"))).alias("p"))
    left, right = first.select(F.col("s").alias("sa"), F.col("n").alias("na"), "p"), first.select(F.col("s").alias("sb"), F.col("n").alias("nb"), "p")
    near = left.join(right, "p").where(f"sa < sb and na >= {least} * nb - 1e-9 and nb >= {least} * na - 1e-9").select("sa", "sb").distinct()
    one = one.withColumn("items", F.transform("items", lambda x: x["i"]))  # plain values intersect by hash
    both = near.join(one.select(F.col("s").alias("sa"), F.col("items").alias("x"), F.col("n").alias("na")), "sa").join(one.select(F.col("s").alias("sb"), F.col("items").alias("y"), F.col("n").alias("nb")), "sb")
    like = both.withColumn("common", F.size(F.array_intersect("x", "y"))).select("sa", "sb", F.round(F.expr("common / (na + nb - common)"), 6).alias("jaccard")).where(f"jaccard >= {least}")
    same = whole.select(F.col("s").alias("sa"), F.col("s").alias("sb"), F.lit(1.0).alias("jaccard")).distinct()
    keys = lambda c, n: whole.select(F.col("s").alias(c), F.col("k").alias(n))
    out = like.unionByName(same).join(keys("sa", "a"), "sa").join(keys("sb", "b"), "sb")
    return out.where("a <> b and (sa <> sb or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def value_groups(leaves: DataFrame) -> DataFrame:
    """(section, path, value, n, ids): values that two entities or more share, but not all, with the entities in order."""
    size = leaves.groupBy("section").agg(F.countDistinct("entity_id").alias("total"))
    each = leaves.groupBy("section", "path", "value").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))
    return each.join(size, "section").where("n >= 2 and n < total").drop("total")
