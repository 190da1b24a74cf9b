"""Sections of hosts factored into classes, lossless: exact groups, one class for all, nearest class, lists, and the inverse.

Leaves are (host, section, shape, path, value_type, value) as ``sources.documents.section_leaves`` makes them; two
values are equal if type and value are. All sections go through one plan, the section being the leading key; nothing
loops over sections or hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetweave.session import cut, few

THRESHOLD, MAX_DELTA_PCT, MIN_GROUP = 100, 20.0, 3
SAME = ["path", "value_type", "value"]


def class_name(section: Column, index: Column) -> Column:
    """The section's words with capitals, and the number of the class unless it is the first."""
    return F.concat(F.replace(F.initcap(F.replace(section, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), F.when(index > 0, F.concat(F.lit("_"), index.cast("string"))).otherwise(""))


def signature(*keys: str) -> list[Column]:
    """A hash and the number of a group's distinct leaves: equal for equal sets, whatever marks paths and values hold."""
    leaf = F.to_json(F.array(*(F.col(c) for c in SAME)))
    return [F.sha2(F.array_join(F.sort_array(F.collect_list(leaf)), "\n"), 256).alias("sig"), F.count("*").alias("n_leaves")]


def identity(leaves: DataFrame, keys: list[str], member: str = "host", least: int = 2) -> DataFrame:
    """(keys, path): paths that all members of a group have, each with a value of its own; of groups of two or more."""
    size = leaves.groupBy(*keys).agg(F.count_distinct(member).alias("total"))
    per = leaves.groupBy(*keys, "path").agg(F.count("*").alias("n"), F.count_distinct("value_type", "value").alias("d"))
    return per.join(size, keys).where(f"n = total and d = total and total >= {least}").select(*keys, "path")


def majority(leaves: DataFrame, keys: list[str], threshold: int = THRESHOLD, member: str = "host") -> DataFrame:
    """(keys, path, value_type, value, n): the commonest value of paths that all members have, if ``threshold`` percent have it; the first member decides ties."""
    size = leaves.groupBy(*keys).agg(F.count_distinct(member).alias("total"))
    each = leaves.groupBy(*keys, *SAME).agg(F.count("*").alias("n"), F.min(member).alias("first"))
    best = each.groupBy(*keys, "path").agg(F.sum("n").alias("present"), F.min(F.struct((-F.col("n")).alias("m"), "first", "value_type", "value")).alias("b"))
    return best.join(size, keys).select(*keys, "path", "b.value_type", "b.value", (-F.col("b.m")).alias("n"), "present", "total").where(f"present = total and n >= greatest(1, floor(total * {threshold} / 100))").drop("present", "total")


@dataclass
class Factored:
    """classes (section, class, index, path, value_type, value); identities (section, class, path);
    members (section, host, class), class null for raw; deltas (section, host, path, value_type, value, kind), kind
    identity, changed, added or raw."""

    classes: DataFrame
    identities: DataFrame
    members: DataFrame
    deltas: DataFrame


def assign(small: DataFrame, classes: DataFrame, identities: DataFrame, max_delta_pct: float = MAX_DELTA_PCT) -> DataFrame:
    """(section, host, class, cost): the class that takes fewest entries to correct, the first one on ties.

    A host must have all fields and identity fields of the class; a field that differs or that only the host has costs
    1, and the cost may be ``max_delta_pct`` percent of the class's fields at most. Within that limit a host shares
    values with the class, so pairs come from an equi-join on (path, value) unless the limit is 100 or more.
    """
    field = classes.select("section", "class", "index", "path", F.col("value_type").alias("want_type"), F.col("value").alias("want"))
    size = field.groupBy("section", "class", "index").agg(F.count("*").alias("n_class"))
    idents = identities.groupBy("section", "class").agg(F.count("*").alias("n_ident"))
    size = size.join(idents, ["section", "class"], "left").na.fill(0, ["n_ident"])
    mine = small.groupBy("section", "host").agg(F.count("*").alias("n_host"))
    if max_delta_pct < 100:
        pairs = small.join(field.withColumnRenamed("want_type", "value_type").withColumnRenamed("want", "value"), ["section", *SAME]).groupBy("section", "host", "class").agg(F.count("*").alias("same"))
        pairs = pairs.join(size, ["section", "class"]).where(f"(n_class - same) * 100 <= {max_delta_pct} * (n_class + n_ident)")
    else:
        pairs = mine.select("section", "host").join(size, "section").withColumn("same", F.lit(0))
    pairs = pairs.select("section", "host", "class", "index", "n_class", "n_ident")
    both = pairs.join(field.drop("index"), ["section", "class"]).join(small, ["section", "host", "path"]).groupBy("section", "host", "class", "index", "n_class", "n_ident").agg(F.count("*").alias("shared"), F.count_if(F.expr("value_type = want_type and value = want")).alias("same"))
    held = pairs.join(identities, ["section", "class"]).join(small.select("section", "host", "path"), ["section", "host", "path"]).groupBy("section", "host", "class").agg(F.count("*").alias("held"))
    costs = both.join(held, ["section", "host", "class"], "left").na.fill(0, ["held"]).where("shared = n_class and held = n_ident").join(mine, ["section", "host"])
    costs = costs.withColumn("cost", F.expr("(shared - same) + (n_host - shared - held)")).where(f"cost * 100 <= {max_delta_pct} * (n_class + n_ident)")
    return costs.groupBy("section", "host").agg(F.min(F.struct("cost", "index", "class")).alias("b")).select("section", "host", F.col("b.class").alias("class"), F.col("b.cost").alias("cost"))


def _classes(leaves: DataFrame, threshold: int, min_group: int) -> tuple[DataFrame, ...]:
    """(leaves, hosts, taken, classes, identities) of ``factor``; hosts have the signature of their leaves, taken a class of equal ones."""
    # each table is read by several others, so it is written once
    leaves = cut(leaves.where("path <> ''"))
    hosts = cut(leaves.groupBy("section", "host").agg(*signature()))
    size = cut(hosts.groupBy("section").agg(F.count("*").alias("hosts")).where(f"hosts >= {min_group}"))
    exact = hosts.join(few(size), "section").groupBy("section", "sig").agg(F.count("*").alias("n"), F.min("host").alias("first")).where("n >= 2")
    exact = exact.withColumn("index", F.row_number().over(Window.partitionBy("section").orderBy("first")) - 1).withColumn("class", class_name(F.col("section"), F.col("index")))
    exact = cut(exact)
    taken = hosts.join(few(exact.select("section", "sig", "class")), ["section", "sig"]).select("section", "host", "class")
    fields = leaves.join(few(exact.select("section", "class", "index", F.col("first").alias("host"))), ["section", "host"]).select("section", "class", "index", *SAME)

    # sections without exact groups: one class
    other = leaves.join(few(size.select("section")), "section", "left_semi").join(few(exact.select("section").distinct()), "section", "left_anti")
    named = class_name(F.col("section"), F.lit(0))
    ident = identity(other, ["section"])
    one = majority(other.join(ident, ["section", "path"], "left_anti"), ["section"], threshold)
    enough = one.groupBy("section").agg(F.count("*").alias("n")).where("n >= 3").select("section")
    one = one.join(enough, "section", "left_semi").select("section", named.alias("class"), F.lit(0).alias("index"), *SAME)
    ident = ident.join(enough, "section", "left_semi").select("section", named.alias("class"), "path")

    return leaves, hosts, taken, cut(fields.unionByName(one)), ident


def classes(leaves: DataFrame, threshold: int = THRESHOLD, min_group: int = MIN_GROUP) -> DataFrame:
    """The classes of ``factor`` by themselves: no host is placed and nothing is held against its class."""
    return _classes(leaves, threshold, min_group)[3]


def factor(leaves: DataFrame, threshold: int = THRESHOLD, max_delta_pct: float = MAX_DELTA_PCT, min_group: int = MIN_GROUP) -> Factored:
    """Classes of dict sections: every set of leaves that two hosts or more share is one; where a section has none, one
    class of all its hosts, if that has three fields; other hosts go to their nearest class or stay raw."""
    leaves, hosts, taken, classes, ident = _classes(leaves, threshold, min_group)
    ident, taken = cut(ident), cut(taken)
    small = leaves.join(taken, ["section", "host"], "left_anti").join(few(classes.select("section").distinct()), "section", "left_semi")
    near = assign(small, classes, ident, max_delta_pct).select("section", "host", "class")
    assigned = taken.unionByName(near)
    members = cut(hosts.select("section", "host").join(assigned, ["section", "host"], "left"))

    mine = leaves.join(members, ["section", "host"])
    want = classes.select("section", "class", "path", F.col("value_type").alias("want_type"), F.col("value").alias("want"))
    marked = mine.join(few(want), ["section", "class", "path"], "left").join(few(ident).withColumn("is_identity", F.lit(True)), ["section", "class", "path"], "left")
    kind = F.expr("case when class is null then 'raw' when is_identity then 'identity' when want is null then 'added' when value_type = want_type and value = want then null else 'changed' end")
    deltas = marked.withColumn("kind", kind).where("kind is not null").select("section", "host", *SAME, "kind")
    return Factored(classes, ident, members, cut(deltas))


def rebuild(f: Factored) -> DataFrame:
    """(section, host, path, value_type, value): class fields that no delta replaces, and the deltas."""
    base = f.members.where("class is not null").join(f.classes.drop("index"), ["section", "class"]).select("section", "host", *SAME)
    return base.join(f.deltas, ["section", "host", "path"], "left_anti").unionByName(f.deltas.select("section", "host", *SAME))


def collapsed(f: Factored) -> DataFrame:
    """(host, sections): sections that are their first class without a delta, which one list of names replaces."""
    first = f.classes.where("index = 0").select("section", "class").distinct()
    plain = f.members.join(first, ["section", "class"]).join(f.deltas, ["section", "host"], "left_anti")
    return plain.groupBy("host").agg(F.array_sort(F.collect_set("section")).alias("sections"))


def differences(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("section", "host")) -> DataFrame:
    """(keys, path, left, right) where two sets of leaves differ; null-safe, with the type."""
    side = lambda df, n: df.select(*keys, "path", F.concat_ws("|", "value_type", "value").alias(n))
    return side(a, "left").join(side(b, "right"), [*keys, "path"], "full_outer").where("not (left <=> right)")


# lists of dicts


@dataclass
class FactoredLists:
    """classes (section, class, index, path, value_type, value); identities (section, path); instances (section, host,
    i, class), class null for raw; deltas (section, host, i, path, value_type, value); uniform (section, host): one class for all."""

    classes: DataFrame
    identities: DataFrame
    instances: DataFrame
    deltas: DataFrame
    uniform: DataFrame


def factor_lists(leaves: DataFrame, min_group: int = MIN_GROUP, least_fields: int = 3) -> FactoredLists:
    """Classes of list sections: instances of equal fields, identity fields left out, are a class if there are ``min_group``
    of them and they have ``least_fields`` fields; identity fields are told over all instances of a section."""
    at = leaves.select("section", "host", F.regexp_extract("path", r"^\[(\d+)\]", 1).cast("int").alias("i"), F.regexp_extract("path", r"^\[\d+\]\.(.*)$", 1).alias("path"), "value_type", "value")
    at = cut(at.withColumn("member", F.struct("host", "i")))
    ident = cut(identity(at, ["section"], "member"))
    rest = at.join(ident, ["section", "path"], "left_anti")
    sigs = rest.groupBy("section", "host", "i").agg(*signature())
    groups = sigs.groupBy("section", "sig").agg(F.count("*").alias("n"), F.min(F.struct("host", "i")).alias("first"), F.max("n_leaves").alias("fields")).where(f"n >= {min_group} and fields >= {least_fields}")
    groups = groups.withColumn("index", F.row_number().over(Window.partitionBy("section").orderBy("first")) - 1).withColumn("class", class_name(F.col("section"), F.col("index")))
    groups = cut(groups)
    classes = groups.select("section", "class", "index", F.col("first.host").alias("host"), F.col("first.i").alias("i")).join(rest, ["section", "host", "i"]).select("section", "class", "index", *SAME)
    every = at.select("section", "host", "i").distinct()
    instances = every.join(sigs.join(groups.select("section", "sig", "class"), ["section", "sig"]).select("section", "host", "i", "class"), ["section", "host", "i"], "left")
    instances = cut(instances)
    deltas = at.join(instances, ["section", "host", "i"]).join(ident.withColumn("own", F.lit(True)), ["section", "path"], "left").where("class is null or own").select("section", "host", "i", *SAME)
    uniform = instances.groupBy("section", "host").agg((F.count_distinct("class") == 1).alias("one"), F.bool_and(F.col("class").isNotNull()).alias("whole"), F.min("class").alias("class")).where("one and whole").select("section", "host", "class")
    return FactoredLists(classes, ident, instances, deltas, uniform)


def rebuild_lists(f: FactoredLists) -> DataFrame:
    """The leaves of ``factor_lists`` with paths [i].field; each instance by its own class, raw ones as they are."""
    base = f.instances.where("class is not null").join(f.classes.drop("index"), ["section", "class"]).select("section", "host", "i", *SAME)
    return base.unionByName(f.deltas).select("section", "host", F.concat(F.lit("["), "i", F.lit("]."), "path").alias("path"), "value_type", "value")


def profitable(f: Factored) -> DataFrame:
    """(section, class, raw, factored, keep): tokens of the members' leaves raw, and of class, references and deltas; a class
    that costs as much as it saves is to be dissolved."""
    cost = F.expr("length(path) / 4d + length(value) / 4d + 2")
    deltas = f.deltas.join(f.members, ["section", "host"]).where("class is not null").groupBy("section", "class").agg(F.sum(cost).alias("d"))
    body = f.classes.groupBy("section", "class").agg((F.sum(cost) + 8).alias("b"), F.sum(cost).alias("each"))
    refs = f.members.where("class is not null").groupBy("section", "class").agg(F.count("*").alias("n"))
    replaced = f.deltas.where("kind = 'changed'").join(f.members, ["section", "host"]).join(f.classes.select("section", "class", "path", F.expr("length(path) / 4d + length(value) / 4d + 2").alias("c")), ["section", "class", "path"]).groupBy("section", "class").agg(F.sum("c").alias("r"))
    out = body.join(refs, ["section", "class"]).join(deltas, ["section", "class"], "left").join(replaced, ["section", "class"], "left").na.fill(0.0, ["d", "r"])
    return out.select("section", "class", F.round(F.expr("n * each - r + d"), 4).alias("raw"), F.round(F.expr("b + n * 4 + d"), 4).alias("factored")).withColumn("keep", F.expr("factored < raw"))


def dissolve(f: Factored) -> Factored:
    """The same without unprofitable classes: their members' leaves become raw."""
    gone = cut(profitable(f).where("not keep").select("section", "class"))
    lost = f.members.join(gone, ["section", "class"], "left_semi").select("section", "host")
    raw = rebuild(f).join(lost, ["section", "host"], "left_semi").withColumn("kind", F.lit("raw"))
    members = f.members.join(lost.withColumn("lost", F.lit(True)), ["section", "host"], "left").select("section", "host", F.when(F.col("lost").isNull(), F.col("class")).alias("class"))
    return Factored(f.classes.join(gone, ["section", "class"], "left_anti"), f.identities.join(gone, ["section", "class"], "left_anti"), members, f.deltas.join(lost, ["section", "host"], "left_anti").unionByName(raw.select("section", "host", *SAME, "kind")))
