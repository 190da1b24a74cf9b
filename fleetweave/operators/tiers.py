"""Tiers of a factored fleet: templates of composites, Tier C, reconstruction, invariants, projections, overviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetweave.functions.values import glob_regex
from fleetweave.operators.hierarchy import Hierarchy

MAP, LIST = "map<string,map<string,string>>", "array<map<string,string>>"

# templates of composites


def map_templates(typed: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(templates (type_id, path, template_id, content), deltas (type_id, entity_id, path, entry, delta)) of map composites.

    A template holds the keys that ``share`` of all entries have, each with its commonest value (the first entry, by
    entity and name, decides ties). A delta holds an entry's keys that differ, null for those it lacks.
    """
    entries = typed.where("attr_type = 'map'").select("type_id", "entity_id", "path", F.explode(F.from_json("value", MAP)).alias("entry", "m"))
    n = entries.groupBy("type_id", "path").agg(F.count("*").alias("entries")).where("entries >= 2")
    each = entries.select("type_id", "path", "entity_id", "entry", F.explode("m").alias("k", "v"))
    counts = each.groupBy("type_id", "path", "k", "v").agg(F.count("*").alias("c"), F.min(F.struct("entity_id", "entry")).alias("first"))
    best = counts.groupBy("type_id", "path", "k").agg(F.sum("c").alias("present"), F.min(F.struct((-F.col("c")).alias("m"), "first", "v")).alias("b"))
    keys = best.join(n, ["type_id", "path"]).where(f"present >= entries * {share}").select("type_id", "path", "k", "b.v")
    content = keys.groupBy("type_id", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("content"))
    templates = content.select("type_id", "path", F.concat_ws(".", "type_id", "path", F.lit("T0")).alias("template_id"), "content")
    both = entries.join(templates.drop("template_id"), ["type_id", "path"])
    changed = "map_filter(m, (k, v) -> not (v <=> try_element_at(content, k)))"
    gone = "transform_values(map_filter(content, (k, v) -> not map_contains_key(m, k)), (k, v) -> cast(null as string))"
    return templates, both.select("type_id", "entity_id", "path", "entry", F.expr(f"map_concat({changed}, {gone})").alias("delta"))


def map_values(templates: DataFrame, deltas: DataFrame) -> DataFrame:
    """(type_id, entity_id, path, value) of ``map_templates``: the inverse, as JSON with sorted entries and keys."""
    both = deltas.join(templates.drop("template_id"), ["type_id", "path"])
    whole = "map_filter(map_concat(map_filter(content, (k, v) -> not map_contains_key(delta, k)), delta), (k, v) -> v is not null)"
    merged = both.select("type_id", "entity_id", "path", "entry", F.expr(f"map_from_entries(array_sort(map_entries({whole})))").alias("m"))
    entry = F.array_sort(F.collect_list(F.struct("entry", "m")), lambda a, b: F.when(a["entry"] < b["entry"], -1).otherwise(1))
    return merged.groupBy("type_id", "entity_id", "path").agg(F.to_json(F.map_from_entries(entry)).alias("value"))


def list_templates(typed: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(templates (type_id, path, template_id, value), references (type_id, entity_id, path, template_id)): each list that
    ``least`` entities have is a template, numbered in the order of values; entities without one keep their list."""
    lists = typed.where("attr_type = 'list'")
    common = lists.groupBy("type_id", "path", "value").agg(F.count("*").alias("n")).where(f"n >= {least}")
    k = F.row_number().over(Window.partitionBy("type_id", "path").orderBy("value")) - 1
    templates = common.withColumn("k", k).select("type_id", "path", F.concat(F.concat_ws(".", "type_id", "path", F.lit("T")), "k").alias("template_id"), "value")
    return templates, lists.join(templates, ["type_id", "path", "value"]).select("type_id", "entity_id", "path", "template_id")


def with_references(typed: DataFrame, references: DataFrame) -> DataFrame:
    """The attributes with values replaced by template ids, of type composite_template_ref; to be profiled again."""
    out = typed.join(references, ["type_id", "entity_id", "path"], "left")
    return out.withColumn("attr_type", F.when(F.col("template_id").isNull(), F.col("attr_type")).otherwise("composite_template_ref")).withColumn("value", F.coalesce("template_id", "value")).drop("template_id")


def expand_references(attrs: DataFrame, templates: DataFrame) -> DataFrame:
    """(type_id, entity_id, path, value) with references replaced by what they stand for."""
    t = templates.select(F.col("template_id").alias("value"), F.col("value").alias("content"))
    return attrs.join(t, "value", "left").select("type_id", "entity_id", "path", F.coalesce("content", "value").alias("value"))


# Tier C


@dataclass
class TierC:
    """phone_book and instance_attrs (type_id, entity_id, path, value), relations (entity_id, label, target),
    assignments, overrides as in the hierarchy, foreign_keys (always empty)."""

    members: DataFrame
    sub_members: DataFrame
    phone_book: DataFrame
    instance_attrs: DataFrame
    relations: DataFrame
    overrides: DataFrame
    foreign_keys: DataFrame


def tier_c(typed: DataFrame, profiles: DataFrame, h: Hierarchy, relations: DataFrame | None = None) -> TierC:
    """What classes don't hold: values of role C by storage, relationships, assignments and overrides."""
    spark = typed.sparkSession
    where = profiles.where("role = 'C'").select("type_id", "path", "storage")
    c = typed.join(where, ["type_id", "path"]).select("type_id", "entity_id", "path", "value", "storage")
    none = lambda schema: spark.createDataFrame([], schema)
    return TierC(
        h.members,
        h.sub_members if h.sub_members is not None else none("type_id string, entity_id string, subclass string"),
        c.where("storage = 'PHONE_BOOK'").drop("storage"), c.where("storage = 'INSTANCE_ATTRS'").drop("storage"),
        relations.select(F.col("src").alias("entity_id"), "label", F.col("dst").alias("target")).distinct() if relations is not None else none("entity_id string, label string, target string"),
        h.overrides if h.overrides is not None else none("type_id string, entity_id string, owner string, path string, op string, value string"),
        none("type_id string, path string, target_type string"),
    )


LAYERS = ("base", "class", "subclass", "override", "instance", "phone_book")


def layers(h: Hierarchy, c: TierC) -> DataFrame:
    """(type_id, entity_id, path, value, op, rank, layer): what every layer says about every entity."""
    row = lambda df, rank: df.select("type_id", "entity_id", "path", "value", "op" if "op" in df.columns else F.lit("set").alias("op"), F.lit(rank).alias("rank"), F.lit(LAYERS[rank]).alias("layer"))
    out = row(c.members.join(h.base, "type_id"), 0)
    out = out.unionByName(row(c.members.join(h.classes, ["type_id", "class"]), 1))
    if h.subclasses is not None:
        out = out.unionByName(row(c.sub_members.join(h.subclasses, ["type_id", "subclass"]), 2))
    for rank, df in ((3, c.overrides), (4, c.instance_attrs), (5, c.phone_book)):
        out = out.unionByName(row(df, rank))
    return out


def layered_view(h: Hierarchy, c: TierC, templates: DataFrame | None = None) -> DataFrame:
    """(type_id, entity_id, path, value, layer): the highest layer that says anything decides; absent paths go; a template
    reference shows the template, its layer then is template."""
    top = layers(h, c).groupBy("type_id", "entity_id", "path").agg(F.max_by(F.struct("value", "op", "layer"), "rank").alias("t")).where("t.op = 'set'")
    out = top.select("type_id", "entity_id", "path", F.col("t.value").alias("value"), F.col("t.layer").alias("layer"))
    if templates is None:
        return out
    t = templates.select("type_id", "path", F.col("template_id").alias("value"), F.col("value").alias("content"))
    return out.join(t, ["type_id", "path", "value"], "left").select("type_id", "entity_id", "path", F.coalesce("content", "value").alias("value"), F.when(F.col("content").isNull(), F.col("layer")).otherwise("template").alias("layer"))


def reconstitute(h: Hierarchy, c: TierC, templates: DataFrame | None = None, map_deltas: DataFrame | None = None) -> DataFrame:
    """(type_id, entity_id, path, value) of all entities from the layers, templates and the deltas of maps."""
    out = layered_view(h, c, templates).drop("layer")
    return out if map_deltas is None else out.unionByName(map_deltas)


def mismatches(typed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(entity_id, path, want, got) where attributes and reconstruction differ, null-safe: none proves it lossless."""
    want = typed.select("entity_id", "path", F.col("value").alias("want"))
    return want.join(rebuilt.select("entity_id", "path", F.col("value").alias("got")), ["entity_id", "path"], "full_outer").where("not (want <=> got)")


def relation_mismatches(relations: DataFrame, c: TierC) -> DataFrame:
    """(entity_id, label, target, missing) of relationships on one side only."""
    a = relations.select(F.col("src").alias("entity_id"), "label", F.col("dst").alias("target")).distinct()
    return a.exceptAll(c.relations).withColumn("missing", F.lit(True)).unionByName(c.relations.exceptAll(a).withColumn("missing", F.lit(False)))


INVARIANTS = ("MultiClassAssignment", "ClassCoverage", "SubclassOrphan", "MultiSubclassAssignment", "DepthViolation", "InvalidOverrideOwner", "PhoneBookDense", "DuplicateCPathEncoding")


def invariants(types: DataFrame, h: Hierarchy, c: TierC, profiles: DataFrame) -> DataFrame:
    """(rule, type_id, subject) of each broken structural rule; none on sound data."""
    subs = h.subclasses.select("type_id", "subclass", "parent").distinct() if h.subclasses is not None else types.sparkSession.createDataFrame([], "type_id string, subclass string, parent string")
    broken = lambda rule, df, subject: df.select(F.lit(rule).alias("rule"), "type_id", F.col(subject).cast("string").alias("subject"))
    twice = lambda df: df.groupBy("type_id", "entity_id").agg(F.count("*").alias("n")).where("n > 1")
    own = c.members.select("type_id", "entity_id").distinct()
    every = types.select("type_id", "entity_id")
    outside = every.join(own, ["type_id", "entity_id"], "left_anti").unionByName(own.join(every, ["type_id", "entity_id"], "left_anti"))
    placed = c.sub_members.join(subs, ["type_id", "subclass"], "left")
    orphans = placed.join(c.members.select("type_id", "entity_id", F.col("class").alias("parent")), ["type_id", "entity_id", "parent"], "left_anti")
    names = c.members.select("type_id", F.col("class").alias("owner")).unionByName(h.classes.select("type_id", F.col("class").alias("owner"))).unionByName(subs.select("type_id", F.col("subclass").alias("owner"))).distinct()
    columns = profiles.where("storage = 'PHONE_BOOK'").groupBy("type_id").agg(F.count("*").alias("columns"))
    cells = c.phone_book.groupBy("type_id", "entity_id").agg(F.count("*").alias("cells"))
    sparse = every.join(columns, "type_id").join(cells, ["type_id", "entity_id"], "left").where("not (columns <=> cells)").select("type_id", "entity_id").unionByName(cells.join(columns, "type_id", "left_anti").select("type_id", "entity_id"))
    parts = (
        broken("MultiClassAssignment", twice(c.members), "entity_id"), broken("ClassCoverage", outside, "entity_id"), broken("SubclassOrphan", orphans, "entity_id"),
        broken("MultiSubclassAssignment", twice(c.sub_members), "entity_id"),
        broken("DepthViolation", subs.join(subs.select("type_id", F.col("subclass").alias("parent")).distinct(), ["type_id", "parent"], "left_semi"), "subclass"),
        broken("InvalidOverrideOwner", c.overrides.join(names, ["type_id", "owner"], "left_anti"), "entity_id"), broken("PhoneBookDense", sparse, "entity_id"),
        broken("DuplicateCPathEncoding", c.instance_attrs.join(c.phone_book.select("type_id", "path").distinct(), ["type_id", "path"], "left_semi"), "entity_id"),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# overviews


def tier_a(h: Hierarchy, c: TierC) -> DataFrame:
    """(type_id, entities, classes, subclasses, base_only_ratio): a row a type, the ratio to four places."""
    per = c.members.groupBy("type_id").agg(F.count("*").alias("entities"), F.count_distinct(F.expr("if(class = '_base_only', null, class)")).alias("classes"), F.round(F.count_if(F.expr("class = '_base_only'")) / F.count("*"), 4).alias("base_only_ratio"))
    subs = c.sub_members.groupBy("type_id").agg(F.count_distinct("subclass").alias("subclasses"))
    return per.join(subs, "type_id", "left").select("type_id", "entities", "classes", F.coalesce("subclasses", F.lit(0)).cast("long").alias("subclasses"), "base_only_ratio")


def tier_a_with_spec(overview: DataFrame, spec: DataFrame) -> DataFrame:
    """The overview with summaries and key differentiators (type_id, summary, guide) of a specification; types without one have nulls."""
    return overview.join(spec.select("type_id", "summary", "guide"), "type_id", "left")


def topology(relations: DataFrame, types: DataFrame) -> DataFrame:
    """(src_type, label, dst_type): which types refer to which others; a type's references to itself are left out."""
    src = relations.join(types.select(F.col("entity_id").alias("src"), F.col("type_id").alias("src_type")), "src")
    both = src.join(types.select(F.col("entity_id").alias("dst"), F.col("type_id").alias("dst_type")), "dst")
    return both.where("src_type <> dst_type").select("src_type", "label", "dst_type").distinct()


def tier_b_json(h: Hierarchy) -> DataFrame:
    """(type_id, json): base, classes and subclasses of a type as one document with sorted keys."""
    attrs = lambda df, keys: df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("attrs"))
    base = attrs(h.base, ["type_id"]).select("type_id", F.col("attrs").alias("base"))
    by = lambda name, of: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, of)), lambda a, b: F.when(a[name] < b[name], -1).otherwise(1)))
    classes = attrs(h.classes, ["type_id", "class"]).groupBy("type_id").agg(by("class", "attrs").alias("classes"))
    out = base.join(classes, "type_id", "full_outer")
    if h.subclasses is not None:
        subs = attrs(h.subclasses, ["type_id", "subclass", "parent"]).withColumn("body", F.struct("parent", "attrs")).groupBy("type_id").agg(by("subclass", "body").alias("subclasses"))
        out = out.join(subs, "type_id", "full_outer")
    return out.select("type_id", F.to_json(F.struct(*(c for c in out.columns if c != "type_id"))).alias("json"))


def type_stats(h: Hierarchy, c: TierC, profiles: DataFrame) -> DataFrame:
    """(type_id, base_attrs, class_attrs, overrides, relations, phone_book_paths): counts a type."""
    count = lambda df, name: df.groupBy("type_id").agg(F.count("*").alias(name))
    out = c.members.select("type_id").distinct()
    rel = c.relations.join(c.members, "entity_id")
    for df, name in ((h.base, "base_attrs"), (h.classes, "class_attrs"), (c.overrides, "overrides"), (rel, "relations"), (profiles.where("storage = 'PHONE_BOOK'"), "phone_book_paths")):
        out = out.join(count(df, name), "type_id", "left")
    return out.na.fill(0)


# projections


@dataclass(frozen=True)
class Subject:
    name: str
    include: tuple[str, ...]
    related: tuple[str, ...] = ()

    def regex(self) -> str:
        return "|".join(f"({glob_regex(g)})" for g in (*self.include, *self.related))


def hierarchy_paths(h: Hierarchy, c: TierC) -> DataFrame:
    """(type_id, path): every path of Tier B and C."""
    out = h.base.select("type_id", "path")
    for df in (h.classes, h.subclasses, c.overrides, c.instance_attrs, c.phone_book):
        out = out if df is None else out.unionByName(df.select("type_id", "path"))
    return out.distinct()


def project(h: Hierarchy, c: TierC, subject: Subject) -> tuple[Hierarchy, TierC]:
    """The tiers of one subject: attributes whose path matches; classes without any left go, their members to
    _base_only; a subclass goes with its parent, or if it has no attribute left."""
    keep = F.col("path").rlike(subject.regex())
    classes = h.classes.where(keep)
    left = classes.select("type_id", "class").distinct().withColumn("there", F.lit(True))
    members = c.members.join(left, ["type_id", "class"], "left").select("type_id", "entity_id", F.when(F.col("there"), F.col("class")).otherwise("_base_only").alias("class"))
    subs, sub_members = h.subclasses, c.sub_members
    if subs is not None:
        shown = left.select("type_id", F.col("class").alias("parent")).unionByName(members.select("type_id", F.lit("_base_only").alias("parent")).distinct()).distinct()
        subs = subs.where(keep).join(shown, ["type_id", "parent"], "left_semi")
        sub_members = sub_members.join(subs.select("type_id", "subclass").distinct(), ["type_id", "subclass"], "left_semi")
    overrides = c.overrides.where(keep)
    # what a hidden subclass said of its members becomes an override, so nothing of the subject is lost
    if h.subclasses is not None:
        lost = c.sub_members.join(sub_members, ["type_id", "entity_id", "subclass"], "left_anti").join(h.subclasses.where(keep), ["type_id", "subclass"])
        said = overrides.select("type_id", "entity_id", "path")
        overrides = overrides.unionByName(lost.join(said, ["type_id", "entity_id", "path"], "left_anti").select("type_id", "entity_id", F.lit("_base_only").alias("owner"), "path", F.lit("set").alias("op"), "value"))
    out = Hierarchy(h.base.where(keep), classes, members, subs, sub_members, overrides)
    return out, TierC(members, sub_members, c.phone_book.where(keep), c.instance_attrs.where(keep), c.relations, overrides, c.foreign_keys)


def projection_errors(whole: DataFrame, part: DataFrame, subject: Subject) -> DataFrame:
    """(entity_id, path, want, got) where a projection's view (entity_id, path, value) isn't the whole one's of its paths."""
    return mismatches(whole.where(F.col("path").rlike(subject.regex())), part)
