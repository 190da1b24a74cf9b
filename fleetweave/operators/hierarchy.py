"""Types, classes and subclasses of entities: seeding, refinement, greedy covers, archetypes.

Attributes are (entity_id, path, attr_type, value) with values as text keys; types are (entity_id, type_id). Loops run
over rounds, never over types or entities: a round treats all types at once, and its result is written. What one Python
task sees of a type are its distinct fingerprints or signatures, not its entities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetweave.operators.profile import profile
from fleetweave.session import cut


@dataclass(frozen=True)
class Config:
    least_support: int = 3
    bundle_size: int = 3
    least_subclass: int = 3
    subclass_tokens: int = 12
    class_tokens: int = 8
    reference_tokens: int = 4
    most_variables: int = 3
    least_cluster: int = 3
    least_jaccard: float = 0.4
    iterations: int = 5


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


# types


def clusters(sets: Iterator[tuple[str, list[str]]], least: float) -> Iterator[tuple[str, int]]:
    """(key, cluster) of key sets in order: each joins the most similar centroid of ``least`` similarity or more, the
    first on ties, which grows by it; else it begins a cluster."""
    centroids: list[frozenset] = []
    for key, paths in sets:
        own = frozenset(paths)
        best = max(((jaccard(own, c), -i) for i, c in enumerate(centroids)), default=(-1.0, 0))
        if best[0] >= least:
            at = -best[1]
            centroids[at] |= own
        else:
            at = len(centroids)
            centroids.append(own)
        yield key, at


def seed(attrs: DataFrame, hints: DataFrame | None = None, least: float = Config.least_jaccard) -> DataFrame:
    """(entity_id, type_id): the hint (entity_id, hint), or unknown-k by the similarity of path sets.

    Entities of equal path sets are one; the sets pass one task in order (most paths first, then the first entity),
    which holds the centroids only.
    """
    hints = hints if hints is not None else attrs.sparkSession.createDataFrame([], "entity_id string, hint string")
    known = attrs.select("entity_id").distinct().join(hints.where("hint is not null and hint <> ''"), "entity_id", "left")
    sets = attrs.join(known.where("hint is null").select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    sets = sets.withColumn("key", F.sha2(F.to_json("paths"), 256))
    distinct = sets.groupBy("key").agg(F.first("paths").alias("paths"), F.min("entity_id").alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, p) for f in frames for k, p in zip(f["key"], f["paths"]))
        out = list(clusters(rows, least))
        yield pd.DataFrame({"key": [k for k, _ in out], "cluster": [c for _, c in out]})

    found = distinct.repartition(1).sortWithinPartitions(F.desc(F.size("paths")), "first").select("key", "paths").mapInPandas(run, "key string, cluster int")
    unknown = sets.select("entity_id", "key").join(found, "key").select("entity_id", F.concat(F.lit("unknown-"), "cluster").alias("type_id"))
    return known.where("hint is not null").select("entity_id", F.col("hint").alias("type_id")).unionByName(unknown)


def fingerprints(attrs: DataFrame, types: DataFrame, profiles: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(type_id, entity_id, parts): the values of value signals and the presence of presence signals and relationship labels."""
    typed = attrs.join(types, "entity_id")
    signal = typed.join(profiles.where("signal <> 'NONE'").select("type_id", "path", "signal"), ["type_id", "path"])
    parts = signal.select("type_id", "entity_id", F.struct("path", F.when(F.col("signal") == "VALUE", F.col("value")).otherwise("__EXISTS__").alias("value")).alias("part"))
    if relations is not None:
        rel = relations.select(F.col("src").alias("entity_id"), "label").distinct().join(types, "entity_id")
        parts = parts.unionByName(rel.select("type_id", "entity_id", F.struct(F.concat(F.lit("REL::"), "label").alias("path"), F.lit("__EXISTS__").alias("value")).alias("part")))
    return types.join(parts.groupBy("type_id", "entity_id").agg(F.array_sort(F.collect_list("part")).alias("parts")), ["type_id", "entity_id"], "left").select("type_id", "entity_id", F.coalesce("parts", F.array().cast("array<struct<path:string,value:string>>")).alias("parts"))


def variables(a: dict, b: dict, paths: set) -> int:
    """Paths on which two entities don't agree; what both lack counts, as it says nothing for them being alike."""
    return sum(p not in a or p not in b or a[p] != b[p] for p in paths)


def merged(prints: list[tuple[str, list[tuple[str, dict]], int]], paths: set, config: Config) -> list[int]:
    """The cluster of each fingerprint (key, first entities with signal values, size), in the order given.

    A fingerprint joins the first cluster from whose first five entities it differs by ``most_variables`` paths on
    average or fewer. Clusters below ``least_cluster`` then join the nearest large one within twice that, or else the
    largest; if none is large, all are one.
    """
    groups: list[dict] = []
    mean = lambda x, y: sum(variables(a, b, paths) for _, a in x for _, b in y) / (len(x) * len(y))
    first5 = lambda x, y: sorted(x + y, key=lambda e: e[0])[:5]
    for i, (_, reps, size) in enumerate(prints):
        for g in groups:
            if mean(reps, g["reps"]) <= config.most_variables:
                g["of"].append(i)
                g["size"] += size
                g["reps"] = first5(g["reps"], reps)
                break
        else:
            groups.append({"of": [i], "size": size, "reps": reps})
    large = [g for g in groups if g["size"] >= config.least_cluster]
    small = [g for g in groups if g["size"] < config.least_cluster]
    if small and not large:
        return [0] * len(prints)
    for g in small:
        best = min(((mean(g["reps"], o["reps"]), k) for k, o in enumerate(large)), default=None)
        to = large[best[1]] if best and best[0] <= 2 * config.most_variables else max(large, key=lambda o: o["size"])
        to["of"] += g["of"]
        to["size"] += g["size"]
        to["reps"] = first5(to["reps"], g["reps"])
    out = [0] * len(prints)
    for k, g in enumerate(large):
        for i in g["of"]:
            out[i] = k
    return out


def refine(attrs: DataFrame, types: DataFrame, profiles: DataFrame, relations: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(entity_id, type_id) with types split where fingerprints differ; the parts of a type t are t_0, t_1 and so on, unique over all types."""
    prints = fingerprints(attrs, types, profiles, relations).withColumn("key", F.sha2(F.to_json("parts"), 256))
    typed = attrs.join(types, "entity_id").join(profiles.where("signal <> 'NONE'").select("type_id", "path"), ["type_id", "path"])
    ranked = prints.withColumn("k", F.row_number().over(Window.partitionBy("type_id", "key").orderBy("entity_id")))
    size = prints.groupBy("type_id", "key").agg(F.count("*").alias("size"), F.min("entity_id").alias("first"))
    signal = typed.groupBy("type_id", "entity_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("signals"))
    reps = ranked.where("k <= 5").join(signal, ["type_id", "entity_id"], "left").groupBy("type_id", "key").agg(F.array_sort(F.collect_list(F.struct("entity_id", F.to_json("signals").alias("signals")))).alias("reps"))
    paths = profiles.where("signal <> 'NONE'").groupBy("type_id").agg(F.collect_set("path").alias("paths"))
    if relations is not None:
        labels = relations.select(F.col("src").alias("entity_id"), "label").join(types, "entity_id").groupBy("type_id").agg(F.collect_set(F.concat(F.lit("REL::"), "label")).alias("labels"))
        paths = types.select("type_id").distinct().join(paths, "type_id", "left").join(labels, "type_id", "left").select("type_id", F.concat(F.coalesce("paths", F.array().cast("array<string>")), F.coalesce("labels", F.array().cast("array<string>"))).alias("paths"))
    rows = size.join(reps, ["type_id", "key"]).join(paths, "type_id", "left")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        import json

        f = f.sort_values("first")
        prints = [(k, [(r["entity_id"], json.loads(r["signals"]) if r["signals"] else {}) for r in reps], int(n)) for k, reps, n in zip(f["key"], f["reps"], f["size"])]
        paths = f["paths"].iloc[0]
        part = merged(prints, set(paths) if paths is not None else set(), config)
        return pd.DataFrame({"type_id": f["type_id"], "key": f["key"], "part": part, "parts": [len(set(part))] * len(part)})

    split = rows.groupBy("type_id").applyInPandas(run, "type_id string, key string, part int, parts int")
    named = split.withColumn("new", F.when(F.col("parts") == 1, F.col("type_id")).otherwise(F.concat_ws("_", "type_id", "part")))
    # a part must not take the name of another type
    taken = named.select("type_id", "new").distinct().withColumn("k", F.row_number().over(Window.partitionBy("new").orderBy(F.col("type_id") != F.col("new"), "type_id")))
    named = named.join(taken, ["type_id", "new"]).withColumn("new", F.when(F.col("k") == 1, F.col("new")).otherwise(F.concat_ws("_", "new", F.lit("of"), "type_id")))
    return prints.join(named.select("type_id", "key", "new"), ["type_id", "key"]).select("entity_id", F.col("new").alias("type_id"))


def bootstrap(attrs: DataFrame, hints: DataFrame | None = None, relations: DataFrame | None = None, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(types, profiles): seeding, then profiling and refinement until no entity changes its type, or ``iterations`` rounds."""
    types = cut(seed(attrs, hints, config.least_jaccard))
    for _ in range(config.iterations):
        new = cut(refine(attrs, types, profile(attrs.join(types, "entity_id"), "type_id"), relations, config))
        stable = new.join(types, ["entity_id", "type_id"], "left_anti").isEmpty()
        types = new
        if stable:
            break
    return types, profile(attrs.join(types, "entity_id"), "type_id")


# covers

#: tokens of an attribute: a quarter of its characters and two
COST = "(length(path) / 4d + length(value) / 4d + 2)"


def bundles(vectors: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """(keys, items, size, support) of item sets that ``least`` entities share; items are (path, value) in order.

    Level by level: a set is counted only where its parts are frequent, which leaves the counts as they are.
    """
    rows = vectors.select(*keys, "entity_id", F.struct("path", "value").alias("i1"))
    common = rows.groupBy(*keys, "i1").agg(F.count("*").alias("n")).where(f"n >= {least}").drop("n")
    rows = rows.join(common, [*keys, "i1"])
    found, level = [], rows
    for k in range(1, most + 1):
        if k > 1:
            level = level.join(rows.withColumnRenamed("i1", f"i{k}"), [*keys, "entity_id"]).where(f"i{k - 1} < i{k}")
        names = [f"i{j}" for j in range(1, k + 1)]
        count = level.groupBy(*keys, *names).agg(F.count("*").alias("support")).where(f"support >= {least}")
        if 1 < k < most:
            level = level.join(count.drop("support"), [*keys, *names])
        found.append(count.select(*keys, F.array(*names).alias("items"), F.lit(k).alias("size"), "support"))
    return reduce(DataFrame.unionByName, found)


def item_cost(items: str = "items") -> Column:
    return F.expr(f"aggregate({items}, 0d, (a, x) -> a + length(x.path) / 4d + length(x.value) / 4d + 2)")


def bundle_gain(found: DataFrame, config: Config = Config()) -> DataFrame:
    """The bundles with gain: what their items cost on every entity, less the class and a reference on each."""
    return found.withColumn("cost", item_cost()).withColumn("gain", F.expr(f"support * cost - (cost + {config.class_tokens} + support * {config.reference_tokens})"))


def covered(vectors: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entity_id) of entities that hold all items of their group's bundle: division by counting."""
    items = best.select(*keys, "size", F.explode("items").alias("x")).select(*keys, "size", "x.path", "x.value")
    return vectors.join(items, [*keys, "path", "value"]).groupBy(*keys, "entity_id", "size").agg(F.count("*").alias("n")).where("n = size").select(*keys, "entity_id")


def greedy_cover(vectors: DataFrame, keys: list[str], score: Callable[[DataFrame, DataFrame], DataFrame], least: int, most: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(bundles chosen (keys, round, items, gain), members (keys, round, entity_id), what is left of the vectors).

    Each round takes the best bundle of every group (gain, then size, then the items' order), removes the entities it
    covers and ends when no group has one with a gain. ``score`` adds gain to bundles, given the vectors left.
    """
    chosen, members, k = [], [], 0
    while True:
        found = score(bundles(vectors, keys, least, most), vectors).where("gain > 1e-9")
        best = found.groupBy(*keys).agg(F.min(F.struct((-F.round("gain", 6)).alias("g"), (-F.col("size")).alias("s"), "items")).alias("b"))
        best = cut(best.select(*keys, F.lit(k).alias("round"), "b.items", (-F.col("b.g")).alias("gain"), (-F.col("b.s")).alias("size")))
        if best.isEmpty():
            break
        mine = cut(covered(vectors, best, keys).withColumn("round", F.lit(k)))
        vectors = cut(vectors.join(mine, [*keys, "entity_id"], "left_anti"))
        chosen.append(best.drop("size"))
        members.append(mine)
        k += 1
    if not chosen:
        return None, None, vectors
    return reduce(DataFrame.unionByName, chosen), reduce(DataFrame.unionByName, members), vectors


def name_of(items: Column, short: int, most: int) -> Column:
    """The last words of the first two paths, each with its value if that is shorter than ``short``, in word characters."""
    word = lambda x: F.concat_ws("_", F.element_at(F.split(x["path"], r"\."), -1), F.when(F.length(x["value"]) < short, x["value"]))
    raw = F.regexp_replace(F.array_join(F.transform(F.slice(items, 1, 2), word), "_"), r"[^\p{L}\p{N}_]", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(raw, "^_+|_+$", ""), 1, most), F.lit("")), F.lit("class"))


def numbered(named: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Equal names of a group get _1, _2 and so on from the second on."""
    k = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)) - 1
    return named.withColumn("_k", k).withColumn(name, F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat_ws("_", name, "_k"))).drop("_k")


@dataclass
class Hierarchy:
    """base (type_id, path, value); classes (type_id, class, path, value); members (type_id, entity_id, class);
    subclasses (type_id, subclass, parent, path, value); sub_members (type_id, entity_id, subclass);
    overrides (type_id, entity_id, owner, path, op, value), op set or absent."""

    base: DataFrame
    classes: DataFrame
    members: DataFrame
    subclasses: DataFrame | None = None
    sub_members: DataFrame | None = None
    overrides: DataFrame | None = None


def base_class(typed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(type_id, path, value) of paths with one value on every entity: those of role A_BASE and the universal ones of role B."""
    some = profiles.where("role in ('A_BASE', 'B')").where("coverage = 1 and cardinality = 1").select("type_id", "path")
    return typed.join(some, ["type_id", "path"]).groupBy("type_id", "path").agg(F.min("value").alias("value"))


def residual(typed: DataFrame, profiles: DataFrame, base: DataFrame) -> DataFrame:
    """(type_id, entity_id, path, value) of role B outside the base class."""
    some = profiles.where("role = 'B'").select("type_id", "path").join(base, ["type_id", "path"], "left_anti")
    return typed.join(some, ["type_id", "path"]).select("type_id", "entity_id", "path", "value")


def extract_classes(typed: DataFrame, profiles: DataFrame, config: Config = Config()) -> Hierarchy:
    """Base and classes by the greedy cover of frequent bundles; what no class covers is in _base_only."""
    base = cut(base_class(typed, profiles))
    vectors = cut(residual(typed, profiles, base))
    chosen, got, _ = greedy_cover(vectors, ["type_id"], lambda b, _: bundle_gain(b, config), config.least_support, config.bundle_size)
    every = typed.select("type_id", "entity_id").distinct()
    if chosen is None:
        none = typed.sparkSession.createDataFrame([], "type_id string, class string, path string, value string")
        return Hierarchy(base, none, every.withColumn("class", F.lit("_base_only")))
    named = cut(numbered(chosen.withColumn("class", name_of(F.col("items"), 30, 50)), ["type_id"], "class", "round"))
    members = every.join(got.join(named.select("type_id", "round", "class"), ["type_id", "round"]).select("type_id", "entity_id", "class"), ["type_id", "entity_id"], "left").na.fill("_base_only", ["class"])
    return Hierarchy(base, named.select("type_id", "class", F.explode("items").alias("x")).select("type_id", "class", "x.path", "x.value"), cut(members))


def restricted_deltas(typed: DataFrame, profiles: DataFrame, h: Hierarchy) -> DataFrame:
    """(type_id, class, entity_id, path, op, value): how entities differ from base and class on paths of role B."""
    eligible = profiles.where("role = 'B'").select("type_id", "path")
    template = h.base.join(h.members.select("type_id", "class").distinct(), "type_id").select("type_id", "class", "path", "value", F.lit(0).alias("rank")).unionByName(h.classes.withColumn("rank", F.lit(1)))
    template = template.join(eligible, ["type_id", "path"], "left_semi").groupBy("type_id", "class", "path").agg(F.max_by("value", "rank").alias("want"))
    want = h.members.join(template, ["type_id", "class"])
    have = typed.join(eligible, ["type_id", "path"], "left_semi").join(h.members, ["type_id", "entity_id"]).select("type_id", "class", "entity_id", "path", "value")
    both = have.join(want, ["type_id", "class", "entity_id", "path"], "full_outer").where("not (value <=> want)")
    return both.select("type_id", "class", "entity_id", "path", F.when(F.col("value").isNull(), "absent").otherwise("set").alias("op"), "value")


def extract_subclasses(typed: DataFrame, profiles: DataFrame, h: Hierarchy, config: Config = Config()) -> Hierarchy:
    """The hierarchy with subclasses by the same cover on what entities differ in, and overrides for the rest.

    A bundle gains what its entities' deltas cost inline, less the subclass (its overhead, a class's, its items, the
    list of its entities) and what is left of the deltas.
    """
    keys = ["type_id", "class"]
    deltas = cut(restricted_deltas(typed, profiles, h))
    # an absent path costs its name and the mark for it
    each = deltas.groupBy(*keys, "entity_id").agg(F.sum(F.expr("length(path) / 4d + coalesce(length(value), 6) / 4d + 2")).alias("inline"), F.count("*").alias("n"))
    vectors = deltas.where("op = 'set'").select(*keys, "entity_id", "path", "value")

    def score(found: DataFrame, left: DataFrame) -> DataFrame:
        on = left.select(*keys, "entity_id").distinct().join(each, [*keys, "entity_id"])
        items = found.withColumn("b", F.sha2(F.to_json("items"), 256))
        parts = items.select(*keys, "b", "size", F.explode("items").alias("x")).select(*keys, "b", "size", "x.path", "x.value")
        whose = left.join(parts, [*keys, "path", "value"]).groupBy(*keys, "b", "size", "entity_id").agg(F.count("*").alias("m")).where("m = size")
        sums = whose.join(on, [*keys, "entity_id"]).groupBy(*keys, "b").agg(F.sum(F.length("entity_id") + 4).alias("ids"))
        out = items.join(sums, [*keys, "b"]).withColumn("cost", item_cost())
        # inline less residual is the items' cost on each entity
        return out.withColumn("gain", F.expr(f"support * cost - ({config.subclass_tokens} + cost + {config.class_tokens} + ids / 4d)")).drop("b", "ids")

    chosen, got, _ = greedy_cover(cut(vectors), keys, score, config.least_subclass, config.bundle_size)
    spark = typed.sparkSession
    if chosen is None:
        h.subclasses = spark.createDataFrame([], "type_id string, subclass string, parent string, path string, value string")
        h.sub_members = spark.createDataFrame([], "type_id string, entity_id string, subclass string")
    else:
        named = chosen.withColumn("subclass", F.concat_ws("_", "class", name_of(F.col("items"), 20, 30)))
        named = cut(numbered(named, ["type_id"], "subclass", "round"))
        h.subclasses = named.select("type_id", "subclass", F.col("class").alias("parent"), F.explode("items").alias("x")).select("type_id", "subclass", "parent", "x.path", "x.value")
        h.sub_members = cut(got.join(named.select(*keys, "round", "subclass"), [*keys, "round"]).select("type_id", "entity_id", "subclass"))
    own = deltas.join(h.sub_members, ["type_id", "entity_id"], "left")
    lifted = h.subclasses.select("type_id", "subclass", "path", F.lit(True).alias("lifted"))
    rest = own.join(lifted, ["type_id", "subclass", "path"], "left").where("lifted is null")
    h.overrides = cut(rest.select("type_id", "entity_id", F.coalesce("subclass", "class").alias("owner"), "path", "op", "value"))
    return h


# archetypes


def collapse_removals(removed: set[str], own: set[str]) -> set[str]:
    """Removed leaves, whole subtrees by their highest path."""
    out = set()
    for p in removed:
        keys = p.split(".")
        ways = (".".join(keys[:k]) for k in range(1, len(keys)))
        out.add(next((w for w in ways if all(q in removed for q in own if q.startswith(f"{w}."))), p))
    return out


def delta_cost(reference: dict, item: dict, n_identity: int) -> int:
    """Entries to turn the reference into the item: identity fields, removals (collapsed), changed and added fields."""
    removed = reference.keys() - item.keys()
    return n_identity + len(collapse_removals(set(removed), set(reference))) + sum(reference.get(p) != v for p, v in item.items())


def merge_groups(items: list[frozenset], least: int = 3) -> list[list[int]]:
    """Groups of signatures: the two groups that agree on most items, ``least`` or more, merge until none do (the first pair on ties).

    A group is what all its members hold, so a pair's score is the size of an intersection; scores are kept and only
    those of a merged group are made anew.
    """
    groups = {i: ([i], s) for i, s in enumerate(items)}
    score = {(i, j): n for i in groups for j in groups if i < j and (n := len(items[i] & items[j])) >= least}
    while score:
        (i, j), _ = max(score.items(), key=lambda kv: (kv[1], -kv[0][0], -kv[0][1]))
        of, common = groups[i][0] + groups.pop(j)[0], frozenset.intersection(*(items[k] for k in groups[i][0] + [j]))
        common = frozenset.intersection(*(items[k] for k in of))
        groups[i] = (of, common)
        score = {k: n for k, n in score.items() if i not in k and j not in k}
        for o in groups:
            if o != i and (n := len(common & groups[o][1])) >= least:
                score[min(i, o), max(i, o)] = n
    return [of for of, _ in groups.values()]


def archetypes(sigs: list[tuple[str, int, dict]]) -> list[tuple[list[int], dict, list[str]]]:
    """(signatures, reference without identity fields, identity fields) of each group worth a class.

    Signatures are (first entity, number of entities, path: value). A group needs three entities, or two that agree on
    three items. Identity fields are those on all entities with all values different; the reference is the member from
    which all others take fewest entries, the first on ties.
    """
    order = sorted(range(len(sigs)), key=lambda i: sigs[i][0])
    sets = [frozenset(sigs[i][2].items()) for i in order]
    out = []
    for group in merge_groups(sets):
        of = [order[k] for k in group]
        size = sum(sigs[i][1] for i in of)
        common = frozenset.intersection(*(frozenset(sigs[i][2].items()) for i in of))
        if size < 2 or (size == 2 and len(common) < 3):
            continue
        paths = set.intersection(*(set(sigs[i][2]) for i in of))
        ident = sorted(p for p in paths if len({sigs[i][2][p] for i in of}) == size) if size == len(of) else []
        bare = {i: {p: v for p, v in sigs[i][2].items() if p not in ident} for i in of}
        best = min(sorted(of, key=lambda i: sigs[i][0]), key=lambda i: sum(sigs[j][1] * delta_cost(bare[i], bare[j], len(ident)) for j in of))
        out.append((of, bare[best], ident))
    return out


def extract_archetypes(typed: DataFrame, profiles: DataFrame, config: Config = Config()) -> Hierarchy:
    """Base and classes by archetypes: each type's distinct signatures meet in one task."""
    base = cut(base_class(typed, profiles))
    rest = residual(typed, profiles, base)
    sig = rest.groupBy("type_id", "entity_id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("items")).withColumn("sig", F.sha2(F.to_json("items"), 256))
    every = typed.select("type_id", "entity_id").distinct()
    sigs = sig.groupBy("type_id", "sig").agg(F.first("items").alias("items"), F.count("*").alias("n"), F.min("entity_id").alias("first"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = [(a, int(n), {x["path"]: x["value"] for x in items}) for a, n, items in zip(f["first"], f["n"], f["items"])]
        out = []
        for k, (of, reference, _) in enumerate(archetypes(rows)):
            items = [{"path": p, "value": v} for p, v in sorted(reference.items())]
            out += [(f["type_id"].iloc[0], k, f["sig"].iloc[i], items if i == of[0] else None) for i in of]
        return pd.DataFrame(out, columns=["type_id", "round", "sig", "items"])

    found = cut(sigs.groupBy("type_id").applyInPandas(run, "type_id string, round int, sig string, items array<struct<path:string,value:string>>"))
    named = cut(numbered(found.where("items is not null").withColumn("class", name_of(F.col("items"), 30, 50)), ["type_id"], "class", "round"))
    got = sig.join(found.select("type_id", "sig", "round"), ["type_id", "sig"]).join(named.select("type_id", "round", "class"), ["type_id", "round"]).select("type_id", "entity_id", "class")
    members = cut(every.join(got, ["type_id", "entity_id"], "left").na.fill("_base_only", ["class"]))
    return Hierarchy(base, named.select("type_id", "class", F.explode("items").alias("x")).select("type_id", "class", "x.path", "x.value"), members)


# engines


@dataclass
class Engines:
    """Compression engines by name: functions of (typed attributes, profiles, config) to a hierarchy."""

    known: dict[str, Callable[[DataFrame, DataFrame, Config], Hierarchy]] = field(default_factory=dict)

    def register(self, name: str, engine: Callable[[DataFrame, DataFrame, Config], Hierarchy]) -> None:
        if name in self.known:
            raise ValueError(f"the engine {name} is there already")
        self.known[name] = engine

    def get(self, name: str) -> Callable[[DataFrame, DataFrame, Config], Hierarchy]:
        if name not in self.known:
            raise KeyError(f"no engine {name}; there are {', '.join(sorted(self.known))}")
        return self.known[name]


ENGINES = Engines()
ENGINES.register("archetypal", lambda t, p, c: extract_subclasses(t, p, extract_archetypes(t, p, c), c))
ENGINES.register("greedy-bundle", lambda t, p, c: extract_subclasses(t, p, extract_classes(t, p, c), c))
