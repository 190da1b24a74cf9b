"""The query surface of a factored fleet: hosts, sections, classes, statistics, retrieval within a token budget.

``Factored`` tables come from ``operators.sections``. Host metadata are aggregated once; retrieval brings only what was
chosen to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions import trees
from fleetweave.operators.sections import Factored
from fleetweave.operators.serve import fits, ranked


def with_sections(leaves: DataFrame, sections: list[str] | None = None, hosts: list[str] | None = None) -> DataFrame:
    """The leaves of some sections and hosts; the section filter prunes the folders of a saved store."""
    out = leaves if sections is None else leaves.where(F.col("section").isin(sections))
    return out if hosts is None else out.where(F.col("host").isin(hosts))


def sections(leaves: DataFrame) -> DataFrame:
    return leaves.select("section").distinct().orderBy("section")


def hosts_of(leaves: DataFrame, section: str) -> DataFrame:
    return leaves.where(F.col("section") == section).select("host").distinct().orderBy("host")


def host_meta(f: Factored) -> DataFrame:
    """(host, total_delta, section_count, is_zero_delta, class_profile): a row a host."""
    n = f.deltas.groupBy("host", "section").agg(F.count("*").alias("n"))
    per = f.members.join(n, ["host", "section"], "left").na.fill(0, ["n"])
    names = F.array_join(F.array_sort(F.collect_set("class")), ",")
    return per.groupBy("host").agg(F.sum("n").alias("total_delta"), F.count("*").alias("section_count"), F.bool_and(F.expr("n = 0")).alias("is_zero_delta"), names.alias("class_profile"))


def summary(f: Factored) -> DataFrame:
    """(hosts, classes, zero_delta_hosts): one row."""
    m = host_meta(f)
    classes = f.classes.select("section", "class").distinct().agg(F.count("*").alias("classes"))
    return m.agg(F.count("*").alias("hosts"), F.count_if("is_zero_delta").alias("zero_delta_hosts")).crossJoin(classes)  # both are one row


def class_distribution(f: Factored) -> DataFrame:
    """(class, hosts, fields): hosts of each class, most first."""
    fields = f.classes.groupBy("class").agg(F.count("*").alias("fields"))
    return f.members.where("class is not null").groupBy("class").agg(F.count_distinct("host").alias("hosts")).join(fields, "class").orderBy(F.desc("hosts"), "class")


def by_delta(f: Factored, least: int = 0) -> DataFrame:
    return host_meta(f).where(F.col("total_delta") >= least).orderBy(F.desc("total_delta"), "host")


def by_class(f: Factored, name: str) -> DataFrame:
    return f.members.where(F.col("class") == name).select("host").distinct().orderBy("host")


def class_refs(f: Factored) -> DataFrame:
    """(host, classes): the classes a host refers to, in order."""
    return f.members.where("class is not null").groupBy("host").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def host_info(f: Factored, host: str) -> dict:
    """The metadata of a host; a KeyError if there is none of that name."""
    got = host_meta(f).where(F.col("host") == host).first()
    if got is None:
        raise KeyError(host)
    return got.asDict()


def host_order(meta: DataFrame, strategy: str = "delta", seed: int = 0) -> DataFrame:
    """The hosts with their place in retrieval: up to three without a delta first, then by falling delta, then the other
    ones without; or by name; or in an order drawn from the seed."""
    if strategy == "alphabetical":
        key = [F.col("host")]
    elif strategy == "random":
        key = [F.xxhash64("host", F.lit(seed)), F.col("host")]
    elif strategy == "delta":
        three = meta.where("total_delta = 0").orderBy("host").limit(3).select("host", F.lit(0).alias("_place"))
        meta = meta.join(three, "host", "left").withColumn("_place", F.coalesce("_place", F.expr("if(total_delta > 0, 1, 2)")))
        key = [F.col("_place"), F.desc("total_delta"), F.col("host")]
    else:
        raise ValueError(f"no strategy {strategy}")
    return ranked(meta, key).drop("_place")


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


def class_text(rows: list[tuple[str, str]]) -> dict:
    return trees.unflatten([(p, json.loads(v)) for p, v in rows])


@dataclass
class Context:
    """What a retrieval returns: the text, its hosts in order and its tokens."""

    text: str
    hosts: list[str]
    tokens: int


def host_json(f: Factored) -> DataFrame:
    """(host, json, cost): each host's references and deltas as JSON with its tokens, a row a host."""
    delta = f.deltas.groupBy("host", "section").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("rows"))
    each = f.members.join(delta, ["host", "section"], "left").select("host", F.struct("section", "class", "rows").alias("part"))
    whole = each.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("part"), lambda a, b: F.when(a["section"] < b["section"], -1).otherwise(1))).alias("json"))
    return whole.withColumn("cost", F.greatest(F.lit(1), F.expr("length(json) div 4")).cast("long"))


def retrieve(f: Factored, budget: int, hosts: list[str] | None = None, section_names: list[str] | None = None, strategy: str = "delta", seed: int = 0, slack: float = 0.05) -> Context:
    """Overview, the classes that the chosen hosts refer to, and hosts in order until one doesn't fit: the first that would
    overdraw what is left by more than ``slack`` of the budget ends it. Classes of all chosen hosts are reserved first."""
    some = f
    if section_names is not None:
        pick = lambda df: df.where(F.col("section").isin(section_names))
        some = Factored(pick(f.classes), pick(f.identities), pick(f.members), pick(f.deltas))
    if hosts is not None:
        pick = lambda df: df.where(F.col("host").isin(hosts))
        some = Factored(some.classes, some.identities, pick(some.members), pick(some.deltas))
    refs = some.members.where("class is not null").select("section", "class").distinct()
    bodies = some.classes.join(refs, ["section", "class"], "left_semi").groupBy("section", "class").agg(F.collect_list(F.struct("path", "value")).alias("rows")).orderBy("section", "class").collect()
    top = json.dumps({"fleet": summary(f).first().asDict(), "largest": [r.asDict() for r in by_delta(f).limit(10).collect()]}, default=str)
    classes = json.dumps({r["class"]: class_text([(x.path, x.value) for x in r["rows"]]) for r in bodies}, sort_keys=True)
    left = budget - tokens_of(top) - tokens_of(classes)
    costs = host_order(host_meta(some), strategy, seed).select("host", "place").join(host_json(some), "host")
    got = fits(costs, "cost", left + slack * budget).orderBy("place").collect() if left > 0 else []
    text = "\n".join([top, classes, *(f"{r['host']}: {r['json']}" for r in got)])
    return Context(text, [r["host"] for r in got], tokens_of(text))


def retrieve_for(f: Factored, query: str, budget: int) -> Context:
    """Hosts and sections that the question names (as substrings, whatever the case); without a host, those of the first class it names."""
    q = F.lower(F.lit(query))
    names = lambda df, c: [r[0] for r in df.select(c).distinct().where(F.contains(q, F.lower(F.col(c)))).orderBy(c).collect()]  # noqa: E731  (those in one question)
    hosts, found = names(f.members, "host"), names(f.members, "section")
    if not hosts:
        first = names(f.members.where("class is not null"), "class")[:1]
        hosts = [r.host for r in by_class(f, first[0]).collect()] if first else []
    return retrieve(f, budget, hosts or None, found or None)


def compression_stats(leaves: DataFrame, f: Factored) -> DataFrame:
    """(section, host, bytes, tokens, leaves, factored_tokens, ratio): by section and host, by section, by host and in all; grouping sets."""
    cost = F.greatest(F.lit(1), F.expr("(length(path) + length(value)) div 4"))
    raw = leaves.groupBy("section", "host").agg(F.sum(F.octet_length("path") + F.octet_length("value")).alias("b"), F.sum(cost).alias("t"), F.count("*").alias("n"))
    small = f.deltas.groupBy("section", "host").agg(F.sum(cost).alias("d"))
    refs = f.members.select("section", "host", F.when(F.col("class").isNotNull(), 4).otherwise(0).alias("r"))
    both = raw.join(refs, ["section", "host"]).join(small, ["section", "host"], "left").na.fill(0, ["d"])
    out = both.rollup("section", "host").agg(F.sum("b").alias("bytes"), F.sum("t").alias("tokens"), F.sum("n").alias("leaves"), F.sum(F.col("r") + F.col("d")).alias("factored_tokens"))
    return out.withColumn("ratio", F.round(F.col("factored_tokens") / F.col("tokens"), 4))


def report(leaves: DataFrame, f: Factored) -> str:
    """The statistics of sections as a markdown table; as many rows as sections."""
    rows = compression_stats(leaves, f).where("host is null").orderBy(F.col("section").asc_nulls_last()).collect()
    head = "| section | leaves | tokens | factored | ratio |\n|---|---|---|---|---|"
    return "\n".join([head, *(f"| {r.section or 'all'} | {r.leaves} | {r.tokens} | {r.factored_tokens} | {r.ratio} |" for r in rows)])


def save_tables(f: Factored, folder: str) -> None:
    """The four tables of a store: classes, class_members, host_compressed (deltas) and host_meta."""
    for name, df in (("classes", f.classes), ("identities", f.identities), ("class_members", f.members), ("host_compressed", f.deltas), ("host_meta", host_meta(f))):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark, folder: str) -> Factored:
    read = lambda n: spark.read.parquet(f"{folder}/{n}")
    return Factored(read("classes"), read("identities"), read("class_members"), read("host_compressed"))


def host_yaml(f: Factored) -> DataFrame:
    """(host, text): each host's file, its references and deltas in YAML."""

    def text(rows: list) -> str:
        out = {}
        for r in rows:
            own = {"_class": r["class"]} if r["class"] else {}
            body = class_text([(x["path"], x["value"]) for x in r["rows"] or []])
            out[r["section"]] = own | body if isinstance(body, dict) else body
        return trees.render(out)

    from fleetweave.sources.documents import _rows
    import pyarrow as pa

    s = pa.string()
    delta = f.deltas.groupBy("host", "section").agg(F.collect_list(F.struct("path", "value")).alias("rows"))
    each = f.members.join(delta, ["host", "section"], "left").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("section", "class", "rows")), lambda a, b: F.when(a["section"] < b["section"], -1).otherwise(1)).alias("rows"))
    return each.mapInArrow(_rows([("host", s), ("text", s)], lambda host, rows: [(host, text(rows))]), "host string, text string")


def class_yaml(f: Factored) -> str:
    """Tier B as YAML: classes only, which are few; bodies must not hold list references."""
    rows = f.classes.groupBy("class").agg(F.collect_list(F.struct("path", "value")).alias("rows")).collect()
    ident = {r["class"]: sorted(r["p"]) for r in f.identities.groupBy("class").agg(F.collect_set("path").alias("p")).collect()}
    out = {r["class"]: class_text([(x.path, x.value) for x in r["rows"]]) | ({"_identity": ident[r["class"]]} if r["class"] in ident else {}) for r in rows}
    trees.check_classes(out)
    return trees.render(out)


