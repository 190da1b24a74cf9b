"""Indented device configuration: a tree by indentation, paths by how many arguments tell siblings apart, composites, checks."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.sources.documents import _rows

#: arguments that belong to a section's name
ARITY = {"interface": 1, "router": 2, "vrf": 1, "route-policy": 1, "prefix-set": 1, "community-set": 1, "class-map": 1, "policy-map": 1, "ipv4": 1, "address-family": 2, "neighbor": 1, "bridge group": 1, "bridge-domain": 1, "evi": 1}
TWO_WORDS = ("bridge group",)
_BLOCKS = {"route-policy": "end-policy", "prefix-set": "end-set", "community-set": "end-set"}


class Node:
    def __init__(self, words: list[str], no: bool = False, note: str | None = None, body: list[str] | None = None):
        self.words, self.no, self.note, self.body, self.children = words, no, note, body, []

    @property
    def keyword(self) -> str:
        two = " ".join(self.words[:2])
        return two if two in TWO_WORDS else self.words[0] if self.words else ""

    @property
    def args(self) -> list[str]:
        return self.words[len(self.keyword.split()) :]


def read_config(text: str) -> Node:
    """The tree of a configuration. ``!`` begins a comment and ``! CUSTOM:`` a note on the next line, ``no`` negates,
    blocks such as route-policy ... end-policy are taken as they are, ``end`` stops."""
    root = Node([])
    stack, note, block = [(-1, root)], None, None
    for line in text.splitlines():
        said = line.strip()
        if block is not None:
            if said == block[1]:
                block = None
            elif said:
                block[0].body.append(said)
            continue
        if not said:
            continue
        if said.startswith("!"):
            note = said.removeprefix("! CUSTOM:").strip() if said.startswith("! CUSTOM:") else note
            continue
        words = said.split()
        if words == ["end"]:
            break
        depth = len(line) - len(line.lstrip())
        no = words[0] == "no" and len(words) > 1
        node = Node(words[no:], no, note)
        note = None
        while stack[-1][0] >= depth:
            stack.pop()
        stack[-1][1].children.append(node)
        stack.append((depth, node))
        if words[0] in _BLOCKS:
            node.body = []
            block = (node, _BLOCKS[words[0]])
    return root


def hostname(root: Node) -> str | None:
    return next((" ".join(n.args) for n in root.children if n.keyword == "hostname" and n.args), None)


def section_key(node: Node) -> str:
    """keyword.arguments of a section, as many arguments as its keyword takes."""
    return ".".join([node.keyword.replace(" ", "-"), *node.args[: ARITY.get(node.keyword, 0)]])


def named(children: list[Node]) -> Iterator[tuple[Node, int]]:
    """(child, arguments in its path): none if the keyword is the only one, else the fewest that tell it from its siblings."""
    by: dict[str, list[Node]] = {}
    for c in children:
        by.setdefault(c.keyword, []).append(c)
    for c in children:
        same = by[c.keyword]
        d = ARITY.get(c.keyword, 0) if c.children else 0
        while len(same) > 1 and d < len(c.args) and sum(x.args[:d] == c.args[:d] for x in same) > 1:
            d += 1
        yield c, d


def flat_config(root: Node) -> list[tuple[str, str, str]]:
    """(path, kind, value): leaves as text, what no argument tells apart as a list, block bodies as a list."""
    out: list[tuple[str, str, str]] = []
    twins: dict[str, list[str]] = {}

    def visit(node: Node, path: str) -> None:
        for c, d in named(node.children):
            p = ".".join([x for x in (path, c.keyword.replace(" ", "-"), *c.args[:d]) if x])
            rest = " ".join(c.args[d:])
            if c.body is not None:
                out.append((p if d else ".".join([p, *c.args]), "list", json.dumps(c.body)))
            elif c.children:
                if rest:
                    out.append((f"{p}._args", "string", rest))
                visit(c, p)
            else:
                twins.setdefault(p, []).append("false" if c.no and not rest else f"no {rest}" if c.no else rest or "true")
            if c.note:
                out.append((f"{p}._note", "string", c.note))

    visit(root, "")
    return out + [(p, "string", v[0]) if len(v) == 1 else (p, "list", json.dumps(v)) for p, v in twins.items()]


#: (parent pattern, composite path): members under the parents become one map
COMPOSITES = ((r"^(router\.bgp\.[^.]+)\.neighbor\.(.+)$", "neighbors"), (r"^(evpn)\.evi\.(.+)$", "evis"), (r"^(l2vpn)\.bridge-group\.(.+)$", "bridge-groups"))


def configs(docs: DataFrame) -> DataFrame:
    """(entity_id, path, attr_type, value) of (entity_id, text); an entity is named by its host name, if it has one."""

    def work(entity: str, text: str | None) -> Iterator[tuple]:
        root = read_config(text or "")
        name = hostname(root) or entity
        for p, kind, v in flat_config(root):
            yield name, p, kind, v

    s = pa.string()
    return docs.selectExpr("cast(entity_id as string)", "text").mapInArrow(_rows([("entity_id", s), ("path", s), ("attr_type", s), ("value", s)], work), "entity_id string, path string, attr_type string, value string")


def composites(attrs: DataFrame, rules: tuple[tuple[str, str], ...] = COMPOSITES) -> DataFrame:
    """The attributes with members of BGP neighbours, EVPN instances and bridge groups as maps; their flat rows go (subsumption).

    The key of a member is the first word behind the parent; IPv4 addresses, which hold dots, count as one.
    """
    first = r"^((?:[0-9]+\.){3}[0-9]+|[^.]+)\.?(.*)$"
    at = F.when(F.lit(False), F.struct(F.lit(""), F.lit("")))
    for rx, name in rules:
        at = at.when(F.col("path").rlike(rx), F.struct(F.concat_ws(".", F.regexp_extract("path", rx, 1), F.lit(name)), F.regexp_extract("path", rx, 2)))
    marked = attrs.withColumn("at", at)
    member = marked.where("at is not null").select("entity_id", F.col("at.col1").alias("path"), F.regexp_extract("at.col2", first, 1).alias("k"), F.regexp_extract("at.col2", first, 2).alias("f"), "value")
    inner = member.groupBy("entity_id", "path", "k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.when(F.col("f") == "", "_value").otherwise(F.col("f")), "value")))).alias("m"))
    maps = inner.groupBy("entity_id", "path").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "m")), lambda a, b: F.when(a["k"] < b["k"], -1).otherwise(1)))).alias("value"))
    return marked.where("at is null").drop("at").unionByName(maps.select("entity_id", "path", F.lit("map").alias("attr_type"), "value"))


def subsumed(attrs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Attributes without those that lie under a prefix (entity_id, prefix) of their own entity.

    Each path is held against its own prefixes by equality, so this is a hash join and not a comparison of all with all.
    """
    parts = attrs.select("*", F.expr("transform(sequence(1, size(split(path, '[.]'))), k -> array_join(slice(split(path, '[.]'), 1, k), '.'))").alias("ways"))
    under = parts.select("entity_id", "path", F.explode("ways").alias("prefix")).join(prefixes, ["entity_id", "prefix"]).where("path <> prefix").select("entity_id", "path").distinct()
    return attrs.join(under, ["entity_id", "path"], "left_anti")


def description_refs(attrs: DataFrame) -> DataFrame:
    """(src, label, dst) told by descriptions such as ``to <host>`` on interfaces and neighbours; the target need not exist."""
    rx = r"(?i)\b(?:to|peer|link to)[ :_-]+([a-z][a-z0-9-]*[0-9])\b"
    d = attrs.where(F.col("path").rlike(r"(^|\.)description$")).select("entity_id", "path", F.regexp_extract("value", rx, 1).alias("dst")).where("dst <> '' and dst <> entity_id")
    return d.select(F.col("entity_id").alias("src"), F.when(F.col("path").startswith("interface"), "p2p_link").otherwise("bgp_peer").alias("label"), "dst").distinct()


def structure(docs: DataFrame) -> DataFrame:
    """(entity_id, section, raw_lines, tree_lines) where the lines of a section and the nodes of the tree differ in number."""

    def raw(text: str) -> Counter:
        out: Counter = Counter()
        section, block = "", None
        for line in text.splitlines():
            said = line.strip()
            if block:
                if said == block:
                    block = None
                continue
            if not said or said.startswith("!"):
                continue
            if said == "end":
                break
            words = re.sub(r"^no (?=\S)", "", said).split()
            if not line[0].isspace():
                section = words[0]
            out[section] += 1
            block = _BLOCKS.get(words[0])
        return out

    def work(entity: str, text: str | None) -> Iterator[tuple]:
        told, count = raw(text or ""), Counter()

        def visit(n: Node, top: str) -> None:
            for c in n.children:
                count[top or c.words[0]] += 1
                visit(c, top or c.words[0])

        visit(read_config(text or ""), "")
        for k in sorted(told.keys() | count.keys()):
            if told[k] != count[k]:
                yield entity, k, told[k], count[k]

    s, n = pa.string(), pa.int64()
    return docs.selectExpr("cast(entity_id as string)", "text").mapInArrow(_rows([("entity_id", s), ("section", s), ("raw_lines", n), ("tree_lines", n)], work), "entity_id string, section string, raw_lines long, tree_lines long")
