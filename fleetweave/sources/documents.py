"""Documents of any supported format: found, read, parsed to trees, flattened to leaves.

Parsing is one narrow Arrow pass; a tree travels as its canonical JSON. What can't be parsed keeps a row with the reason
in ``error``, so nothing is lost unseen.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as element
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetweave.functions import trees
from fleetweave.functions.trees import Tree
from fleetweave.functions.values import glob_regex
from fleetweave.sources.readers import format_of

Batches = Iterator[pa.RecordBatch]
SLICE, MOST_ROWS = 256, 4096  # rows read and rows made that are objects at a time

# readers


def coerce(raw: str) -> Tree:
    """A text as the boolean or number that it spells, or as it is."""
    low = raw.lower()
    if low in ("true", "yes", "on") or low in ("false", "no", "off"):
        return low in ("true", "yes", "on")
    if re.fullmatch(r"[+-]?\d+", raw):
        return int(raw)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", raw):
        return float(raw)
    return raw


_HEADER = re.compile(r"\[(.+)\]\s*")


def _told(text: str) -> list[str]:
    return [x for line in text.splitlines() if (x := line.strip()) and x[0] not in "#;"]


def has_sections(text: str) -> bool:
    return any(_HEADER.fullmatch(x) for x in _told(text))


def read_ini(text: str) -> dict:
    """Sections of key = value, keys in lower case, repeated ones joined by a comma; flat pairs where there are no
    sections; words and values apart by a space where there is no = either, a lone word being true."""
    lines, out = _told(text), {}
    if has_sections(text):
        at: dict | None = None
        for x in lines:
            if m := _HEADER.fullmatch(x):
                at = out.setdefault(m[1], {})
            elif at is not None and "=" in x:
                k, v = (y.strip() for y in x.split("=", 1))
                k, v = k.lower(), coerce(v)
                at[k] = f"{trees.text_of(at[k])},{trees.text_of(v)}" if k in at else v
        return out
    for x in lines:
        if "=" in x:
            k, v = (y.strip() for y in x.split("=", 1))
            out[k] = coerce(v)
    if not out:
        for x in lines:
            k, *v = x.split(None, 1)
            out[k] = coerce(v[0]) if v else True
    return out


def read_xml(text: str) -> dict:
    """Attributes as @name in order, children by name, repeated ones as lists; bare text is a scalar, text beside children
    ``_text`` (with what follows the children). Namespaces go; a document type is refused."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        raise ValueError("document types are refused")

    def name(x: str) -> str:
        return x.rpartition("}")[2]

    def value(x: element.Element) -> Tree:
        said = " ".join(y for y in ((x.text or "").strip(), *((c.tail or "").strip() for c in x)) if y)
        if not len(x) and not x.attrib:
            return said
        out: dict = {f"@{name(k)}": x.attrib[k] for k in sorted(x.attrib)}
        if said:
            out["_text"] = said
        many: dict[str, list] = {}
        for c in x:
            many.setdefault(name(c.tag), []).append(value(c))
        return out | {k: v[0] if len(v) == 1 else v for k, v in many.items()}

    root = element.fromstring(text)
    return {name(root.tag): value(root)}


#: marks that libyaml lets stand where PyYAML doesn't
_OTHERWISE = ("\t", "|#", ">#", "? ")


def read_yaml(text: str) -> Tree:
    """The tree of a YAML text, by libyaml where it is there; what it refuses, has nested deep or may take otherwise (_OTHERWISE)
    is PyYAML's own to read."""
    try:
        import yaml
    except ImportError as e:  # an optional dependency
        raise ValueError("reading YAML needs PyYAML") from e
    fast = getattr(yaml, "CSafeLoader", None)
    # libyaml recurses without a limit: as deep as there are marks of flow, or levels of indentation
    if fast is None or any(x in text for x in _OTHERWISE) or len(text) > 100_000 or text.count("[") + text.count("{") > 200 or text.count("- - ") > 20:
        fast = yaml.SafeLoader
    try:
        doc = yaml.load(text, fast)
    except yaml.YAMLError:
        doc = yaml.load(text, yaml.SafeLoader)
    return json.loads(json.dumps(doc, default=str))


READERS: dict[str, Callable[[str], Tree]] = {"json": json.loads, "yaml": read_yaml, "ini": read_ini, "xml": read_xml}


def platform_of(doc: Tree) -> str | None:
    """The platform that a document is for, by the members it has; the first rule that holds."""
    if isinstance(doc, list):
        play = doc[0] if doc else None
        return "ansible-playbook" if isinstance(play, dict) and "hosts" in play and ("tasks" in play or "roles" in play) else None
    if not isinstance(doc, dict):
        return None
    has = lambda *keys: all(k in doc for k in keys)
    services = doc.get("services")
    rules = (
        ("docker-compose", isinstance(services, dict) and any(isinstance(v, dict) and "image" in v for v in services.values())),
        ("terraform-state", has("terraform_version", "resources")),
        ("cloud-init", len(doc.keys() & {"packages", "runcmd", "write_files", "users", "ssh_authorized_keys", "growpart", "ntp"}) >= 2),
        ("kubernetes", has("apiVersion", "kind")),
        ("github-actions", has("on", "jobs")),
        ("traefik", has("entryPoints") or has("providers", "api") or has("providers", "log")),
        ("prometheus", has("scrape_configs")),
    )
    return next((name for name, holds in rules if holds), None)


# tables


def load(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(source, entity_id, format, text) of the files of a folder: one row a file, the entity named after the file."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select("value", "_metadata.file_path")
    return files.select(F.col("file_path").alias("source"), entity_of(F.lit(None).cast("string"), F.col("file_path")).alias("entity_id"), format_of(F.col("file_path")).alias("format"), F.col("value").alias("text"))


def entity_of(hostname: Column, path: Column) -> Column:
    """The host's name, or else the file's without its folder and suffix."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.coalesce(F.nullif(F.trim(hostname), F.lit("")), stem)


def _rows(schema: list[tuple[str, pa.DataType]], work: Callable[..., Iterator[tuple]]) -> Callable[[Batches], Batches]:
    """An Arrow pass that makes rows of each row, a few hundred rows at a time, so that a batch's rows are never objects together."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])

    def run(batches: Batches) -> Batches:
        for b in batches:
            out: list[tuple] = []
            for at in range(0, b.num_rows, SLICE):
                for row in zip(*(c.to_pylist() for c in b.slice(at, SLICE).columns)):
                    out.extend(work(*row))
                    if len(out) >= MOST_ROWS:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return run


def parse(docs: DataFrame) -> DataFrame:
    """(entity_id, format, doc, platform, error) of (entity_id, format, text); doc is canonical JSON."""

    def work(entity: str, form: str, text: str | None) -> Iterator[tuple]:
        try:
            doc = READERS[form](text or "") if text and text.strip() else None
            yield entity, form, trees.value_key(doc), platform_of(doc), None
        except Exception as e:  # noqa: BLE001 - whatever a reader dislikes is reported with the row
            yield entity, form, None, None, f"{type(e).__name__}: {e}"[:500]

    s = pa.string()
    return docs.selectExpr("cast(entity_id as string)", "format", "text").mapInArrow(_rows([("entity_id", s), ("format", s), ("doc", s), ("platform", s), ("error", s)], work), "entity_id string, format string, doc string, platform string, error string")


def attributes(parsed: DataFrame, overrides: dict[str, str] | None = None, joint: str = ",") -> DataFrame:
    """(entity_id, path, attr_type, value) of (entity_id, doc): texts, and composites as JSON with type map or list."""

    def work(entity: str, doc: str | None) -> Iterator[tuple]:
        flat, composite = trees.flatten(json.loads(doc), overrides, joint) if doc else ({}, {})
        for p, v in flat.items():
            yield entity, p, "string", v
        for p, (kind, v) in composite.items():
            yield entity, p, kind, trees.value_key(v)

    s = pa.string()
    return parsed.select("entity_id", "doc").mapInArrow(_rows([("entity_id", s), ("path", s), ("attr_type", s), ("value", s)], work), "entity_id string, path string, attr_type string, value string")


def source_leaves(parsed: DataFrame) -> DataFrame:
    """(entity_id, path, value) by the independent walk."""

    def work(entity: str, doc: str | None) -> Iterator[tuple]:
        for p, v in trees.walk(json.loads(doc)) if doc else ():
            yield entity, p, v

    s = pa.string()
    return parsed.select("entity_id", "doc").mapInArrow(_rows([("entity_id", s), ("path", s), ("value", s)], work), "entity_id string, path string, value string")


def attribute_leaves(attrs: DataFrame) -> DataFrame:
    """(entity_id, path, value) of attributes, composites by member; map members by key, list members by position."""
    plain = attrs.where("attr_type not in ('map', 'list')").select("entity_id", "path", "value")
    maps = attrs.where("attr_type = 'map'").select("entity_id", "path", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("k", "m")).select("entity_id", F.concat_ws(".", "path", "k").alias("at"), F.explode("m").alias("f", "value"))
    lists = attrs.where("attr_type = 'list'").select("entity_id", "path", F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("i", "m")).select("entity_id", F.concat("path", F.lit("["), "i", F.lit("]")).alias("at"), F.explode("m").alias("f", "value"))
    members = maps.unionByName(lists).select("entity_id", F.when(F.col("f") == "_value", F.col("at")).otherwise(F.concat_ws(".", "at", "f")).alias("path"), "value")
    return plain.unionByName(members)


#: brackets and positions of either walk become dots, so both spell a path alike
TOKENS = {"evis": "evi", "neighbors": "neighbor", "vrfs": "vrf", "interfaces": "interface"}


def leaf_tokens(path: Column, value: Column) -> Column:
    """The words of a path and its value, plurals of composites folded; a value of true is left out."""
    words = F.filter(F.split(F.translate(path, "[]\\", "..."), r"\."), lambda x: x != "")
    folded = F.create_map(*(F.lit(x) for kv in TOKENS.items() for x in kv))
    words = F.transform(words, lambda x: F.coalesce(folded[x], x))
    return F.concat(words, F.when(value == "true", F.array().cast("array<string>")).otherwise(F.split(value, r"\s+")))


def fidelity(leaves: DataFrame, attrs: DataFrame) -> DataFrame:
    """(entity_id, tokens, surplus) where an entity's source leaves and attributes differ, as multisets of tokens."""
    side = lambda df, s: df.select("entity_id", leaf_tokens(F.col("path"), F.col("value")).alias("tokens"), F.lit(s).alias("s"))
    return side(leaves, 1).unionByName(side(attrs, -1)).groupBy("entity_id", "tokens").agg(F.sum("s").alias("surplus")).where("surplus <> 0")


SECTION_LEAVES = "host string, section string, shape string, path string, value_type string, value string"


def section_leaves(parsed: DataFrame) -> DataFrame:
    """(host, section, shape, path, value_type, value) of hosts' documents: a section is a member of the root.

    Shapes are kept a host and section (dict, list_of_dicts or scalar); lists of dicts have paths [i].field; an empty
    dict is one leaf of path ''; values are canonical JSON.
    """

    def work(host: str, doc: str | None) -> Iterator[tuple]:
        root = json.loads(doc) if doc else None
        for section, v in root.items() if isinstance(root, dict) else [("_root", root)] if root is not None else ():
            if isinstance(v, dict):
                shape, rows = "dict", trees.section_leaves(v)
            elif isinstance(v, list) and v and all(isinstance(x, dict) and x for x in v):
                shape, rows = "list_of_dicts", trees.list_rows(v)
            else:
                shape, rows = "scalar", [("", v)]
            for p, x in rows:
                yield host, section, shape, p, type(x).__name__, trees.value_key(x)

    s = pa.string()
    return parsed.select("entity_id", "doc").mapInArrow(_rows([(n.split()[0], s) for n in SECTION_LEAVES.split(", ")], work), SECTION_LEAVES)


def rebuilt(leaves: DataFrame) -> DataFrame:
    """(host, section, data) of section leaves: the inverse, data as canonical JSON."""

    def build(shape: str, rows: list) -> str:
        pairs = [(r["path"], json.loads(r["value"])) for r in rows]
        return trees.value_key(trees.list_of(pairs) if shape == "list_of_dicts" else trees.unflatten(pairs))

    def work(host: str, section: str, shape: str, rows: list) -> Iterator[tuple]:
        yield host, section, build(shape, rows)

    s = pa.string()
    whole = leaves.groupBy("host", "section", "shape").agg(F.collect_list(F.struct("path", "value")).alias("rows"))
    return whole.mapInArrow(_rows([("host", s), ("section", s), ("data", s)], work), "host string, section string, data string")


def save(leaves: DataFrame, path: str) -> None:
    """Writes section leaves by section, so that a section's query reads its own folder only."""
    leaves.write.mode("overwrite").partitionBy("section").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def match_spec(names: DataFrame, entries: list[tuple[str, str]], name: str = "entity_id") -> DataFrame:
    """(name, platform, entry) by the first file glob that matches; null for none. The entries are a specification, held in the plan."""
    out_p, out_e = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for i, (glob, platform) in enumerate(entries):
        hit = F.col(name).rlike(glob_regex(glob, across=True))
        out_p, out_e = out_p.when(hit, platform), out_e.when(hit, i)
    return names.select(name, out_p.alias("platform"), out_e.alias("entry"))


#: members of directory objects that say nothing about their configuration, at the top level
SKIPPED = ("@odata.type", "id", "createdDateTime", "modifiedDateTime", "deletedDateTime", "renewedDateTime")


def graph_objects(docs: DataFrame, kinds: dict[str, str], text: str = "text") -> DataFrame:
    """(entity_id, type_hint, doc) of directory objects in JSON: named by displayName, typed by @odata.type."""
    v = docs.select(F.try_parse_json(F.col(text)).alias("v"), F.col(text).alias("raw"))
    kind = F.expr("try_variant_get(v, '$[\"@odata.type\"]', 'string')")
    hint = F.coalesce(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[kind] if kinds else F.lit(None), kind)

    def work(entity: str | None, hint: str | None, raw: str | None) -> Iterator[tuple]:
        doc = json.loads(raw)
        yield entity, hint, trees.value_key({k: x for k, x in doc.items() if k not in SKIPPED})

    s = pa.string()
    return v.where("schema_of_variant(v) like 'OBJECT%'").select(F.expr("try_variant_get(v, '$.displayName', 'string')").alias("entity_id"), hint.alias("type_hint"), "raw").mapInArrow(_rows([("entity_id", s), ("type_hint", s), ("doc", s)], work), "entity_id string, type_hint string, doc string")


def section_kinds(leaves: DataFrame) -> DataFrame:
    """(section, shape, hosts): the shape of a section where its hosts agree, scalar where they don't."""
    return leaves.groupBy("section").agg(F.when(F.count_distinct("shape") == 1, F.min("shape")).otherwise("scalar").alias("shape"), F.count_distinct("host").alias("hosts"))


def largest(leaves: DataFrame, group: str, n: int = 3) -> DataFrame:
    """(group, entity_id, n_attrs) of the n entities with most attributes of each group, by entity on ties."""
    size = leaves.groupBy(group, "entity_id").agg(F.count("*").alias("n_attrs"))
    return size.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n_attrs"), "entity_id"))).where(f"k <= {n}").drop("k")


def sample_texts(texts: DataFrame, most: int = 50_000) -> DataFrame:
    """(id, text) cut to ``most`` characters together, each in proportion to its length: the sample shown to a spec's author."""
    total = texts.agg(F.sum(F.length("text").cast("long")).alias("total"))
    # the product is beyond 32 bits for texts of 43,000 characters
    return texts.crossJoin(F.broadcast(total)).select("id", F.expr(f"if(total <= {most}, text, substring(text, 1, cast(floor(cast(length(text) as long) * {most} / total) as int)))").alias("text"))  # total is one row
