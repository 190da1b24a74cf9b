"""Documents to leaves: format by suffix, INI lines, JSON objects, XML trees, indented device configuration."""

from __future__ import annotations

import xml.etree.ElementTree as tree
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def format_of(path: Column) -> Column:
    """json, ini, xml or yaml by the suffix of a file name; yaml for any other."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix == "json", "json").when(suffix.isin("ini", "cfg", "conf", "cnf", "properties"), "ini").when(suffix == "xml", "xml").otherwise("yaml")


def scalar_type(v: Column) -> Column:
    """boolean, number or string, as the text of a value says."""
    return F.when(F.lower(v).isin("true", "yes", "on", "false", "no", "off"), "boolean").when(v.try_cast("double").isNotNull(), "number").otherwise("string")


def ini_leaves(docs: DataFrame, key: str = "entity_id", text: str = "text") -> DataFrame:
    """(entity_id, path, value, value_type) of INI and flat key = value texts; repeated keys are joined by a comma, keys are lower-cased.

    Each document's lines stay together, so sections are found by a window over the line number.
    """
    lines = docs.select(F.col(key).alias("entity_id"), F.posexplode(F.split(text, r"\r?\n")).alias("no", "line")).select("entity_id", "no", F.trim("line").alias("line"))
    lines = lines.where("line <> '' and not line rlike '^[#;]'")
    header = F.when(F.col("line").rlike(r"^\[.+\]$"), F.expr("substring(line, 2, length(line) - 2)"))
    lines = lines.withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(Window.partitionBy("entity_id").orderBy("no")))
    pairs = lines.where("header is null and contains(line, '=')").select("entity_id", "no", F.concat_ws(".", "section", F.lower(F.trim(F.substring_index("line", "=", 1)))).alias("path"), F.expr("trim(substring(line, instr(line, '=') + 1))").alias("value"))
    out = pairs.groupBy("entity_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "value"))), lambda x: x["value"]), ",").alias("value"))
    return out.withColumn("value_type", scalar_type(F.col("value")))


def json_leaves(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(entity_id, path, value) of the top-level members of JSON objects, by Variant; what isn't an object has none."""
    v = docs.select(F.col(key).cast("string").alias("entity_id"), F.try_parse_json(F.col(text)).alias("v"))
    return docs.sparkSession.sql("select entity_id, e.key path, cast(e.value as string) value from {v}, lateral variant_explode(v) e", v=v)


def _element(x: tree.Element, path: str, out: list[tuple[str, str]]) -> None:
    name = lambda e: e.tag.rpartition("}")[2]
    for k in sorted(x.attrib):
        out.append((f"{path}.@{k}", x.attrib[k]))
    said = (x.text or "").strip()
    if said:
        out.append((path if not len(x) and not x.attrib else f"{path}._text", said))
    many = Counter(map(name, x))
    seen: Counter = Counter()
    for child in x:
        n = name(child)
        _element(child, f"{path}.{n}" + (f"[{seen[n]}]" if many[n] > 1 else ""), out)
        seen[n] += 1


def xml_pairs(text: str) -> list[tuple[str, str]]:
    """(path, value) of an XML text, without namespaces; none if it isn't well-formed or declares a document type."""
    if text is None or "<!DOCTYPE" in text:
        return []
    try:
        root = tree.fromstring(text)
    except tree.ParseError:
        return []
    out: list[tuple[str, str]] = []
    _element(root, root.tag.rpartition("}")[2], out)
    return out


def config_pairs(text: str) -> list[tuple[str, str]]:
    """(path, value) of indented device configuration: the path holds the parents' words, ``no`` marks a negation, ``!`` a comment."""
    out, stack = [], []
    for line in (text or "").split("\n"):
        words = line.split()
        if not words or words[0].startswith("!"):
            continue
        if words == ["end"]:
            break
        depth = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= depth:
            stack.pop()
        no = words[0] == "no"
        words = words[no:]
        out.append((".".join([*(w for _, w in stack), words[0]]) if words else "", "false" if no else " ".join(words[1:]) or "true"))
        stack.append((depth, ".".join(words)))
    return out


def _pairs(parse) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, *p) for k, t in zip(f.iloc[:, 0], f.iloc[:, 1]) for n, p in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=["entity_id", "no", "path", "value"])

    return run


def parsed_leaves(docs: DataFrame, kind: str, key: str = "entity_id", text: str = "text") -> DataFrame:
    """(entity_id, no, path, value) of XML or device texts, one narrow pass."""
    return docs.select(F.col(key).cast("string"), text).mapInPandas(_pairs({"xml": xml_pairs, "config": config_pairs}[kind]), "entity_id string, no long, path string, value string")
