"""Queries of documents, factoring, types, tiers, serving and questions over the driver's tables, with their SQL.

Documents are made of whole tables: a row or a customer with its orders is one document, nested as configuration is.
Where the SQL states what a lossless round trip must give back, it reads the tables, never the operator's formula.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.functions import secrets
from fleetweave.functions.values import glob_regex
from fleetweave.operators import fleet, hierarchy, profile, questions, relations, sections, tiers
from fleetweave.session import cut, spread
from fleetweave.sources import device, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# documents in four formats, one of each part

_JSON = """to_json(struct(p_name as name, struct(p_brand as brand, p_type as kind) as what, array(p_size, p_size + 1) as sizes, array(struct(p_brand as a, cast(null as string) as b), struct(null as a, p_type as b)) as rows, named_struct('x', struct(p_size as n, p_brand as m), 'y', struct(p_size as n, p_type as m)) as alike, array() as nothing))"""
_YAML = """concat('name: ', p_name, '\\nwhat:\\n  brand: "', p_brand, '"\\n  size: ', p_size, '\\nsizes:\\n- ', p_size, '\\n- ', p_size + 1, '\\nnone: null\\n')"""
_INI = """concat('[brand]\\nName = ', p_brand, '\\n; note\\nsize=', p_size, '\\nsize=', p_size + 1, '\\n[kind]\\nType = ', p_type)"""
_FLAT = """concat('# note\\nPort ', p_size, '\\nName ', p_brand, '\\nVerbose')"""
_XML = """concat('<x:part xmlns:x="u" id="', p_partkey, '"><size>', p_size, '</size><size>', p_size + 1, '</size><brand kind="b">', p_brand, '</brand>', p_type, '</x:part>')"""


def _parts(spark: SparkSession, sf_dir: str, form: str, text: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit(form).alias("format"), F.expr(text).alias("text"))


def _parsed(form: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: documents.parse(_parts(s, d, form, text))


def _rows(pairs: list[tuple[str, str]], table: str = "part", key: str = "p_partkey", extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT CAST({key} AS VARCHAR) AS entity_id, {p if p.startswith('concat') else repr(p)} AS path{extra}, {v} AS value FROM {table}" for p, v in pairs)


_SIZES = "CAST(p_size AS VARCHAR) || ',' || CAST(p_size + 1 AS VARCHAR)"
_FLAT_JSON = [("name", "p_name"), ("what.brand", "p_brand"), ("what.kind", "p_type"), ("sizes", _SIZES)]
_MEMBERS = [("alike.x.n", "CAST(p_size AS VARCHAR)"), ("alike.x.m", "p_brand"), ("alike.y.n", "CAST(p_size AS VARCHAR)"), ("alike.y.m", "p_type"), ("rows[0].a", "p_brand"), ("rows[1].b", "p_type")]
_attrs = lambda form, text, **k: lambda s, d: documents.attributes(_parsed(form, text)(s, d), **k)
_add("flatten_json", lambda s, d: _attrs("json", _JSON)(s, d).where("attr_type = 'string'").drop("attr_type"), _rows(_FLAT_JSON))
_add("flatten_composites", lambda s, d: documents.attribute_leaves(_attrs("json", _JSON)(s, d)), _rows(_FLAT_JSON + _MEMBERS))
_add("composite_kinds", lambda s, d: _attrs("json", _JSON)(s, d).groupBy("path", "attr_type").agg(F.count("*").alias("n")), "SELECT path, attr_type, (SELECT count(*) FROM part) AS n FROM (VALUES ('name', 'string'), ('what.brand', 'string'), ('what.kind', 'string'), ('sizes', 'string'), ('rows', 'list'), ('alike', 'map')) v(path, attr_type)")
_add("composite_override", lambda s, d: _attrs("json", _JSON, overrides={"wh*": "map", "al*": "list"})(s, d).where("attr_type <> 'string'").groupBy("path", "attr_type").agg(F.count("*").alias("n")), "SELECT path, attr_type, (SELECT count(*) FROM part) AS n FROM (VALUES ('what', 'map'), ('rows', 'list'), ('alike', 'list')) v(path, attr_type)")
_add("source_leaves", lambda s, d: documents.source_leaves(_parsed("json", _JSON)(s, d)), _rows(_FLAT_JSON + _MEMBERS))
_add("strict_fidelity", lambda s, d: (lambda p: documents.fidelity(documents.source_leaves(p), documents.attribute_leaves(documents.attributes(p))).agg(F.count("*").alias("differences")))(_parsed("json", _JSON)(s, d)), "SELECT CAST(0 AS BIGINT) AS differences")
_add(
    "strict_fidelity_broken",
    lambda s, d: (lambda p: documents.fidelity(documents.source_leaves(p), documents.attribute_leaves(documents.attributes(p)).where("path <> 'name'")).select("entity_id", F.element_at("tokens", 1).alias("word"), "surplus"))(_parsed("json", _JSON)(s, d)),
    "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, 'name' AS word, CAST(1 AS BIGINT) AS surplus FROM part",
)
_add("read_yaml", lambda s, d: _attrs("yaml", _YAML)(s, d).drop("attr_type"), _rows([("name", "p_name"), ("what.brand", "p_brand"), ("what.size", "CAST(p_size AS VARCHAR)"), ("sizes", _SIZES)]))
_add("read_ini", lambda s, d: _attrs("ini", _INI)(s, d).drop("attr_type"), _rows([("brand.name", "p_brand"), ("brand.size", _SIZES), ("kind.type", "p_type")]))
_add("read_words", lambda s, d: _attrs("ini", _FLAT)(s, d).drop("attr_type"), _rows([("Port", "CAST(p_size AS VARCHAR)"), ("Name", "p_brand"), ("Verbose", "'true'")]))
_add("read_xml", lambda s, d: _attrs("xml", _XML)(s, d).drop("attr_type"), _rows([("part.@id", "CAST(p_partkey AS VARCHAR)"), ("part.size", _SIZES), ("part.brand.@kind", "'b'"), ("part.brand._text", "p_brand"), ("part._text", "p_type")]))
_add("parse_errors", lambda s, d: documents.parse(_parts(s, d, "xml", "concat('<a>', p_name)")).groupBy(F.substring_index("error", ":", 1).alias("error")).agg(F.count("*").alias("n"), F.count("doc").alias("parsed")), "SELECT 'ParseError' AS error, count(*) AS n, CAST(0 AS BIGINT) AS parsed FROM part")
_DOC = "case pmod(p_partkey, 5) when 0 then '{\"apiVersion\": 1, \"kind\": 2}' when 1 then '{\"services\": {\"a\": {\"image\": 1}}}' when 2 then '[{\"hosts\": 1, \"tasks\": []}]' when 3 then '{\"packages\": [], \"users\": []}' else '{\"x\": 1}' end"
_add("detect_platform", lambda s, d: documents.parse(_parts(s, d, "json", _DOC)).select("entity_id", "platform"), "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CASE p_partkey % 5 WHEN 0 THEN 'kubernetes' WHEN 1 THEN 'docker-compose' WHEN 2 THEN 'ansible-playbook' WHEN 3 THEN 'cloud-init' END AS platform FROM part")
_SPEC = [("*BRASS", "metal"), ("STANDARD*", "plain"), ("*", "other")]
_add("match_spec", lambda s, d: documents.match_spec(_read(s, d, "part").select("p_partkey", F.col("p_type").alias("entity_id")), _SPEC).groupBy("entity_id", "platform", "entry").agg(F.count("*").alias("n")), "SELECT p_type AS entity_id, CASE WHEN p_type LIKE '%BRASS' THEN 'metal' WHEN p_type LIKE 'STANDARD%' THEN 'plain' ELSE 'other' END AS platform, CASE WHEN p_type LIKE '%BRASS' THEN 0 WHEN p_type LIKE 'STANDARD%' THEN 1 ELSE 2 END AS entry, count(*) AS n FROM part GROUP BY ALL")
_GRAPH = """to_json(map('displayName', c_name, '@odata.type', if(c_nationkey < 10, '#g.group', '#g.user'), 'id', cast(c_custkey as string), 'segment', c_mktsegment))"""
_add("graph_objects", lambda s, d: documents.attributes(documents.graph_objects(_read(s, d, "customer").select(F.expr(_GRAPH).alias("text")), {"#g.group": "group"}).select("entity_id", "doc"), joint=", ").drop("attr_type"), "SELECT c_name AS entity_id, unnest(['displayName', 'segment']) AS path, unnest([c_name, c_mktsegment]) AS value FROM customer")
_add("graph_types", lambda s, d: documents.graph_objects(_read(s, d, "customer").select(F.expr(_GRAPH).alias("text")), {"#g.group": "group"}).select("entity_id", "type_hint"), "SELECT c_name AS entity_id, CASE WHEN c_nationkey < 10 THEN 'group' ELSE '#g.user' END AS type_hint FROM customer")
_add("entity_boundary", lambda s, d: _read(s, d, "pages").select("page_id", documents.entity_of(F.lit(None).cast("string"), F.regexp_replace("url", r"[?#].*$", "")).alias("entity_id")), r"SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS entity_id FROM pages")
_add("detect_format_names", lambda s, d: _read(s, d, "part").select("p_partkey", documents.format_of(F.expr("concat(p_name, case pmod(p_partkey, 5) when 0 then '.JSON' when 1 then '.conf' when 2 then '.xml' when 3 then '.yml' else '' end)")).alias("format")), "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'ini' WHEN 2 THEN 'xml' ELSE 'yaml' END AS format FROM part")
_add("coerce_scalars", lambda s, d: documents.section_leaves(documents.parse(_parts(s, d, "ini", "concat('[s]\\na = ', p_size, '\\nb = ', p_brand, '\\nc = yes\\nd = ', p_size, '.5'"+")"))).groupBy("path", "value_type").agg(F.count("*").alias("n")), "SELECT path, value_type, (SELECT count(*) FROM part) AS n FROM (VALUES ('a', 'int'), ('b', 'str'), ('c', 'bool'), ('d', 'float')) v(path, value_type)")
_add("sample_texts", lambda s, d: documents.sample_texts(_read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", F.length("text").cast("long").alias("n")), "SELECT doc_id AS id, CAST(floor(length(text) * 50000 / sum(length(text)) OVER ()) AS BIGINT) AS n FROM documents")

# sections: orders of a customer are a host's sections

_HOST = """SELECT o_custkey, concat('c', o_custkey) AS host, to_json(map_from_entries(array_sort(collect_list(struct(section, body))))) AS text FROM (
 SELECT o_custkey, concat('s_', lower(substring(o_orderpriority, 3))) AS section, struct(max(o_orderstatus) AS status, struct(count(*) AS n, min(year(o_orderdate)) AS since) AS stats, 'x' AS fixed, true AS flag, array(1, 2) AS list) AS body FROM orders GROUP BY 1, 2) GROUP BY 1, 2"""


def _host_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by customer, so that the groups need no other exchange and their documents are parsed in as many parts
    hosts = spark.sql(_HOST.replace("FROM orders", "FROM {o}"), o=spread(_read(spark, sf_dir, "orders"), "o_custkey", each=50_000))
    return documents.section_leaves(documents.parse(hosts.select(F.col("host").alias("entity_id"), F.lit("json").alias("format"), "text")))


_HL = """hl AS MATERIALIZED (SELECT host, section, 'dict' AS shape, unnest(['status', 'stats.n', 'stats.since', 'fixed', 'flag', 'list']) AS path, unnest(['str', 'int', 'int', 'str', 'bool', 'list']) AS value_type, unnest(['"' || st || '"', CAST(n AS VARCHAR), CAST(y AS VARCHAR), '"x"', 'true', '[1,2]']) AS value
 FROM (SELECT 'c' || o_custkey AS host, 's_' || lower(substring(o_orderpriority, 3)) AS section, max(o_orderstatus) AS st, count(*) AS n, min(year(o_orderdate)) AS y FROM orders GROUP BY 1, 2))"""
#: the classes of sections by brute force: all sets of leaves that two hosts or more share
_EXACT = """sg AS MATERIALIZED (SELECT section, host, string_agg(path || chr(1) || value_type || chr(1) || value, chr(2) ORDER BY path) AS sig FROM hl GROUP BY 1, 2),
ex AS MATERIALIZED (SELECT section, sig, count(*) AS n, min(host) AS first FROM sg GROUP BY 1, 2 HAVING count(*) >= 2),
nm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY section ORDER BY first) - 1 AS idx FROM ex)"""


def _factored(spark: SparkSession, sf_dir: str) -> sections.Factored:
    return sections.factor(_host_leaves(spark, sf_dir))


_add("section_leaves", _host_leaves, f"WITH {_HL} SELECT * FROM hl")
_add("section_rebuilt", lambda s, d: documents.section_leaves(documents.rebuilt(_host_leaves(s, d)).groupBy("host").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.to_json(F.array("section")).substr(F.lit(2), F.length(F.to_json(F.array("section"))) - 2), F.lit(":"), "data")), ","), F.lit("}")).alias("doc")).select(F.col("host").alias("entity_id"), "doc")), f"WITH {_HL} SELECT * FROM hl")
_add("section_kinds", lambda s, d: documents.section_kinds(_host_leaves(s, d)), f"WITH {_HL} SELECT section, 'dict' AS shape, count(DISTINCT host) AS hosts FROM hl GROUP BY 1")
_add("exact_groups", lambda s, d: sections.classes(_host_leaves(s, d)).groupBy("section", "index").agg(F.count("*").alias("fields")), f"WITH {_HL}, {_EXACT} SELECT section, idx AS index, CAST(6 AS BIGINT) AS fields FROM nm")
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose section no other host has alike, with the class nearest to it."""
    lv = cut(_host_leaves(spark, sf_dir))
    f = sections.factor(lv)
    alone = lv.groupBy("section", "host").agg(*sections.signature()).groupBy("section", "sig").agg(F.count("*").alias("k"), F.first("host").alias("host")).where("k = 1")
    near = sections.assign(cut(lv.join(alone.select("section", "host"), ["section", "host"], "left_semi")), f.classes, f.identities, 40.0)
    return near.join(f.classes.select("section", "class", "index").distinct(), ["section", "class"]).select("section", "host", "index", "cost")


_add(
    "nearest_class",
    _nearest,
    f"WITH {_HL}, {_EXACT}, cf AS (SELECT nm.section, idx, hl.path, hl.value_type, hl.value FROM nm JOIN hl ON hl.section = nm.section AND hl.host = nm.first), al AS (SELECT sg.section, sg.host FROM sg JOIN (SELECT section, sig FROM sg GROUP BY 1, 2 HAVING count(*) = 1) USING (section, sig)), co AS (SELECT al.section, al.host, idx, count(*) FILTER (hl.value_type <> cf.value_type OR hl.value <> cf.value) AS cost FROM al JOIN hl USING (section, host) JOIN cf ON cf.section = al.section AND cf.path = hl.path GROUP BY 1, 2, 3) SELECT section, host, idx AS index, cost FROM (SELECT *, row_number() OVER (PARTITION BY section, host ORDER BY cost, idx) AS k FROM co WHERE cost * 100 <= 40 * 6) WHERE k = 1",
)
_add("sections_rebuilt", lambda s, d: sections.rebuild(_factored(s, d)), f"WITH {_HL} SELECT section, host, path, value_type, value FROM hl")
_add("sections_mismatch", lambda s, d: (lambda lv: sections.differences(lv, sections.rebuild(sections.factor(lv, 100, 40.0))).agg(F.count("*").alias("differences")))(cut(_host_leaves(s, d))), "SELECT CAST(0 AS BIGINT) AS differences")
_add("sections_dissolved", lambda s, d: sections.rebuild(sections.dissolve(_factored(s, d))), f"WITH {_HL} SELECT section, host, path, value_type, value FROM hl")
_add("class_members", lambda s, d: _factored(s, d).members.groupBy("section").agg(F.count("*").alias("hosts"), F.count("class").alias("placed")), f"WITH {_HL}, {_EXACT}, cf AS (SELECT nm.section, idx, hl.path, hl.value_type, hl.value FROM nm JOIN hl ON hl.section = nm.section AND hl.host = nm.first), al AS (SELECT sg.section, sg.host, sg.sig FROM sg), ok AS (SELECT DISTINCT al.section, al.host FROM al JOIN hl USING (section, host) JOIN cf ON cf.section = al.section AND cf.path = hl.path GROUP BY al.section, al.host, idx HAVING count(*) FILTER (hl.value_type <> cf.value_type OR hl.value <> cf.value) * 100 <= 20 * 6) SELECT section, count(*) AS hosts, count(ok.host) AS placed FROM al LEFT JOIN ok USING (section, host) GROUP BY 1")
_add("collapsed_sections", lambda s, d: sections.collapsed(_factored(s, d)).select("host", F.array_join("sections", ",").alias("sections")), f"WITH {_HL}, {_EXACT} SELECT host, string_agg(section, ',' ORDER BY section) AS sections FROM sg JOIN nm USING (section, sig) WHERE idx = 0 GROUP BY 1")
_META = f"WITH {_HL}, {_EXACT}, cf AS (SELECT nm.section, idx, hl.path, hl.value_type, hl.value FROM nm JOIN hl ON hl.section = nm.section AND hl.host = nm.first), co AS (SELECT hl.section, hl.host, idx, count(*) FILTER (hl.value_type <> cf.value_type OR hl.value <> cf.value) AS cost FROM hl JOIN cf ON cf.section = hl.section AND cf.path = hl.path GROUP BY 1, 2, 3 HAVING count(*) FILTER (hl.value_type <> cf.value_type OR hl.value <> cf.value) * 100 <= 120), be AS (SELECT section, host, min(cost) AS cost FROM co GROUP BY 1, 2), mt AS (SELECT host, CAST(sum(coalesce(cost, 6)) AS BIGINT) AS total_delta, count(*) AS section_count, bool_and(coalesce(cost, 6) = 0) AS is_zero_delta FROM sg LEFT JOIN be USING (section, host) GROUP BY 1)"
_add("host_meta", lambda s, d: fleet.host_meta(_factored(s, d)).drop("class_profile"), f"{_META} SELECT * FROM mt")
_add("fleet_summary", lambda s, d: fleet.summary(_factored(s, d)), f"{_META} SELECT count(*) AS hosts, count(*) FILTER (is_zero_delta) AS zero_delta_hosts, (SELECT count(*) FROM nm) AS classes FROM mt")
_add("top_delta", lambda s, d: fleet.by_delta(_factored(s, d)).limit(10).select("host", "total_delta"), f"{_META} SELECT host, total_delta FROM mt ORDER BY total_delta DESC, host LIMIT 10")
_add("hosts_by_delta", lambda s, d: fleet.by_delta(_factored(s, d), 1).select("host", "total_delta"), f"{_META} SELECT host, total_delta FROM mt WHERE total_delta >= 1")
_add("host_order", lambda s, d: fleet.host_order(fleet.host_meta(_factored(s, d))).select("host", F.col("place").cast("long").alias("place")), f"{_META}, z AS (SELECT host FROM mt WHERE total_delta = 0 ORDER BY host LIMIT 3) SELECT host, row_number() OVER (ORDER BY CASE WHEN host IN (SELECT host FROM z) THEN 0 WHEN total_delta > 0 THEN 1 ELSE 2 END, total_delta DESC, host) - 1 AS place FROM mt")
_add("class_distribution", lambda s, d: fleet.class_distribution(_factored(s, d)).select("hosts", "fields").groupBy("fields").agg(F.sum("hosts").alias("placed"), F.count("*").alias("classes")), f"{_META} SELECT CAST(6 AS BIGINT) AS fields, CAST((SELECT count(*) FROM be) AS BIGINT) AS placed, (SELECT count(*) FROM nm) AS classes")
_add("class_references", lambda s, d: fleet.class_refs(_factored(s, d)).select("host", F.size("classes").cast("long").alias("n")), f"{_META} SELECT host, count(*) AS n FROM be GROUP BY 1")
_add("section_hosts", lambda s, d: fleet.hosts_of(_host_leaves(s, d), "s_urgent"), f"WITH {_HL} SELECT DISTINCT host FROM hl WHERE section = 's_urgent'")
_add("section_filter", lambda s, d: fleet.with_sections(_host_leaves(s, d), ["s_urgent", "s_low"]).groupBy("section", "path").agg(F.count("*").alias("n")), f"WITH {_HL} SELECT section, path, count(*) AS n FROM hl WHERE section IN ('s_urgent', 's_low') GROUP BY 1, 2")
_add("compression_stats", lambda s, d: (lambda lv: fleet.compression_stats(lv, sections.factor(lv)).select("section", "host", "bytes", "leaves"))(_host_leaves(s, d)), f"WITH {_HL} SELECT section, host, CAST(sum(strlen(path) + strlen(value)) AS BIGINT) AS bytes, count(*) AS leaves FROM hl GROUP BY ROLLUP (section, host)")
_add("host_files", lambda s, d: fleet.host_yaml(_factored(s, d)))

# lists: the turns of a conversation are a list of instances

_TURNS = "to_json(struct(array_sort(collect_list(struct(turn, role, length(text) % 3 AS size, 'v' AS a, 'w' AS b))) AS turns))"


def _list_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("k"), "conv_id").alias("entity_id")).agg(F.expr(_TURNS).alias("text"))
    return documents.section_leaves(documents.parse(docs.select("entity_id", F.lit("json").alias("format"), "text")))


_TL = "tl AS (SELECT 'k' || conv_id AS host, '[' || i || '].' AS pre, turn, role, length(text) % 3 AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text) % 3) - 1 AS i FROM conversations)), ll AS (SELECT 'turns' AS section, host, unnest([pre || 'turn', pre || 'role', pre || 'size', pre || 'a', pre || 'b']) AS path, unnest(['int', 'str', 'int', 'str', 'str']) AS value_type, unnest([CAST(turn AS VARCHAR), '\"' || role || '\"', CAST(size AS VARCHAR), '\"v\"', '\"w\"']) AS value FROM tl)"
_add("list_leaves", lambda s, d: _list_leaves(s, d).drop("shape"), f"WITH {_TL} SELECT * FROM ll")
_add("list_rebuilt", lambda s, d: sections.rebuild_lists(sections.factor_lists(_list_leaves(s, d))), f"WITH {_TL} SELECT * FROM ll")
_add("list_classes", lambda s, d: sections.factor_lists(_list_leaves(s, d)).classes.groupBy("class").agg(F.count("*").alias("fields")).agg(F.count("*").alias("classes"), F.min("fields").alias("fields")), f"WITH {_TL} SELECT count(*) AS classes, CAST(5 AS BIGINT) AS fields FROM (SELECT turn, role, size FROM tl GROUP BY 1, 2, 3 HAVING count(*) >= 3)")
_add("list_instances", lambda s, d: sections.factor_lists(_list_leaves(s, d)).instances.agg(F.count("*").alias("n"), F.count("class").alias("placed")), f"WITH {_TL} SELECT (SELECT count(*) FROM tl) AS n, CAST((SELECT sum(c) FROM (SELECT count(*) AS c FROM tl GROUP BY turn, role, size HAVING count(*) >= 3)) AS BIGINT) AS placed")

# types, classes, tiers: parts and suppliers as one fleet of entities


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers and nations as entities with a few dozen distinct values a path, so that classes exist."""
    p = spread(_read(spark, sf_dir, "part"), "p_partkey").selectExpr("concat('part-', p_partkey) e", "inline(array(struct('hw.brand' path, p_brand value), struct('hw.kind' path, substring_index(p_type, ' ', 1) value), struct('hw.metal' path, substring_index(p_type, ' ', -1) value), struct('name' path, p_name value), struct('fixed' path, 'yes' value), struct('size.class' path, if(p_size > 40, 'large', null) value), struct('price' path, cast(p_retailprice as string) value)))")
    o = spread(_read(spark, sf_dir, "supplier"), "s_suppkey").selectExpr("concat('supplier-', s_suppkey) e", "inline(array(struct('org.nation' path, cast(s_nationkey as string) value), struct('org.name' path, s_name value), struct('fixed' path, 'no' value), struct('org.tier' path, if(s_acctbal > 0, 'gold', 'tin') value), struct('org.mail' path, 'on' value)))")
    return p.unionByName(o).where("value is not null").select(F.col("e").alias("entity_id"), "path", F.lit("string").alias("attr_type"), "value")


_AT = """at_ AS MATERIALIZED (SELECT * FROM (SELECT 'part-' || p_partkey AS entity_id, unnest(['hw.brand', 'hw.kind', 'hw.metal', 'name', 'fixed', 'size.class', 'price']) AS path, unnest([p_brand, string_split(p_type, ' ')[1], string_split(p_type, ' ')[-1], p_name, 'yes', CASE WHEN p_size > 40 THEN 'large' END, CAST(p_retailprice AS VARCHAR)]) AS value FROM part
 UNION ALL SELECT 'supplier-' || s_suppkey, unnest(['org.nation', 'org.name', 'fixed', 'org.tier', 'org.mail']), unnest([CAST(s_nationkey AS VARCHAR), s_name, 'no', CASE WHEN s_acctbal > 0 THEN 'gold' ELSE 'tin' END, 'on']) FROM supplier) WHERE value IS NOT NULL)"""
_HINT = "CASE WHEN entity_id LIKE 'part-%' THEN 'part' ELSE 'supplier' END"


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    typed = cut(_attributes(spark, sf_dir).withColumn("type_id", F.substring_index("entity_id", "-", 1)))
    return typed.select("entity_id", "type_id").distinct(), typed, cut(profile.profile(typed, "type_id"))


def _engine(name: str) -> Callable[[SparkSession, str], tuple]:
    def build(spark: SparkSession, sf_dir: str) -> tuple:
        types, typed, profiles = _typed(spark, sf_dir)
        h = hierarchy.ENGINES.get(name)(typed, profiles, hierarchy.Config())
        return types, typed, profiles, h, tiers.tier_c(typed, profiles, h)

    return build


_greedy, _arch = _engine("greedy-bundle"), _engine("archetypal")
_add("type_seeding", lambda s, d: hierarchy.seed(_attributes(s, d)).groupBy("type_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("first")), f"WITH {_AT} SELECT CASE WHEN {_HINT} = 'part' THEN 'unknown-0' ELSE 'unknown-1' END AS type_id, count(DISTINCT entity_id) AS n, min(entity_id) AS first FROM at_ GROUP BY 1")
_add("type_hints", lambda s, d: hierarchy.seed(_attributes(s, d), _attributes(s, d).where("path = 'hw.metal'").select("entity_id", F.col("value").alias("hint"))).groupBy("type_id").agg(F.count("*").alias("n")), f"WITH {_AT}, t AS (SELECT a.entity_id, coalesce(max(b.value), 'unknown-0') AS type_id FROM at_ a LEFT JOIN at_ b ON a.entity_id = b.entity_id AND b.path = 'hw.metal' GROUP BY 1) SELECT type_id, count(*) AS n FROM t GROUP BY 1")
_add("type_bootstrap", lambda s, d: hierarchy.bootstrap(_attributes(s, d))[0].groupBy("type_id").agg(F.count("*").alias("n")))
_add("type_profiles", lambda s, d: _typed(s, d)[2], profile.profile_sql(f"SELECT *, {_HINT} AS type_id FROM (WITH {_AT} SELECT * FROM at_)", "type_id"))
_BASE = f"{_AT}, ty AS (SELECT *, {_HINT} AS type_id FROM at_), nt AS (SELECT type_id, count(DISTINCT entity_id) AS total FROM ty GROUP BY 1), bs AS (SELECT type_id, path, min(value) AS value FROM ty JOIN nt USING (type_id) GROUP BY 1, 2, total HAVING count(*) = total AND count(DISTINCT value) = 1), ro AS ({profile.profile_sql('SELECT * FROM ty', 'type_id')}), vc AS MATERIALIZED (SELECT ty.type_id, entity_id, path, value FROM ty JOIN ro USING (type_id, path) WHERE role = 'B' AND (ty.type_id, path) NOT IN (SELECT (type_id, path) FROM bs))"
_add("base_class", lambda s, d: _greedy(s, d)[3].base, f"WITH {_BASE} SELECT * FROM bs")
_BUNDLES = f"{_BASE}, it AS MATERIALIZED (SELECT type_id, entity_id, path, value, length(path) / 4.0 + length(value) / 4.0 + 2 AS cost FROM vc), bu AS (SELECT type_id, path AS p1, value AS v1, NULL AS p2, NULL AS v2, NULL AS p3, NULL AS v3, 1 AS size, count(*) AS support, min(cost) AS cost FROM it GROUP BY ALL UNION ALL SELECT a.type_id, a.path, a.value, b.path, b.value, NULL, NULL, 2, count(*), min(a.cost + b.cost) FROM it a JOIN it b ON a.entity_id = b.entity_id AND a.path < b.path GROUP BY ALL UNION ALL SELECT a.type_id, a.path, a.value, b.path, b.value, c.path, c.value, 3, count(*), min(a.cost + b.cost + c.cost) FROM it a JOIN it b ON a.entity_id = b.entity_id AND a.path < b.path JOIN it c ON c.entity_id = a.entity_id AND b.path < c.path GROUP BY ALL), ga AS (SELECT *, support * cost - (cost + 8 + support * 4) AS gain FROM bu WHERE support >= 3)"
_names = lambda k: [F.get(F.col("items"), F.lit(j)).getField(c).alias(f"{a}{j + 1}") for j in range(k) for a, c in (("p", "path"), ("v", "value"))]
_add("frequent_bundles", lambda s, d: (lambda t: hierarchy.bundle_gain(hierarchy.bundles(hierarchy.residual(t[1], t[2], hierarchy.base_class(t[1], t[2])), ["type_id"], 3, 3)).select("type_id", *_names(3), "size", "support", F.round("gain", 4).alias("gain")))(_typed(s, d)), f"WITH {_BUNDLES} SELECT type_id, p1, v1, p2, v2, p3, v3, size, support, round(gain, 4) AS gain FROM ga")
_add(
    "first_class",
    lambda s, d: (lambda h: h.classes.join(h.classes.join(h.members, ["type_id", "class"]).groupBy("type_id", "class").agg(F.count_distinct("entity_id").alias("n")), ["type_id", "class"]).groupBy("type_id", "class", "n").agg(F.sum(F.expr(hierarchy.COST)).alias("c")).withColumn("gain", F.round(F.expr("n * c - (c + 8 + n * 4)"), 4)).groupBy("type_id").agg(F.max("gain").alias("gain")))(_greedy(s, d)[3]),
    f"WITH {_BUNDLES} SELECT type_id, round(max(gain), 4) AS gain FROM ga WHERE gain > 0 GROUP BY 1",
)
_WHOLE = f"WITH {_AT} SELECT entity_id, path, value FROM at_"
for _n, _b in (("greedy", _greedy), ("archetypal", _arch)):
    _add(f"{_n}_reconstitute", lambda s, d, b=_b: (lambda t: tiers.reconstitute(t[3], t[4]).select("entity_id", "path", "value"))(b(s, d)), _WHOLE)
    _add(f"{_n}_mismatches", lambda s, d, b=_b: (lambda t: tiers.mismatches(t[1], tiers.reconstitute(t[3], t[4])).agg(F.count("*").alias("mismatches")))(b(s, d)), "SELECT CAST(0 AS BIGINT) AS mismatches")
    _add(f"{_n}_invariants", lambda s, d, b=_b: (lambda t: tiers.invariants(t[0], t[3], t[4], t[2]).agg(F.count("*").alias("broken")))(b(s, d)), "SELECT CAST(0 AS BIGINT) AS broken")
    _add(f"{_n}_tier_a", lambda s, d, b=_b: (lambda t: tiers.tier_a(t[3], t[4]).select("type_id", "entities"))(b(s, d)), f"WITH {_AT} SELECT {_HINT} AS type_id, count(DISTINCT entity_id) AS entities FROM at_ GROUP BY 1")
_add("phone_book_cells", lambda s, d: _greedy(s, d)[4].phone_book.groupBy("type_id", "path").agg(F.count("*").alias("n")), f"WITH {_BASE} SELECT type_id, path, n FROM ro WHERE storage = 'PHONE_BOOK'")
_add("instance_attributes", lambda s, d: _greedy(s, d)[4].instance_attrs, f"WITH {_BASE} SELECT ty.type_id, entity_id, path, value FROM ty JOIN ro USING (type_id, path) WHERE storage = 'INSTANCE_ATTRS'")
_add("layers_shown", lambda s, d: (lambda t: tiers.layered_view(t[3], t[4]).where("layer in ('base', 'phone_book', 'instance')").groupBy("type_id", "path", "layer").agg(F.count("*").alias("n")))(_greedy(s, d)), f"WITH {_BASE} SELECT type_id, path, CASE WHEN role = 'A_BASE' OR (type_id, path) IN (SELECT (type_id, path) FROM bs) THEN 'base' WHEN storage = 'PHONE_BOOK' THEN 'phone_book' ELSE 'instance' END AS layer, n FROM ro WHERE role <> 'B' OR (type_id, path) IN (SELECT (type_id, path) FROM bs)")
_SUBJECT = tiers.Subject("hardware", ("hw.**",), ("fixed",))
_RX = "|".join(f"({glob_regex(g)})" for g in ("hw.**", "fixed"))
_add("projection", lambda s, d: (lambda t: tiers.layered_view(*tiers.project(t[3], t[4], _SUBJECT)).select("entity_id", "path", "value"))(_greedy(s, d)), f"WITH {_AT} SELECT entity_id, path, value FROM at_ WHERE regexp_matches(path, '{_RX}')")
_add("projection_errors", lambda s, d: (lambda t: tiers.projection_errors(t[1], tiers.layered_view(*tiers.project(t[3], t[4], _SUBJECT)), _SUBJECT).agg(F.count("*").alias("errors")))(_arch(s, d)), "SELECT CAST(0 AS BIGINT) AS errors")
_add("hierarchy_paths", lambda s, d: (lambda t: tiers.hierarchy_paths(t[3], t[4]))(_greedy(s, d)), f"WITH {_AT} SELECT DISTINCT {_HINT} AS type_id, path FROM at_")
_add("tier_b", lambda s, d: tiers.tier_b_json(_greedy(s, d)[3]))
_add("type_counts", lambda s, d: (lambda t: tiers.type_stats(t[3], t[4], t[2]).select("type_id", "base_attrs", "phone_book_paths"))(_greedy(s, d)), f"WITH {_BASE} SELECT type_id, (SELECT count(*) FROM bs WHERE bs.type_id = nt.type_id) AS base_attrs, (SELECT count(*) FROM ro WHERE ro.type_id = nt.type_id AND storage = 'PHONE_BOOK') AS phone_book_paths FROM nt")

# composites of a customer: a map of its orders by year, and the list of their priorities

_COMP = """SELECT concat('c', o_custkey) AS entity_id, to_json(struct(map_from_entries(array_sort(collect_list(struct(y, struct(p, s, 'x' AS fixed))))) AS years, array_sort(collect_set(named_struct('p', p))) AS kinds)) AS text
 FROM (SELECT o_custkey, cast(year(o_orderdate) as string) AS y, max(o_orderpriority) AS p, max(o_orderstatus) AS s FROM {o} GROUP BY 1, 2) GROUP BY o_custkey"""


def _composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.sql(_COMP, o=_read(spark, sf_dir, "orders")).select("entity_id", F.lit("json").alias("format"), "text")
    return documents.attributes(documents.parse(docs)).withColumn("type_id", F.lit("customer"))


_YR = "yr AS (SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y, max(o_orderpriority) AS p, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2), sg AS (SELECT o_custkey FROM yr GROUP BY 1)"
_add("map_template", lambda s, d: tiers.map_templates(_composites(s, d))[0].select("path", F.explode("content").alias("k", "v")), f"WITH {_YR}, kv AS (SELECT o_custkey, y, unnest(['p', 's', 'fixed']) AS k, unnest([p, s, 'x']) AS v FROM yr), c AS (SELECT k, v, count(*) AS n, min('c' || o_custkey || ' ' || y) AS first FROM kv GROUP BY 1, 2) SELECT 'years' AS path, k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, first) AS r FROM c) WHERE r = 1")
_add("map_rebuilt", lambda s, d: (lambda t: tiers.map_values(*t).select("entity_id", F.explode(F.from_json("value", tiers.MAP)).alias("y", "m")).select("entity_id", "y", "m.p", "m.s", "m.fixed"))(tiers.map_templates(_composites(s, d))), f"WITH {_YR} SELECT 'c' || o_custkey AS entity_id, y, p, s, 'x' AS fixed FROM yr")
_add("list_template", lambda s, d: tiers.list_templates(_composites(s, d))[0].select("path", "template_id"), f"WITH {_YR}, l AS (SELECT string_agg(DISTINCT p, '|' ORDER BY p) AS v FROM yr GROUP BY o_custkey), t AS (SELECT v FROM l GROUP BY 1 HAVING count(*) >= 2) SELECT 'kinds' AS path, 'customer.kinds.T' || (row_number() OVER () - 1) AS template_id FROM t")
_add("template_references", lambda s, d: (lambda t: (lambda ts: tiers.expand_references(tiers.with_references(t, ts[1]), ts[0]).join(t.withColumnRenamed("value", "was"), ["entity_id", "path"]).agg(F.count("*").alias("n"), F.count_if(F.expr("value <=> was")).alias("same")))(tiers.list_templates(t)))(_composites(s, d)), f"WITH {_YR} SELECT 2 * count(*) AS n, 2 * count(*) AS same FROM sg")
_add("reprofile", lambda s, d: (lambda t: profile.profile(tiers.with_references(t, tiers.list_templates(t)[1]).where("path = 'kinds'"), "type_id").select("path", "n"))(_composites(s, d)), f"WITH {_YR} SELECT 'kinds' AS path, count(*) AS n FROM sg")

# relationships


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) entity_id", "inline(array(struct('home' path, cast(c_nationkey as string) value), struct('peers' path, concat('c', c_custkey + 1, ', c', c_custkey + 7, ', x') value)))")
    n = _read(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) entity_id", "'code' path", "cast(n_nationkey as string) value")
    return c.unionByName(n)


_add("hinted_relations", lambda s, d: relations.hinted(_people(s, d), [("home", "code", "lives_in")]), "SELECT 'c' || c_custkey AS src, 'lives_in' AS label, 'n' || c_nationkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("hinted_groups", lambda s, d: relations.hinted_groups(_people(s, d), [("home", "home", "same_home")]), "SELECT 'same_home' AS label, CAST(c_nationkey AS VARCHAR) AS value, count(*) AS sources, count(*) AS targets FROM customer GROUP BY c_nationkey")
_add("known_references", lambda s, d: relations.known(_people(s, d), ["peers"], _people(s, d), "peer"), "SELECT 'c' || a.c_custkey AS src, 'peer' AS label, 'c' || b.c_custkey AS dst FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 OR b.c_custkey = a.c_custkey + 7")
_add("unknown_references", lambda s, d: relations.unknown(_people(s, d), ["peers"], _people(s, d)), "SELECT 'c' || c_custkey AS src, p AS dst FROM (SELECT c_custkey, unnest(['c' || (c_custkey + 1), 'c' || (c_custkey + 7), 'x']) AS p FROM customer) WHERE p NOT IN (SELECT 'c' || c_custkey FROM customer)")
_add("named_members", lambda s, d: relations.named(_read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("entity_id")).agg(F.collect_set("o_custkey").alias("members")), _read(s, d, "customer").selectExpr("c_custkey", "c_name name"), "c_custkey", "assigned"), "SELECT DISTINCT o_orderpriority AS src, 'assigned' AS label, c_name AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
_add("type_topology", lambda s, d: (lambda p: tiers.topology(relations.hinted(p, [("home", "code", "lives_in")]).unionByName(relations.known(p, ["peers"], p, "peer")), p.select("entity_id", F.substring("entity_id", 1, 1).alias("type_id")).distinct()))(_people(s, d)), "SELECT 'c' AS src_type, 'lives_in' AS label, 'n' AS dst_type")
_add("classes_of", lambda s, d: (lambda t: relations.class_of(t[0], t[3].members, t[3].sub_members).agg(F.count("*").alias("n"), F.count("class").alias("placed")))(_greedy(s, d)), f"WITH {_AT} SELECT count(DISTINCT entity_id) AS n, count(DISTINCT entity_id) AS placed FROM at_")
_PAIRS = "SELECT 'part-' || a.p_partkey AS a, 'part-' || b.p_partkey AS b, a.p_partkey AS x, b.p_partkey AS y FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) a JOIN part b ON b.p_partkey = a.n"
_add("anti_unify_pairs", lambda s, d: relations.anti_unify(_attributes(s, d), s.sql(_PAIRS.replace("'part-' || a.p_partkey", "concat('part-', a.p_partkey)").replace("'part-' || b.p_partkey", "concat('part-', b.p_partkey)").replace("FROM part)", "FROM {p})").replace("JOIN part b", "JOIN {p} b"), p=_read(s, d, "part"))), f"WITH {_AT}, pr AS ({_PAIRS}), u AS (SELECT a, b, path FROM pr JOIN at_ ON entity_id = a UNION SELECT a, b, path FROM pr JOIN at_ ON entity_id = b), e AS (SELECT a, b, count(*) FILTER (x.value = y.value) AS common, count(*) AS n FROM u LEFT JOIN at_ x ON x.entity_id = a AND x.path = u.path LEFT JOIN at_ y ON y.entity_id = b AND y.path = u.path GROUP BY 1, 2) SELECT a, b, common, n - common AS variables FROM e")

# device configuration, one of each supplier

_CFG = """concat('hostname r', s_suppkey, '\\n! note\\ninterface Gi0\\n description to c', s_nationkey, '\\n ipv4 address 10.0.0.', s_nationkey, '\\n no shutdown\\ninterface Gi1\\n mtu 9000\\nrouter bgp ', s_nationkey, '\\n neighbor 10.0.0.1\\n  remote-as 1\\n neighbor 10.0.0.2\\n  remote-as 2\\nroute-policy P\\n  pass\\nend-policy\\nend\\nignored')"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), F.expr(_CFG).alias("text"))


_BGP = "'router.bgp.' || s_nationkey || '.neighbor.10.0.0.1.remote-as'"
_PATHS = "['hostname', 'interface.Gi0.description', 'interface.Gi0.ipv4', 'interface.Gi0.shutdown', 'interface.Gi1.mtu', 'route-policy.P', {}]"
_VALUES = "['r' || s_suppkey, 'to c' || s_nationkey, 'address 10.0.0.' || s_nationkey, 'false', '9000', '[\"pass\"]', {}]"
_add("device_paths", lambda s, d: device.configs(_configs(s, d)).drop("attr_type"), "SELECT 'r' || s_suppkey AS entity_id, unnest(" + _PATHS.format(f"{_BGP}, replace({_BGP}, '0.1.', '0.2.')") + ") AS path, unnest(" + _VALUES.format("'1', '2'") + ") AS value FROM supplier")
_add("device_composites", lambda s, d: device.composites(device.configs(_configs(s, d))).where("attr_type = 'map'").select("entity_id", "path", "value"), "SELECT 'r' || s_suppkey AS entity_id, 'router.bgp.' || s_nationkey || '.neighbors' AS path, '{\"10.0.0.1\":{\"remote-as\":\"1\"},\"10.0.0.2\":{\"remote-as\":\"2\"}}' AS value FROM supplier")
_add("device_structure", lambda s, d: device.structure(_configs(s, d)).agg(F.count("*").alias("differences")), "SELECT CAST(0 AS BIGINT) AS differences")
_add("device_references", lambda s, d: device.description_refs(device.configs(_configs(s, d))), "SELECT 'r' || s_suppkey AS src, 'p2p_link' AS label, 'c' || s_nationkey AS dst FROM supplier")
_add("subsumed_rows", lambda s, d: (lambda a: device.subsumed(a, a.select("entity_id").distinct().withColumn("prefix", F.lit("interface.Gi0"))).drop("attr_type", "value"))(device.configs(_configs(s, d))), "SELECT 'r' || s_suppkey AS entity_id, unnest(['hostname', 'interface.Gi1.mtu', 'route-policy.P', " + f"{_BGP}, replace({_BGP}, '0.1.', '0.2.')" + "]) AS path FROM supplier")

# secrets in attributes

_SECRETS = """to_json(struct(p_name as name, struct('hunter2 x' as password, concat('AKIA', upper(substring(md5(p_name), 1, 16))) as note) as auth, array(struct('v' as a, cast(null as string) as b), struct(null as a, concat('glpat-', substring(md5(p_brand), 1, 20)) as b)) as rows))"""
_add("mask_attributes", lambda s, d: secrets.mask_attributes(documents.attributes(documents.parse(_parts(s, d, "json", _SECRETS)))).where("path <> 'name'").select("entity_id", "path", "value", "method"), "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, unnest(['auth.password', 'auth.note', 'rows']) AS path, unnest(['[REDACTED]', '[REDACTED]', '[{\"a\":\"v\"},{\"b\":\"[REDACTED]\"}]']) AS value, unnest(['path_pattern', 'regex:aws_access_key', 'regex:gitlab_pat']) AS method FROM part")
_add("mask_leaves", lambda s, d: documents.source_leaves(documents.parse(_parts(s, d, "json", _SECRETS))).withColumn("method", F.expr(secrets.detect_sql("value", "concat(entity_id, '.', path)"))).where("method is not null").groupBy("path", "method").agg(F.count("*").alias("n")), "SELECT path, method, (SELECT count(*) FROM part) AS n FROM (VALUES ('auth.password', 'path_pattern'), ('auth.note', 'regex:aws_access_key'), ('rows[1].b', 'regex:gitlab_pat')) v(path, method)")
_add("device_forms", lambda s, d: _read(s, d, "supplier").selectExpr("s_suppkey", "concat('server ', s_suppkey) path", "concat('key 7 ', s_name) value").withColumn("method", secrets.detect(forms=secrets.DEVICE_FORMS)).select("s_suppkey", "method"), "SELECT s_suppkey, 'value_pattern:iosxr_key_7' AS method FROM supplier")

# questions


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributes(spark, sf_dir).where("path not in ('name', 'price', 'org.name')")


_FA = f"{_AT}, fa AS (SELECT * FROM at_ WHERE path NOT IN ('name', 'price', 'org.name')), ft AS (SELECT count(DISTINCT entity_id) AS total FROM fa)"
_add("qa_single_value", lambda s, d: questions.single_value(_facts(s, d)), f"WITH {_FA} SELECT entity_id, path, 'What is ' || path || ' of ' || entity_id || '?' AS question, value AS answer FROM fa")
_add("qa_multi_entity", lambda s, d: questions.multi_entity(_facts(s, d)).select("path", "value", "n", F.md5("answer").alias("answer")), f"WITH {_FA} SELECT path, value, count(*) AS n, md5(string_agg(entity_id, ', ' ORDER BY entity_id)) AS answer FROM fa GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) < (SELECT total FROM ft)")
_add("qa_existence", lambda s, d: questions.existence(_facts(s, d)), f"WITH {_FA}, pa AS (SELECT path FROM fa GROUP BY 1 HAVING count(*) < (SELECT total FROM ft)), en AS (SELECT DISTINCT entity_id FROM fa) SELECT entity_id, path, 'yes' AS answer FROM fa JOIN pa USING (path) UNION ALL SELECT min(entity_id), path, 'no' FROM en CROSS JOIN pa WHERE (entity_id, path) NOT IN (SELECT (entity_id, path) FROM fa) GROUP BY path")
_add("qa_comparison", lambda s, d: questions.comparison(_facts(s, d), 0.02), f"WITH {_FA} SELECT path, count(DISTINCT value) = 1 AS all_same FROM fa GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT total FROM ft)")
_add("qa_count", lambda s, d: questions.count(_facts(s, d)), f"WITH {_FA} SELECT entity_id, string_split(path, '.')[1] AS prefix, count(DISTINCT string_split(path, '.')[2]) AS n FROM fa WHERE contains(path, '.') GROUP BY 1, 2")
_add("qa_ordering", lambda s, d: questions.ordering(_read(s, d, "conversations"), ["conv_id"], "turn", "role"), "SELECT conv_id, first_value(role) OVER w AS first, last_value(role) OVER w AS last, row_number() OVER v AS k, row_number() OVER v || CASE WHEN row_number() OVER v % 100 BETWEEN 11 AND 13 THEN 'th' WHEN row_number() OVER v % 10 = 1 THEN 'st' WHEN row_number() OVER v % 10 = 2 THEN 'nd' WHEN row_number() OVER v % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, role AS item, lead(role) OVER v AS next FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn, role), w AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_add("qa_bank", lambda s, d: questions.bank(_facts(s, d)).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")), f"WITH {_FA}, pa AS (SELECT path FROM fa GROUP BY 1 HAVING count(*) < (SELECT total FROM ft)), c AS (SELECT 'SINGLE_VALUE' AS category, count(*) AS n FROM fa UNION ALL SELECT 'MULTI_ENTITY', count(*) FROM (SELECT 1 FROM fa GROUP BY path, value HAVING count(*) >= 2 AND count(*) < (SELECT total FROM ft)) UNION ALL SELECT 'EXISTENCE', (SELECT count(*) FROM fa JOIN pa USING (path)) + (SELECT count(*) FROM pa) UNION ALL SELECT 'COMPARISON', count(*) FROM (SELECT 1 FROM fa GROUP BY path HAVING count(*) >= 0.5 * (SELECT total FROM ft)) UNION ALL SELECT 'COUNT', count(*) FROM (SELECT DISTINCT entity_id, string_split(path, '.')[1] FROM fa WHERE contains(path, '.'))) SELECT category, n, n AS ids FROM c")
_add("stratified_questions", lambda s, d: questions.stratified(_read(s, d, "part"), "p_brand", "p_partkey", 40).select("p_brand", "p_partkey"), "SELECT p_brand, p_partkey FROM (SELECT *, md5('0|' || p_partkey) AS h, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0|' || p_partkey), p_partkey) > 1 AS later FROM part) ORDER BY later, h, p_partkey LIMIT 40")
_ANSWERS = "p_partkey, p_brand AS category, CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_type) || '. ' WHEN 1 THEN 'It is ' || p_type || ', I think' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.0' ELSE 'none' END AS answer, CASE WHEN p_partkey % 4 = 2 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS truth"
_answers = lambda s, d: s.sql("SELECT " + _ANSWERS.replace("VARCHAR", "STRING") + " FROM {p}", p=_read(s, d, "part"))
_add("answer_compare", lambda s, d: _answers(s, d).select("p_partkey", questions.correct(F.col("answer"), F.col("truth")).alias("right")), "SELECT p_partkey, p_partkey % 4 < 3 AS right FROM part")
_add("accuracy_rollup", lambda s, d: questions.accuracy(_answers(s, d)), "SELECT p_brand AS category, count(*) AS n, round(avg(CASE WHEN p_partkey % 4 < 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM part GROUP BY ROLLUP (p_brand)")
_add("weighted_scores", lambda s, d: questions.weighted(_read(s, d, "part").selectExpr("case pmod(p_partkey, 3) when 0 then 'factual' when 1 then 'reasoning' else 'other' end class", "p_size - 5 score")), "SELECT class, count(*) AS n, CAST(sum(greatest(0, least(score, most))) AS BIGINT) AS score, CAST(sum(most) AS BIGINT) AS most, round(sum(greatest(0, least(score, most))) / sum(most), 6) AS share FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'factual' ELSE 'reasoning' END AS class, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 3 END AS most, p_size - 5 AS score FROM part WHERE p_partkey % 3 < 2) GROUP BY ROLLUP (class)")
_add("singular_words", lambda s, d: s.createDataFrame([("policies",), ("classes",), ("hosts",), ("address",), ("bus",), ("branches",)], "word string").select("word", questions.singular(F.col("word")).alias("one")), "SELECT * FROM (VALUES ('policies', 'policy'), ('classes', 'class'), ('hosts', 'host'), ('address', 'address'), ('bus', 'bu'), ('branches', 'branch')) v(word, one)")
_add("path_prefixes", lambda s, d: questions.common_prefixes(_attributes(s, d)), f"WITH {_AT} SELECT string_split(path, '.')[1] AS prefix, count(DISTINCT path) AS n FROM at_ GROUP BY 1 HAVING count(DISTINCT path) >= 2")
_add("largest_entities", lambda s, d: documents.largest(_attributes(s, d).withColumn("type", F.substring_index("entity_id", "-", 1)), "type"), f"WITH {_AT}, z AS (SELECT {_HINT} AS type, entity_id, count(*) AS n_attrs FROM at_ GROUP BY 1, 2) SELECT type, entity_id, n_attrs FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n_attrs DESC, entity_id) AS k FROM z) WHERE k <= 3")
