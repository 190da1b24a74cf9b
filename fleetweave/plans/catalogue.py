"""The registered queries of the fleet operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetweave.functions import secrets
from fleetweave.functions.values import char_entropy, entropy_sql, glob_regex, tokens
from fleetweave.operators import factor, profile, serve
from fleetweave.sources import readers
from fleetweave.sources.table import leaves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: section: (key, paths with their kinds, d for doubles and t for timestamps)
FLEETS = {
    "part": ("p_partkey", {"p_name": "", "p_brand": "", "p_type": "", "p_size": "n", "p_retailprice": "d"}),
    "orders": ("o_orderkey", {"o_custkey": "n", "o_orderstatus": "", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": ""}),
    "supplier": ("s_suppkey", {"s_name": "", "s_nationkey": "n", "s_acctbal": "d"}),
    "customer": ("c_custkey", {"c_name": "", "c_nationkey": "n", "c_acctbal": "d", "c_mktsegment": ""}),
    "events": ("event_id", {"ts": "t", "user_id": "n", "event_type": "", "value": "d", "props": ""}),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _leaves(spark: SparkSession, sf_dir: str, name: str, keep: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    key, kinds = FLEETS[name]
    return leaves(_read(spark, sf_dir, name), key, paths or list(kinds), name, keep)


def _leaves_sql(name: str, keep: str = "", paths: list[str] | None = None) -> str:
    key, kinds = FLEETS[name]
    spell = {"d": "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')", "n": "CAST({0} AS VARCHAR)", "": "{0}"}
    kind = {"d": "number", "n": "number", "t": "string", "": "string"}
    rows = [f"SELECT CAST({key} AS VARCHAR) AS entity_id, '{name}' AS section, {keep + ',' if keep else ''} '{p}' AS path, '{kind[k]}' AS value_type, {spell[k].format(p)} AS value FROM {name} WHERE {p} IS NOT NULL" for p, k in kinds.items() if paths is None or p in paths]
    return " UNION ALL ".join(rows)


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


for _n in ("part", "orders", "supplier", "customer", "events"):
    _add(f"leaves_{_n}", lambda s, d, n=_n: _leaves(s, d, n), _leaves_sql(_n))
    _add(f"profile_{_n}", lambda s, d, n=_n: profile.profile(_leaves(s, d, n)), profile.profile_sql(_leaves_sql(_n)))

# signatures, identity, majority, base
_add(
    "signature_groups",
    lambda s, d: factor.signature_groups(_leaves(s, d, "orders", paths=["o_orderstatus", "o_orderpriority"])),
    f"WITH l AS ({_leaves_sql('orders', paths=['o_orderstatus', 'o_orderpriority'])}), g AS (SELECT entity_id, string_agg(CAST(json_array(path, value_type, value) AS VARCHAR), ',' ORDER BY CAST(json_array(path, value_type, value) AS VARCHAR)) AS signature FROM l GROUP BY 1) SELECT signature, count(*) AS n_entities, min(entity_id) AS first_entity FROM g GROUP BY 1",
)
_add(
    "identity_fields",
    lambda s, d: factor.identity_fields(_leaves(s, d, "customer", ["c_mktsegment"], ["c_name", "c_nationkey"]).withColumnRenamed("c_mktsegment", "segment"), "segment"),
    f"WITH l AS ({_leaves_sql('customer', 'c_mktsegment AS segment', ['c_name', 'c_nationkey'])}), z AS (SELECT segment, count(DISTINCT entity_id) AS total FROM l GROUP BY 1) SELECT segment, path, n FROM (SELECT segment, path, count(*) AS n, count(DISTINCT value) AS d FROM l GROUP BY 1, 2) JOIN z USING (segment) WHERE n = total AND d = total AND total >= 2",
)


def _brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir, "part", ["p_brand"], ["p_type", "p_size"]).withColumnRenamed("p_brand", "brand")


def _priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir, "orders", ["o_orderpriority"], ["o_orderstatus"]).withColumnRenamed("o_orderpriority", "priority")


BRAND = _leaves_sql("part", "p_brand AS brand", ["p_type", "p_size"])
PRIORITY = _leaves_sql("orders", "o_orderpriority AS priority", ["o_orderstatus"])
NATION = _leaves_sql("customer", "c_nationkey AS nation", ["c_nationkey", "c_mktsegment"])


def _majority_sql(source: str, group: str, threshold: int) -> str:
    return f"""lv AS ({source}), z AS (SELECT {group}, count(DISTINCT entity_id) AS total FROM lv GROUP BY 1), v AS (SELECT {group}, path, value, count(*) AS n, min(entity_id) AS first FROM lv GROUP BY 1, 2, 3),
rk AS (SELECT *, sum(n) OVER (PARTITION BY {group}, path) AS present, row_number() OVER (PARTITION BY {group}, path ORDER BY n DESC, first) AS rn FROM v),
classes AS (SELECT {group}, path, value, n FROM rk JOIN z USING ({group}) WHERE rn = 1 AND present = total AND n >= greatest(1, total * {threshold} // 100))"""


_add("majority_class_5", lambda s, d: factor.majority(_brand(s, d), "brand", 5), f"WITH {_majority_sql(BRAND, 'brand', 5)} SELECT * FROM classes")
_add("majority_class_100", lambda s, d: factor.majority(_priority(s, d), "priority", 100), f"WITH {_majority_sql(PRIORITY, 'priority', 100)} SELECT * FROM classes")
_add("universal_base", lambda s, d: factor.universal(_nation(s, d), "nation"), f"WITH {_majority_sql(NATION, 'nation', 100)} SELECT nation, path, value FROM classes")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(_read(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey")), "c_custkey", ["c_nationkey", "c_mktsegment"], "customer", ["nation"])


DELTAS = """ids AS (SELECT DISTINCT {g}, entity_id FROM lv), want AS (SELECT {g}, entity_id, path, c.value AS want FROM ids JOIN classes c USING ({g})),
delta AS (SELECT entity_id, path, CASE WHEN value IS NULL THEN 'absent' ELSE 'set' END AS op, value FROM (SELECT {g}, entity_id, path, value FROM lv) FULL JOIN want USING ({g}, entity_id, path) WHERE value IS DISTINCT FROM want)"""
OVERLAY = "up AS (SELECT entity_id, path, value, 'set' AS op, 0 AS rank, 'class' AS layer FROM ids JOIN classes USING ({g}) UNION ALL SELECT entity_id, path, value, op, 1, 'delta' FROM delta), seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, path ORDER BY rank DESC) AS k FROM up) WHERE k = 1 AND op = 'set')"


def _deltas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lv = _brand(spark, sf_dir)
    classes = factor.majority(lv, "brand", 5)
    return lv, classes, factor.deltas(lv, classes, "brand")


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.overlay(*_deltas(spark, sf_dir), "brand")


_D = f"WITH {_majority_sql(BRAND, 'brand', 5)}, {DELTAS.format(g='brand')}"
_add("class_delta", lambda s, d: _deltas(s, d)[2], f"{_D} SELECT * FROM delta")
_add("layered_view", _layered, f"{_D}, {OVERLAY.format(g='brand')} SELECT entity_id, path, value, layer FROM seen")
_add("reconstruct_rows", lambda s, d: _layered(s, d).drop("layer"), f"WITH lv AS ({BRAND}) SELECT entity_id, path, value FROM lv")
_add("reconstruct_mismatch", lambda s, d: factor.mismatches(_brand(s, d), _layered(s, d)).agg(F.count("*").alias("mismatches")), "SELECT CAST(0 AS BIGINT) AS mismatches")
_add(
    "zero_delta_entities",
    lambda s, d: _brand(s, d).select("entity_id").distinct().join(_deltas(s, d)[2], "entity_id", "left_anti"),
    f"{_D} SELECT entity_id FROM ids WHERE entity_id NOT IN (SELECT entity_id FROM delta)",
)


# comparison, references, similarity
_add(
    "fidelity_difference",
    lambda s, d: factor.multiset_difference(_leaves(s, d, "part"), _leaves(s, d, "part").withColumn("value", F.expr("if(path = 'p_size' and value = '7', '8', value)")), ["path", "value"]),
    f"WITH l AS ({_leaves_sql('part')}), b AS (SELECT path, CASE WHEN path = 'p_size' AND value = '7' THEN '8' ELSE value END AS value FROM l) SELECT path, value, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT path, value, 1 AS s FROM l UNION ALL SELECT path, value, -1 FROM b) GROUP BY 1, 2 HAVING sum(s) <> 0",
)
_add(
    "jaccard_part_pairs",
    lambda s, d: serve.jaccard_pairs(_read(s, d, "supplier").join(_read(s, d, "lineitem"), F.expr("l_suppkey = s_suppkey")).select("s_nationkey", "l_partkey"), "s_nationkey", "l_partkey", 0.1),
    "WITH x AS (SELECT DISTINCT s_nationkey AS k, l_partkey AS i FROM supplier JOIN lineitem ON l_suppkey = s_suppkey), n AS (SELECT k, count(*) AS n FROM x GROUP BY 1), p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM x JOIN x y ON x.i = y.i AND x.k < y.k GROUP BY 1, 2) SELECT a, b, round(c / (m.n + q.n - c), 6) AS jaccard FROM p JOIN n m ON m.k = a JOIN n q ON q.k = b WHERE round(c / (m.n + q.n - c), 6) >= 0.1",
)

# ranges, retrieval, rankings
_RANGES = "p AS (SELECT DISTINCT regexp_extract(c_name, '^(.*?)(\\d+)$', 1) AS prefix, regexp_extract(c_name, '^(.*?)(\\d+)$', 2) AS d FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), q AS (SELECT prefix, length(d) AS width, CAST(d AS BIGINT) AS v FROM p WHERE d <> ''), i AS (SELECT *, v - row_number() OVER (PARTITION BY prefix, width ORDER BY v) AS g FROM q)"
_rich = lambda s, d: _read(s, d, "customer").join(_read(s, d, "orders"), F.expr("c_custkey = o_custkey"), "left_semi")
_add("id_ranges", lambda s, d: serve.id_ranges(_rich(s, d), "c_name").selectExpr("prefix", "width", "cast(first as long) first", "cast(last as long) last", "n"), f"WITH {_RANGES} SELECT prefix, width, min(v) AS first, max(v) AS last, count(*) AS n FROM i GROUP BY prefix, width, g")
_add("id_ranges_expand", lambda s, d: serve.expand_ranges(serve.id_ranges(_rich(s, d), "c_name")), f"WITH {_RANGES} SELECT DISTINCT prefix || lpad(CAST(v AS VARCHAR), CAST(width AS INT), '0') AS id FROM i")
_add(
    "budget_retrieve",
    lambda s, d: serve.budget(_read(s, d, "documents").select("doc_id", tokens(F.col("text")).alias("cost")).where("cost is not null"), ["doc_id"], "cost", 50_000),
    "WITH x AS (SELECT doc_id, greatest(1, length(text) // 4) AS cost FROM documents WHERE text IS NOT NULL) SELECT doc_id, cost, used FROM (SELECT *, CAST(sum(cost) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM x) WHERE used <= 52500",
)
_add("representatives", lambda s, d: _read(s, d, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("k <= 5").select("p_brand", "p_partkey"), "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k <= 5")

# globs, secrets, readers
GLOBS = ("*.example.**", "blog.*.example.net", "**.com", "m.**")
def _host() -> Column:
    return F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)


_add(
    "glob_project",
    lambda s, d: _read(s, d, "pages").select(_host().alias("path")).distinct().join(F.broadcast(s.createDataFrame([(g, glob_regex(g)) for g in GLOBS], "pattern string, rx string")), F.expr("regexp_like(path, rx)")).select("pattern", "path"),
    "WITH g(pattern, rx) AS (VALUES " + ", ".join(f"('{g}', '{glob_regex(g)}')" for g in GLOBS) + "), h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS path FROM pages) SELECT pattern, path FROM h JOIN g ON regexp_matches(path, rx)",
)


_PATH, _VALUE, _METHOD = secrets.line_units_sql(duck=True)
_UNITS = f"""WITH l AS MATERIALIZED (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
u AS MATERIALIZED (SELECT doc_id, line_no, line, path, {_METHOD} AS method FROM (SELECT *, {_PATH} AS path, {_VALUE} AS value FROM l)),
w AS MATERIALIZED (SELECT doc_id, line_no, path, unnest(string_split(line, ' ')) AS t, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_no FROM u WHERE method IS NULL),
m AS MATERIALIZED (SELECT doc_id, line_no, word_no, t, CASE WHEN length(t) >= {secrets.LEAST_LENGTH} THEN {secrets.detect_sql('t', 'path', duck=True)} END AS method FROM w)"""
_add("secret_audit", lambda s, d: secrets.audit_lines(_read(s, d, "documents"), "doc_id"), f"{_UNITS} SELECT doc_id, line_no, -1 AS word_no, method FROM u WHERE method IS NOT NULL UNION ALL SELECT doc_id, line_no, word_no, method FROM m WHERE method IS NOT NULL")
_add("secret_mask", lambda s, d: secrets.mask_lines(_read(s, d, "documents"), "doc_id"), f"{_UNITS} SELECT doc_id, line_no, '{secrets.REDACTED}' AS line FROM u WHERE method IS NOT NULL UNION ALL SELECT doc_id, line_no, string_agg(CASE WHEN method IS NULL THEN t ELSE '{secrets.REDACTED}' END, ' ' ORDER BY word_no) AS line FROM m GROUP BY 1, 2")
_WORDS = f"SELECT DISTINCT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM conversations) "
_words = lambda s, d: _read(s, d, "conversations").select(F.explode(F.split("text", " ")).alias("token")).distinct()
_add("char_entropy", lambda s, d: _read(s, d, "part").select("p_partkey", char_entropy("p_name").alias("bits")), f"SELECT p_partkey, {entropy_sql('p_name', duck=True)} AS bits FROM part")
_add("false_positives", lambda s, d: _words(s, d).select("token", F.expr(secrets.first_sql("token", secrets.HARMLESS)).alias("rule")), f"SELECT token, {secrets.first_sql('token', secrets.HARMLESS, duck=True)} AS rule FROM ({_WORDS})")
_add("detect_format", lambda s, d: _read(s, d, "pages").select("page_id", readers.format_of(F.col("url")).alias("format")), "SELECT page_id, CASE WHEN x = 'json' THEN 'json' WHEN x IN ('ini', 'cfg', 'conf', 'cnf', 'properties') THEN 'ini' WHEN x = 'xml' THEN 'xml' ELSE 'yaml' END AS format FROM (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM pages)")
_INI = "concat('[brand]\nname = ', p_brand, '\n; note\nsize=', p_size, '\n[kind]\nType = ', p_type)"
_add("ini_parse", lambda s, d: readers.ini_leaves(_read(s, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.expr(_INI).alias("text"))), "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, unnest(['brand.name', 'brand.size', 'kind.type']) AS path, unnest([trim(p_brand), CAST(p_size AS VARCHAR), trim(p_type)]) AS value, unnest(['string', 'number', 'string']) AS value_type FROM part")
_XML = "concat('<part id=\"', p_partkey, '\"><size>', p_size, '</size><size>', p_size + 1, '</size></part>')"
_add("xml_parse", lambda s, d: readers.parsed_leaves(_read(s, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.expr(_XML).alias("text")), "xml"), "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS no, unnest(['part.@id', 'part.size[0]', 'part.size[1]']) AS path, unnest([CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR)]) AS value FROM part")
_CFG = "concat('hostname r', s_suppkey, '\n! x\nrouter bgp ', s_nationkey, '\n neighbor 10.0.0.1\n  no shutdown\nend')"
_add("config_parse", lambda s, d: readers.parsed_leaves(_read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), F.expr(_CFG).alias("text")), "config"), "SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS no, unnest(['hostname', 'router', 'router.bgp.' || s_nationkey || '.neighbor', 'router.bgp.' || s_nationkey || '.neighbor.10.0.0.1.shutdown']) AS path, unnest(['r' || s_suppkey, 'bgp ' || s_nationkey, '10.0.0.1', 'false']) AS value FROM supplier")

# lists, pivots, questions, statistics
_add("list_rebuild", lambda s, d: _read(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"), F.count("*").alias("n")), "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY 1")
_add("phone_book", lambda s, d: _leaves(s, d, "part").groupBy("entity_id").pivot("path", ["p_brand", "p_size", "p_type"]).agg(F.first("value")), "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_brand, CAST(p_size AS VARCHAR) AS p_size, p_type FROM part")
_add("qa_value_groups", lambda s, d: serve.value_groups(_leaves(s, d, "part")), f"WITH l AS ({_leaves_sql('part')}), z AS (SELECT count(DISTINCT entity_id) AS total FROM l) SELECT section, path, value, count(*) AS n, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS ids FROM l CROSS JOIN z GROUP BY section, path, value, total HAVING count(*) >= 2 AND count(*) < total")
_add("stratified_sample", lambda s, d: _read(s, d, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.md5(F.col("p_partkey").cast("string"))))).where("k <= 3").select("p_brand", "p_partkey"), "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR))) AS k FROM part) WHERE k <= 3")
_add("stats_by_section", lambda s, d: _read(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(tokens(F.col("text"))).alias("tokens")), "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
_add("content_hash", lambda s, d: _leaves(s, d, "part").select("entity_id", "path", F.sha2("value", 256).alias("hash")), f"SELECT entity_id, path, sha256(value) AS hash FROM ({_leaves_sql('part')})")

from fleetweave.plans import fleet_queries  # noqa: E402  (registers its queries with the ones above)

QUERIES |= fleet_queries.QUERIES
ORACLES |= fleet_queries.ORACLES
