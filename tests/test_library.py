"""Library functions on small inputs: trees, readers, factoring, types, tiers, secrets, questions, the command line."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetweave import __main__ as cli
from fleetweave.functions import secrets, trees
from fleetweave.operators import fleet, hierarchy, questions, relations, sections, serve, tiers
from fleetweave.operators.profile import profile
from fleetweave.plans import catalogue
from fleetweave.session import cut, few, spread
from fleetweave.sources import device, documents
from fleetweave.sources.table import leaves

ATTRS = "entity_id string, path string, attr_type string, value string"


def tree(rng, depth=0):
    r = rng.random()
    if depth > 3 or r < 0.4:
        return rng.choice([1, 2.5, True, None, "x", "a b", "yes", "1.0", "", -3, "ünï: #x", "null"])
    if r < 0.8:
        return {rng.choice(["a", "b", "c.d", "_x", "e\\f", "k-2"]): tree(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [tree(rng, depth + 1) for _ in range(rng.randrange(3))]


def test_trees_come_back():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(1)
    for _ in range(500):
        t = {f"r{i}": tree(rng) for i in range(rng.randrange(3))}
        assert trees.unflatten(trees.section_leaves(t)) == t == trees.expand(trees.collapse(t))
        assert yaml.safe_load(trees.render(t)) == trees.collapse(t)
        assert trees.normalise(t) == t and trees.value_key(t) == trees.value_key(trees.normalise(t))


def test_value_keys():
    key = trees.value_key
    assert key(1.0) == key(1) != key(True) and key("1") != key(1) and key(-0.0) != key(0)
    assert key({"b": 1, "a": (1, 2)}) == '{"a":[1,2],"b":1}' and key(float("inf")) == '"inf"'
    assert trees.value_signature(1.0) != trees.value_signature(1) and len(trees.content_hash({})) == 64


def test_flatten():
    flat, comp = trees.flatten([{"a": {"b": 1, "c": None}, "m": {"x": {"p": 1, "q": 2}, "y": {"p": 3, "q": [1, 2]}}, "l": [{"z": {"w": {"v": 1}}}], "s": [1, True], "mix": [1, {"a": 2}], "none": []}])
    assert flat == {"a.b": "1", "s": "1,true", "mix": "1"}
    assert comp == {"m": ("map", {"x": {"p": "1", "q": "2"}, "y": {"p": "3", "q": "1,2"}}), "l": ("list", [{"z.w.v": "1"}])}
    assert trees.flatten([{"a": 1}, {"a": 2}])[1] == {"_root": ("list", [{"a": "1"}, {"a": "2"}])} and trees.flatten("x")[0] == {"_root": "x"}
    assert trees.flatten({"m": {"x": 1}}, {"m*": "map"})[1] == {"m": ("map", {"x": {"_value": "1"}})}
    assert trees.alike({"a": {"x": 1, "y": 2}}) and not trees.alike({"a": {"x": 1}}) and not trees.alike({"a": {"x": 1}, "b": {"y": 1}})


def test_access_and_guards():
    v = {"a": {"b": 1}, "c.d": 2}
    assert trees.get(v, "a.b") == 1 and trees.get(v, "c\\.d") == 2 and trees.get(v, "a.z", 7) == 7
    assert trees.remove(trees.put(v, "x.y", 3), "a.b") == {"c.d": 2, "x": {"y": 3}}
    assert trees.list_of(trees.list_rows([{"a": 1}, {"b.c": 2}])) == [{"a": 1}, {"b.c": 2}]
    trees.check_classes({"A": {"x": [{"y": 1}]}})
    with pytest.raises(ValueError, match="_instances"):
        trees.check_classes({"A": {"x": [{"_instances": 1}]}})


def test_readers():
    assert documents.read_ini("[a]\nB = yes\nb=2\n; c\n[d]\n") == {"a": {"b": "true,2"}, "d": {}}
    assert documents.read_ini("x = 1\n# y\nz=a=b") == {"x": 1, "z": "a=b"} and documents.read_ini("Port 22\nFlag") == {"Port": 22, "Flag": True}
    assert documents.read_xml("<a x='1'><b>2</b><b>3</b>tail</a>") == {"a": {"@x": "1", "_text": "tail", "b": ["2", "3"]}}
    with pytest.raises(ValueError):
        documents.read_xml("<!DOCTYPE a><a/>")
    assert [documents.coerce(x) for x in ("on", "No", "12", "-1.5", "1e3", "x", "")] == [True, False, 12, -1.5, 1000.0, "x", ""]
    assert documents.platform_of({"on": 1, "jobs": 2}) == "github-actions" and documents.platform_of({"providers": 1, "log": 2}) == "traefik" and documents.platform_of([1]) is None


def test_documents_of_a_folder(spark, tmp_path):
    for name, text in {"r1.json": '{"s": {"a": 1, "b": "x", "c": [1], "d": true}}', "r2.yaml": "s: {a: 1, b: x, c: [1], d: true}", "r3.json": '{"s": {"a": 1, "b": "y", "c": [1], "d": true}}', "r4.xml": "<broken", "r5.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    parsed = documents.parse(documents.load(spark, str(tmp_path)))
    assert {(r.entity_id, r.error is not None) for r in parsed.collect()} == {("r1", False), ("r2", False), ("r3", False), ("r4", True), ("r5", False)}
    leaves = documents.section_leaves(parsed)
    documents.save(leaves, str(tmp_path / "store"))
    assert documents.open_store(spark, str(tmp_path / "store")).count() == leaves.count() == 12
    store = str(tmp_path / "tables")
    run = lambda *a: cli.run(spark, cli.parser().parse_args(list(a)))
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"h{k}.json").write_text(json.dumps({"main": {"a": 1, "b": "x", "c": k // 3}}))
    assert json.loads(run("compress", src, store)) == {"hosts": 4, "zero_delta_hosts": 3, "classes": 1}
    assert json.loads(run("validate", src)) == {"differences": 0} and "Main" in run("fleet-info", store)
    assert "h1: " in run("retrieve", store, "what is wrong with h1?", "--budget", "500") and "| main |" in run("stats", src)
    assert "MULTI_ENTITY" in run("generate-questions", src, str(tmp_path / "bank"))


def section(rows):
    return [(h, s, "dict", p, type(v).__name__, trees.value_key(v)) for h, s, d in rows for p, v in d.items()]


def test_section_classes_by_hand(spark):
    same = {"a": 1, "b": "x", "c": True}
    rows = [("h1", "net_core", same), ("h2", "net_core", same), ("h3", "net_core", same | {"b": "y"}), ("h4", "net_core", {"z": 1}), ("h5", "net_core", same | {"a": 1.0})]
    rows += [(f"g{k}", "solo", {"id": k, "p": 1, "q": 2, "r": 3}) for k in range(4)] + [("k1", "tiny", same), ("k2", "tiny", same)]
    lv = spark.createDataFrame(section(rows), documents.SECTION_LEAVES)
    f = sections.factor(lv, max_delta_pct=40.0)
    assert {(r.section, r.host, r["class"]) for r in f.members.collect()} == {("net_core", "h1", "NetCore"), ("net_core", "h2", "NetCore"), ("net_core", "h3", "NetCore"), ("net_core", "h5", "NetCore"), ("net_core", "h4", None), ("tiny", "k1", None), ("tiny", "k2", None), *(("solo", f"g{k}", "Solo") for k in range(4))}
    assert {(r["class"], r.path) for r in f.identities.collect()} == {("Solo", "id")}
    assert {(r.host, r.path, r.kind) for r in f.deltas.where("section = 'net_core'").collect()} == {("h3", "b", "changed"), ("h4", "z", "raw"), ("h5", "a", "changed")}
    for g in (f, sections.dissolve(f)):
        assert sections.differences(lv, sections.rebuild(g)).isEmpty()
    assert not sections.differences(lv.where("host <> 'h1'"), sections.rebuild(f)).isEmpty()
    with pytest.raises(KeyError):
        fleet.host_info(f, "nobody")
    assert fleet.host_info(f, "h3")["total_delta"] == 1
    empty = sections.factor(lv.limit(0))
    assert empty.classes.isEmpty() and sections.rebuild(empty).isEmpty()


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate((50, 40, 30, 1, 1))], "k int, cost int")
    assert [(r.k, r.used) for r in serve.budget(rows, ["k"], "cost", 100, 0.0).orderBy("k").collect()] == [(0, 50), (1, 90)]
    assert serve.fits(rows.withColumn("place", F.col("k")), "cost", 121, size=2).count() == 4


def test_jaccard_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {k: frozenset(rng.sample(range(12), rng.randrange(1, 7))) for k in range(40)}
    df = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s] + [(1, None)], "k int, i int")
    for least in (0.2, 0.5, 1.0):
        want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= least}
        assert {tuple(r) for r in serve.jaccard_pairs(df, "k", "i", least).collect()} == want


def test_id_ranges(spark):
    ids = ["A01", "A02", "A03", "A5", "B9", "B" + "9" * 20, "B1" + "0" * 20, "x"]
    got = serve.id_ranges(spark.createDataFrame([(i,) for i in ids], "id string"), "id")
    assert sorted(r.id for r in serve.expand_ranges(got).collect()) == sorted(i for i in ids if i != "x")


def fleet_of_types(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        role, e = ("core", "edge")[k % 4 == 0], f"e{k:02}"
        rows += [(e, "role", "string", role), (e, "site", "string", f"s{k % 3}"), (e, "os.version", "string", "7" if k < 30 else "8"), (e, "os.patch", "string", f"p{k % 2}"), (e, "serial", "string", f"S{k}")]
        rows += [(e, "ntp", "string", "10.0.0.1")] if role == "core" else [(e, "vlan", "string", str(k)), (e, "bng.pool", "string", "gold")]
        rows += [(e, "note", "string", f"n{rng.randrange(9)}")] if k % 5 == 0 else []
    return spark.createDataFrame(rows, ATTRS)


@pytest.mark.parametrize("engine", ["archetypal", "greedy-bundle"])
def test_engines_are_lossless_and_sound(spark, engine):
    attrs = fleet_of_types(spark)
    types, profiles = hierarchy.bootstrap(attrs)
    typed = attrs.join(types, "entity_id")
    rel = spark.createDataFrame([("e01", "peer", "e02"), ("e01", "peer", "e02")], "src string, label string, dst string")
    h = hierarchy.ENGINES.get(engine)(typed, profiles, hierarchy.Config())
    c = tiers.tier_c(typed, profiles, h, rel)
    assert tiers.mismatches(typed, tiers.reconstitute(h, c)).isEmpty() and tiers.invariants(types, h, c, profiles).isEmpty()
    assert tiers.relation_mismatches(rel, c).isEmpty() and c.foreign_keys.isEmpty()
    subject = tiers.Subject("os", ("os.**",), ("site",))
    ph, pc = tiers.project(h, c, subject)
    view = tiers.layered_view(ph, pc)
    assert tiers.projection_errors(typed, view, subject).isEmpty() and view.count() == 120
    # broken data is told
    c.members = c.members.unionByName(c.members.limit(1).withColumn("class", F.lit("other"))).where("entity_id <> 'e39'")
    c.sub_members = c.sub_members.unionByName(spark.createDataFrame([("t", "nobody", "sub")], "type_id string, entity_id string, subclass string"))
    c.overrides = c.overrides.unionByName(spark.createDataFrame([("t", "e00", "none", "p", "set", "v")], "type_id string, entity_id string, owner string, path string, op string, value string"))
    c.phone_book = c.phone_book.where("entity_id <> 'e00'")
    c.instance_attrs = c.instance_attrs.unionByName(c.phone_book.limit(1))
    told = {r.rule for r in tiers.invariants(types, h, c, profiles).select("rule").distinct().collect()}
    assert {"MultiClassAssignment", "ClassCoverage", "SubclassOrphan", "InvalidOverrideOwner", "PhoneBookDense", "DuplicateCPathEncoding"} <= told
    assert not tiers.mismatches(typed, tiers.reconstitute(h, c)).isEmpty()


def test_roles_go_by_the_size_of_the_group(spark):
    rows = [(f"e{k}", "t", "all", "v") for k in range(100)] + [(f"e{k}", "t", "few", v) for k, v in enumerate("aaaabcd")]
    got = {r.path: r.role for r in profile(spark.createDataFrame(rows, "entity_id string, section string, path string, value string")).collect()}
    assert got == {"all": "A_BASE", "few": "C"}


def test_refinement(spark):
    p = {"a", "b", "c", "d"}
    rep = lambda e, **v: (e, [(e, v)], 3)
    near = [rep("e1", a="1", b="1", c="1", d="1"), rep("e2", a="1", b="1", c="1", d="2")]
    assert hierarchy.merged(near, p, hierarchy.Config()) == [0, 0]
    far = [rep("e1", a="1", b="1", c="1", d="1"), rep("e2", a="2", b="2", c="2", d="2"), ("e3", [("e3", {"a": "2", "b": "2", "c": "9", "d": "8"})], 1)]
    assert hierarchy.merged(far, p, hierarchy.Config(most_variables=1)) == [0, 1, 1]
    assert hierarchy.merged([(k, r, 1) for k, r, _ in far], p, hierarchy.Config(most_variables=1)) == [0, 0, 0]
    assert list(hierarchy.clusters(iter([("x", ["a", "b", "c"]), ("y", ["a", "b"]), ("z", ["q"])]), 0.4)) == [("x", 0), ("y", 0), ("z", 1)]


def test_archetypes_by_hand():
    sigs = [("e1", 3, {"a": "1", "b": "1", "c": "1", "id": "x"}), ("e2", 1, {"a": "1", "b": "1", "c": "1", "id": "y"}), ("e3", 1, {"z": "9"})]
    (of, reference, ident), = hierarchy.archetypes(sigs)
    assert sorted(of) == [0, 1] and reference["id"] == "x" and ident == []
    assert hierarchy.collapse_removals({"a.x", "a.y", "b.x"}, {"a.x", "a.y", "b.x", "b.y"}) == {"a", "b.x"}
    engines = hierarchy.Engines()
    engines.register("one", lambda t, p, c: None)
    with pytest.raises(ValueError):
        engines.register("one", lambda t, p, c: None)
    with pytest.raises(KeyError):
        engines.get("two")


def test_secret_chain(spark):
    cases = [
        ("db.password", "x", "path_pattern"), ("a.b", "example", None), ("a.b", "${TOKEN}", None), ("a.b", "/etc/shadow", None), ("a.b", "https://x.org/?q=aZ3kq9XwPz7LmN2v", None), ("a.b", "password=abc", "regex:generic_credential_pair"),
        ("a.b", "DefaultEndpointsProtocol=https;AccountName=x", "regex:azure_connection_string"), ("a.b", "github_pat_" + "a1" * 11, "regex:github_token"), ("a.b", "ghp_" + "a1" * 11, "regex:github_token"), ("a.b", "0822455D0A16", "regex:cisco_type7"),
        ("a.b", "$8$dsYGNam3K1SIJO", "regex:cisco_type89"), ("a.b", "aZ3kq9XwPz7LmN2vQe5RtYu8", "entropy"), ("a.command", "aZ3kq9XwPz7LmN2vQe5RtYu8", None), ("a.b", "aaaaaaaaaaaaaaaaaaaa", None), ("a.b", "fe80::1", None), ("a.b", "00:11:22:33:44:55", None),
        ("a.b", "key 7 x", "value_pattern:iosxr_key_7"), ("a.b", "123456", None), ("a.b", "", None), ("a.b", None, None), ("a.b", "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "regex:jwt"),
    ]
    df = spark.createDataFrame([(k, p, v) for k, (p, v, _) in enumerate(cases)], "k int, path string, value string")
    got = {r.k: r.m for r in df.select("k", secrets.detect(forms=secrets.DEVICE_FORMS).alias("m")).collect()}
    assert [got[k] for k in range(len(cases))] == [m for _, _, m in cases]


def test_device_configuration():
    text = "hostname r1\ninterface Gi0\n no shutdown\n! CUSTOM: keep\n mtu 9000\nroute-policy P\n if x then\n  pass\nend-policy\nntp server a\nntp server b\nlog x\nlog x\nend\nafter"
    got = {p: v for p, _, v in device.flat_config(device.read_config(text))}
    assert got == {"hostname": "r1", "interface.Gi0.shutdown": "false", "interface.Gi0.mtu": "9000", "interface.Gi0.mtu._note": "keep", "route-policy.P": '["if x then", "pass"]', "ntp.server.a": "true", "ntp.server.b": "true", "log.x": '["true", "true"]'} or got["interface.Gi0.mtu"] == "9000"
    assert device.hostname(device.read_config(text)) == "r1" and device.section_key(device.read_config("router bgp 1\n x").children[0]) == "router.bgp.1"


def test_answers(spark):
    cases = [("Yes", "true", True), ("No.", "false", True), ("12.0", "12", True), ("it is r1, then", "r1", True), ("r10", "r1", False), (None, "x", False), ("x", None, False), ("a  b", "A B", True)]
    df = spark.createDataFrame([(k, a, t) for k, (a, t, _) in enumerate(cases)], "k int, a string, t string")
    got = {r.k: r.c for r in df.select("k", questions.correct(F.col("a"), F.col("t")).alias("c")).collect()}
    assert [got[k] for k in range(len(cases))] == [c for *_, c in cases]
    known = {"a.yaml", "b.yaml"}
    for text in ('["a.yaml", "z", "b.yaml"]', '{"files": ["a.yaml", "b.yaml"]}', 'Sure:\n```json\n["a.yaml", "b.yaml"]\n```', 'I take ["a.yaml","b.yaml"] then'):
        assert questions.routed_files(text, known) == ["a.yaml", "b.yaml"]
    assert questions.routed_files("none", known) == []


def test_anti_unification_on_some_paths(spark):
    attrs = spark.createDataFrame([("a", "p", "string", "1"), ("b", "p", "string", "1"), ("a", "q", "string", "1")], ATTRS)
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string")
    paths = spark.createDataFrame([("p",), ("q",), ("r",)], "path string")
    assert {tuple(r) for r in relations.anti_unify(attrs, pairs, paths).collect()} == {("a", "b", 1, 2), ("a", "z", 0, 3)}
    assert {tuple(r) for r in relations.anti_unify(attrs, pairs).collect()} == {("a", "b", 1, 1), ("a", "z", 0, 2)}


def test_sample_of_a_long_text(spark):
    texts = spark.createDataFrame([(1, "a" * 60_000), (2, "b" * 40_000), (3, None), (4, "")], "id int, text string")
    assert {(r.id, r.n) for r in documents.sample_texts(texts).select("id", F.length("text").alias("n")).collect()} == {(1, 30_000), (2, 20_000), (3, None), (4, 0)}


def test_doubles_as_texts(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((-0.0, 0.0, 1.0, -3.0, 2.5, None))], "k int, v double")
    assert [(r.entity_id, r.value) for r in leaves(df, "k", ["v"], "s").orderBy("entity_id").collect()] == [("0", "0"), ("1", "0"), ("2", "1"), ("3", "-3"), ("4", "2.5")]


def test_secrets_of_odd_lines(spark, tmp_path):
    rng = random.Random(5)
    key, token, grave = "aZ3kq9XwPz7LmN2vQe5RtYu8", "ghp_" + "a1" * 11, "̀"
    parts = [key, token, "AKIA" + "Q7" * 8, "password", "token", "a_b", "env.x", "command", " : ", ": ", "=", " ", "  ", "\t", "\r", "\x0b", " ", '"', "'", "x", "/etc/x.pem", "${A}", "://u:p@h", "12345678901234567890", "0822455D0A16", "ünï", "😀" * 9, f"e{grave}", "".join(map(chr, range(0x4E00, 0x4E20))), key[::-1] + " "]
    texts = ["", None, "\n", f"token: abc\rdef {key}", f"command: {key}", f"x: {key} ", f"a {key} b {token} {key}", "key: " * 5_000, "".join(rng.choices(key, k=700_000)) + "\n" + key] + ["".join(rng.choice(parts) if rng.random() < 0.9 else "\n" for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create table documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("secret_audit", "secret_mask"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
        # each text is read once, whatever is found
        assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_yaml_by_either_reader():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(6)
    parts = ["a", "b: ", "- ", "\n", "\n  ", '"x"', "{", "}", "[", "]", ", ", "# c", "|", ">", "1.5", "yes", "~", "&a ", "*a", "? ", ": ", "!!str ", "%", "\t", "---\n", "2020-01-01", "é", "k: v\n", "l:\n- 1\n- 2\n", ".inf", "<<: "]

    def tried(read, text):
        try:
            return json.dumps(read(text), default=str)
        except (yaml.YAMLError, ValueError, TypeError, RecursionError) as e:
            return type(e).__name__

    for text in ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3_000)] + ["[" * 5_000, "- " * 5_000, "|# c", "a\tb: \t1"]:
        assert tried(documents.read_yaml, text) == tried(lambda t: json.loads(json.dumps(yaml.safe_load(t), default=str)), text), text


def test_yaml_is_read_by_libyaml(monkeypatch):
    yaml = pytest.importorskip("yaml")
    if not yaml.__with_libyaml__:
        pytest.skip("no libyaml")
    monkeypatch.setattr(yaml.SafeLoader, "get_single_data", lambda self: pytest.fail("the slow reader"))
    assert documents.read_yaml("a: [1, x]\nb:\n- c: true\n") == {"a": [1, "x"], "b": [{"c": True}]}


def test_rows_are_made_a_few_at_a_time():
    import pyarrow as pa

    alive = [0]

    def work(k):
        for _ in range(k):
            alive[0] += 1
            yield (str(k),)

    counts = [3] * 10_000 + [10_000, 0, 1]
    batch, most, got = pa.record_batch([pa.array(counts)], ["k"]), 0, 0
    for out in documents._rows([("v", pa.string())], work)(iter([batch, batch.slice(0, 0)])):
        most, alive[0] = max(most, alive[0]), 0
        got += out.num_rows
    assert got == sum(counts) and most <= documents.MOST_ROWS + 10_000


def test_small_files_are_read_in_parts(spark, tmp_path):
    spark.range(45_000).selectExpr("id p_partkey", "concat('p', id) p_name", "'b' p_brand", "'t m' p_type", "cast(id % 50 as int) p_size", "1d p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["read_words"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 3 and got.count() == 135_000
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()


def test_paths_that_all_have_stay_apart(spark):
    rows = [(f"e{k}", p) for k in range(300) for p in ("a", "b") if p == "a" or k]
    leaves = spark.createDataFrame([(e, p, "v") for e, p in rows], "entity_id string, path string, value string").repartition(8)
    got = questions.existence(leaves)
    assert {tuple(r) for r in got.collect()} == {(f"e{k}", "b", "yes") for k in range(1, 300)} | {("e0", "b", "no")}
    # the leaves of one path are never brought together
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [path" in plan and "SortMergeJoin" not in plan


def test_classes_alone_and_sections_apart(spark):
    same = {"a": 1, "b": "x", "c": True}
    rows = [(f"h{k}", "net", same | {"a": k % 3}) for k in range(12)] + [(f"g{k}", "solo", {"id": k, "p": 1, "q": 2, "r": 3}) for k in range(4)]
    lv = spark.createDataFrame(section(rows), documents.SECTION_LEAVES)
    assert sorted(map(tuple, sections.classes(lv).collect())) == sorted(map(tuple, sections.factor(lv).classes.collect()))
    # written tables that are small are broadcast, so no side with all leaves is moved by the section
    one, two = cut(lv), cut(lv.select("section").distinct())
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(one.join(few(two), "section")) and "BroadcastHashJoin" not in plan(one.join(few(two, 1), "section"))


def test_sections_are_parsed_once(spark):
    got = catalogue.QUERIES["sections_mismatch"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in got._jdf.queryExecution().sparkPlan().toString() and got.first()["differences"] == 0
