"""Secrets: by path, by form and by the entropy of what has no form; what only looks like one is let be.

The first that holds decides: a path that always holds secrets, a harmless form, a known form, a path that is exempt
from entropy, the entropy of 16 characters or more; after these, forms of one platform. The rules are SQL text, so that
both engines run the same ones; null values have no method.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.values import entropy_sql, glob_regex

#: forms in order; Java and RE2 read them alike, and none holds a single quote (\x27)
PATTERNS = {
    "aws_access_key": r"AKIA[A-Z0-9]{16}",
    "azure_connection_string": r"(?i)defaultendpointsprotocol=https?;accountname=",
    "private_key_block": r"-----BEGIN ((DSA|EC|OPENSSH|RSA) )?PRIVATE KEY-----",
    "bearer_token": r"Bearer\s+[\w.~+/-]{20,}",
    "github_token": r"(gh[oprs]|github_pat)_\w{20,}",
    "generic_credential_pair": r"(?i)(passw(or)?d|secret|api_?key|access_key|private_key|auth_token)\s*[:=]\s*\S",
    "aws_secret_key": r"(?i)key.*[:=]\s*[\x27\"]?[a-z0-9/+=]{40}",
    "basic_auth_url": r"://[^\s/]+:[^\s/]+@[^\s/]",
    "jwt": r"eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}",
    "gitlab_pat": r"glpat-[\w-]{20,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "sendgrid": r"SG\.[\w-]{22,}\.[\w-]{22,}",
    "stripe": r"[rs]k_(test|live)_[A-Za-z0-9]{20,}",
    "cisco_type7": r"\b[0-9]{2}([0-9a-fA-F]{2}){4,}\b",
    "cisco_type89": r"\$[89]\$[^$\s]",
    "junos_encrypted": r"\$9\$[^$\s]",
}
#: forms that aren't secrets, of the value without white space around it
HARMLESS = {
    "word": r"(?i)^\s*(change_?me|dummy|example|fixme|placeholder|replace_me|sample|test|todo|xxx|your_(key|secret))\s*\z",
    "placeholder": r"(<[^>]+>|\{\{[^}]+\}\}|\$\{[^}]+\}|\$\([^)]+\)|%\([^)]+\)s)",
    "reference": r"(?i)^\s*((vault|ssm|arn|env|ref|secret|gsm|kms):|op://)",
    "path": r"(^\s*\.{0,2}/|\.(pem|crt|key|cert)\s*\z)",
    "url": r"(?i)^\s*https?://[^@]*\z",
    "uuid": r"^\s*[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\s*\z",
    "mac": r"^\s*(([0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}|([0-9a-fA-F]{4}\.){2}[0-9a-fA-F]{4})\s*\z",
    "ipv4": r"^\s*([0-9]{1,3}\.){3}[0-9]{1,3}(/[0-9]{1,2})?\s*\z",
    "ipv6": r"^\s*([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(/[0-9]{1,3})?\s*\z",
    "digits": r"^\s*[0-9]+\s*\z",
}
_ALWAYS = "password secret secrets secrets.* credentials credentials.* private_key api_key connection_string env.* token auth_token access_token client_secret client-secret encryption_key encryption-key db_password db-password"
PATHS = tuple(f"*.{x}" for x in _ALWAYS.split())
EXEMPT = tuple(f"*.{x}{y}" for x in ("healthcheck.test", "command", "entrypoint", "description", "comment") for y in ("", ".*"))
#: of network devices and of directories
NETWORK_PATHS = tuple(f"*.{x}" for x in "community snmp-community shared-secret shared_secret pre-shared-key psk md5-key authentication-key tacacs-key radius-key enable-secret enable-password".split())
DEVICE_PATHS = ("tacacs-server", "tacacs-server.key", "radius-server", "radius-server.key")
DIRECTORY_PATHS = ("*.secretText", "*.clientSecret")
DEVICE_FORMS = {
    "iosxr_key_7": r"\bkey\s+7\s+\S",
    "iosxr_secret_encrypted": r"\bsecret\s+[057]\s+\S",
    "iosxr_community_string": r"\bcommunity\s+\S+\s+R[OW]\b",
    "iosxr_community_inline": r"\bversion\s+2c\s+\S",
    "iosxr_key_string": r"\bkey-string\s+\S",
}
LEAST_LENGTH, BASE64_BITS, HEX_BITS = 16, 4.5, 3.0
_BASE64, _HEX = r"[A-Za-z0-9+/]{16,}", r"[0-9A-Fa-f]{16,}"
REDACTED = "[REDACTED]"


def _like(c: str, rule: str, duck: bool) -> str:
    return f"regexp_matches({c}, '{rule}')" if duck else f"({c} rlike r'{rule}')"


def charset_sql(c: str, duck: bool = False, base64_bits: float = BASE64_BITS, hex_bits: float = HEX_BITS) -> str:
    """Whether the entropy is above the limit of the characters: a run of base64 comes first, a hexadecimal one counts unless all are digits."""
    bits = entropy_sql(c, duck)
    return f"CASE WHEN {_like(c, _BASE64, duck)} THEN {bits} >= {base64_bits} WHEN {_like(c, _HEX, duck)} THEN NOT {_like(c, '^[0-9]+$', duck)} AND {bits} >= {hex_bits} ELSE {bits} >= {base64_bits} END"


def first_sql(c: str, rules: dict[str, str], duck: bool = False, mark: str = "") -> str:
    """The name of the first rule that a value matches, or null."""
    return "CASE " + " ".join(f"WHEN {_like(c, r, duck)} THEN '{mark}{n}'" for n, r in rules.items()) + " END"


def _any(c: str, globs: tuple[str, ...], duck: bool) -> str:
    return _like(c, "|".join(glob_regex(g, across=True) for g in globs), duck) if globs else "false"


def detect_sql(value: str, path: str, duck: bool = False, paths: tuple[str, ...] = PATHS, forms: dict[str, str] | None = None) -> str:
    """The method by which a value is found to be a secret, or null: path_pattern, regex:name, entropy or value_pattern:name."""
    harmless = " OR ".join(_like(value, r, duck) for r in HARMLESS.values())
    core = f"CASE WHEN {value} IS NULL THEN NULL WHEN {_any(path, paths, duck)} THEN 'path_pattern' WHEN {harmless} THEN NULL "
    core += " ".join(f"WHEN {_like(value, r, duck)} THEN 'regex:{n}'" for n, r in PATTERNS.items())
    core += f" WHEN {_any(path, EXEMPT, duck)} THEN NULL WHEN length({value}) >= {LEAST_LENGTH} AND ({charset_sql(value, duck)}) THEN 'entropy' END"
    return f"coalesce({core}, {first_sql(value, forms, duck, 'value_pattern:')})" if forms else core


def detect(value: str = "value", path: str = "path", paths: tuple[str, ...] = PATHS, forms: dict[str, str] | None = None) -> Column:
    return F.expr(detect_sql(value, path, False, paths, forms))


def mask_attributes(attrs: DataFrame, paths: tuple[str, ...] = PATHS, forms: dict[str, str] | None = None) -> DataFrame:
    """The attributes (entity_id, path, attr_type, value) with secrets replaced and their method (else null), paths led by the entity.

    Members of composites are looked at one by one and masked in place; a composite's method is that of its first secret.
    """
    one = lambda v, p: detect_sql(v, p, False, paths, forms)
    whole = "concat(entity_id, '.', path)"
    plain = F.expr(one("value", whole))
    maps = F.from_json("value", "map<string,map<string,string>>")
    lists = F.from_json("value", "array<map<string,string>>")
    inner = lambda at: f"transform_values(m, (f, v) -> struct(v AS v, {one('v', at)} AS method))"
    found = attrs.withColumn("_maps", F.when(F.col("attr_type") == "map", maps)).withColumn("_lists", F.when(F.col("attr_type") == "list", lists))
    at_map = "concat(" + whole + ", '.', k, '.', f)"
    at_list = "concat(" + whole + ", '[', i, '].', f)"
    found = found.withColumn("_maps", F.expr(f"transform_values(_maps, (k, m) -> {inner(at_map)})")).withColumn("_lists", F.expr(f"transform(_lists, (m, i) -> {inner(at_list)})"))
    clean = "transform_values(m, (f, s) -> if(s.method IS NULL, s.v, '" + REDACTED + "'))"
    first = lambda members: f"element_at(filter(flatten(transform({members}, m -> transform(map_values(m), s -> s.method))), x -> x IS NOT NULL), 1)"
    method = F.expr(f"CASE WHEN attr_type = 'map' THEN try_element_at(filter(flatten(transform(map_values(_maps), m -> transform(map_values(m), s -> s.method))), x -> x IS NOT NULL), 1) WHEN attr_type = 'list' THEN try_{first('_lists')} END")
    out = found.withColumn("method", F.when(F.col("attr_type").isin("map", "list"), method).otherwise(plain))
    value = F.expr(f"CASE WHEN attr_type = 'map' THEN to_json(transform_values(_maps, (k, m) -> {clean})) WHEN attr_type = 'list' THEN to_json(transform(_lists, m -> {clean})) WHEN method IS NOT NULL THEN '{REDACTED}' ELSE value END")
    return out.withColumn("value", F.when(F.col("attr_type").isin("map", "list") & F.col("method").isNull(), F.col("value")).otherwise(value)).drop("_maps", "_lists")


#: a line that gives a name a value; the value may be quoted
ASSIGNMENT = r"^\s*([A-Za-z_][\w-]*)\s*[:=]\s*[\"\x27]?(.*?)[\"\x27]?\s*\z"


def line_units_sql(duck: bool = False) -> tuple[str, str, str]:
    """(path, value, method) of a line of a text: that of the value it assigns, or of the line itself."""
    get = lambda n: f"regexp_extract(line, '{ASSIGNMENT}', {n})" if duck else f"regexp_extract(line, r'{ASSIGNMENT}', {n})"
    path = f"CASE WHEN {get(1)} <> '' THEN concat('text.', {get(1)}) ELSE 'text' END"
    value = f"CASE WHEN {get(1)} <> '' THEN {get(2)} ELSE line END"
    return path, value, detect_sql("value", "path", duck)


# the same over whole columns: RE2 reads a text once for all rules, so lines and words are looked at in Arrow

#: methods that ``detect_sql`` gives without forms of a platform, in order
METHODS = ["path_pattern", *(f"regex:{n}" for n in PATTERNS), "entropy"]
_HELD = r"^\s*(?P<name>[A-Za-z_][\w-]*)\s*[:=]\s*[\"\x27]?(?P<value>.*?)[\"\x27]?\s*\z"  # ASSIGNMENT with named groups
_SLICE = 2**21  # bytes of text that are looked at together


def _holds(c: pa.Array, rules: Iterable[str]) -> np.ndarray:
    return pc.match_substring_regex(c, "|".join(f"(?:{r})" for r in rules)).to_numpy(zero_copy_only=False).astype(bool)


def _bits(values: list[str]) -> np.ndarray:
    """Bits a character of texts that aren't empty, as ``entropy_sql`` gives them."""
    out, at, n = np.empty(len(values)), 0, np.array([len(v) for v in values], np.int64)
    while at < len(values):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(n[at : at + _SLICE]), 2**19)))
        if to == at + 1:
            c = np.fromiter(Counter(values[at]).values(), float)
            said = np.array([(c * np.log2(c)).sum()])
        else:
            codes = np.frombuffer("".join(values[at:to]).encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.cumsum(np.bincount(codes) > 0) - 1
            width = int(place[-1]) + 1
            k = np.repeat(np.arange(to - at), n[at:to]) * width + place[codes]
            if width * (to - at) <= 4 * len(k):
                c = np.bincount(k, minlength=width * (to - at))
                said = (c * np.log2(np.maximum(c, 1))).reshape(to - at, width).sum(1)
            else:  # many kinds of characters
                k, c = np.unique(k, return_counts=True)
                said = np.bincount(k // width, c * np.log2(c), to - at)
        out[at:to] = np.round(np.log2(n[at:to]) - said / n[at:to], 6)
        at = to
    return out


def methods(value: pa.Array, path: pa.Array) -> np.ndarray:
    """The place in METHODS of each value's method, -1 for none: ``detect_sql`` of columns without nulls."""
    globs = lambda x: [glob_regex(g, across=True) for g in x]
    out = np.where(_holds(path, globs(PATHS)), 0, -1).astype(np.int16)
    harmless = _holds(value, HARMLESS.values())
    form = np.flatnonzero((out < 0) & ~harmless & _holds(value, PATTERNS.values()))
    some = value.take(pa.array(form))
    for k, r in reversed(list(enumerate(PATTERNS.values(), 1))):  # the first rule is written last
        out[form[_holds(some, [r])]] = k
    # a run of hexadecimal digits is one of base64 too, whose limit holds; fewer characters than 2 ** limit can't reach it
    least = max(LEAST_LENGTH, math.ceil(2**BASE64_BITS))
    rest = np.flatnonzero((out < 0) & ~harmless & (pc.utf8_length(value).to_numpy(zero_copy_only=False) >= least) & ~_holds(path, globs(EXEMPT)))
    out[rest[_bits(value.take(pa.array(rest)).to_pylist()) >= BASE64_BITS]] = len(METHODS) - 1
    return out


def _split(c: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of texts, the text each is of and its place there; null texts have none."""
    parts = pc.split_pattern(c, mark)
    of = pc.list_parent_indices(parts).to_numpy()
    return parts.flatten(), of, np.arange(len(of)) - parts.offsets.to_numpy()[of]


def _scanned(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, their texts, their places, their methods) and (the line, place and method of each word that is a secret) of
    the lines that have no method."""
    lines, of, no = _split(text, "\n")
    held = np.flatnonzero(_holds(lines, [r"^\s*[A-Za-z_][\w-]*\s*[:=]"]))
    told = pc.extract_regex(lines.take(pa.array(held)), _HELD)
    mask = np.zeros(len(lines), bool)
    mask[held[told.is_valid().to_numpy(zero_copy_only=False)]] = True
    told = told.drop_null()
    name, value = (pc.struct_field(told, n).cast(lines.type) for n in ("name", "value"))
    path = pc.replace_with_mask(pa.array(["text"] * len(lines), lines.type), pa.array(mask), pc.binary_join_element_wise(pa.scalar("text", lines.type), name, pa.scalar(".", lines.type)))
    found = methods(pc.replace_with_mask(lines, pa.array(mask), value), path)
    at = np.flatnonzero((found < 0) & _holds(lines, [f"[^ ]{{{LEAST_LENGTH}}}"]))
    words, line, place = _split(lines.take(pa.array(at)), " ")
    long = np.flatnonzero(pc.utf8_length(words).to_numpy(zero_copy_only=False) >= LEAST_LENGTH)
    line = at[line[long]]
    seen = methods(words.take(pa.array(long)), path.take(pa.array(line)))
    hit = seen >= 0
    return lines, of, no, found, line[hit], place[long][hit], seen[hit]


def _slices(key: pa.Array, text: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """A batch in slices of about _SLICE bytes of text."""
    at = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // _SLICE
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(text)]
    for a, b in zip(edges, edges[1:]):
        yield key.slice(a, b - a), text.slice(a, b - a)


def _pass(docs: DataFrame, key: str, text: str, schema: str, work: Callable[..., list[pa.Array]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in _slices(*b.columns):
                out = work(k, t)
                yield pa.RecordBatch.from_arrays(out, names)

    names = [key, *(x.split()[0] for x in schema.split(", "))]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.select(key).dtypes[0][1]}, {schema}")


def audit_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, word_no, method) of each secret; word_no is -1 for a whole line or an assigned value. Never the value."""

    def work(k: pa.Array, t: pa.Array) -> list[pa.Array]:
        _, of, no, found, line, place, seen = _scanned(t)
        whole = np.flatnonzero(found >= 0)
        at = np.concatenate([whole, line])
        word = np.concatenate([np.full(len(whole), -1), place])
        method = pa.array(METHODS).take(pa.array(np.concatenate([found[whole], seen]), pa.int32()))
        return [k.take(pa.array(of[at])), pa.array(no[at], pa.int32()), pa.array(word, pa.int32()), method]

    return _pass(docs, key, text, "line_no int, word_no int, method string", work)


def mask_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line) with secrets replaced: the line, or the words that are."""

    def work(k: pa.Array, t: pa.Array) -> list[pa.Array]:
        lines, of, no, found, line, place, _ = _scanned(t)
        new = {int(x): REDACTED for x in np.flatnonzero(found >= 0)}
        cut: dict[int, list[str]] = {}
        for x, p in zip(line.tolist(), place.tolist()):
            cut.setdefault(x, lines[x].as_py().split(" "))[p] = REDACTED
        new |= {x: " ".join(words) for x, words in cut.items()}
        mask = np.zeros(len(lines), bool)
        mask[list(new)] = True
        said = pc.replace_with_mask(lines, pa.array(mask), pa.array([new[x] for x in sorted(new)], lines.type))
        return [k.take(pa.array(of)), pa.array(no, pa.int32()), said.cast(pa.string())]

    return _pass(docs, key, text, "line_no int, line string", work)
