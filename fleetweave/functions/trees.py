"""Parsed documents as trees of dict, list and scalar: canonical keys, flattening and its inverse, access, rendering.

These are the pure functions behind the Arrow passes of ``sources.documents``; none needs Spark.
"""

from __future__ import annotations

import hashlib
import json
import math
from fnmatch import fnmatchcase

Tree = dict | list | str | int | float | bool | None


def canonical(v: Tree) -> Tree:
    """The tree with keys as strings in order, whole doubles as integers and tuples as lists; other kinds become text."""
    if isinstance(v, dict):
        return {str(k): canonical(x) for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))}
    if isinstance(v, list | tuple):
        return [canonical(x) for x in v]
    if isinstance(v, bool) or v is None or isinstance(v, int | str):
        return v
    if isinstance(v, float):
        if not math.isfinite(v):
            return str(v)
        return int(v) if v == int(v) and not (v == 0 and math.copysign(1, v) < 0) else v
    return str(v)


_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode  # json.dumps makes an encoder a call


def value_key(v: Tree) -> str:
    """One text for equal values: 1.0 and 1 are equal, true and 1 are not, nor "1" and 1."""
    return _encode(v if isinstance(v, str | bool) else canonical(v))


def value_signature(v: Tree) -> str:
    """Kind and value, for the stricter equality of sections: 1.0 and 1 differ."""
    return f"{type(v).__name__}|{json.dumps(v, sort_keys=True, separators=(',', ':'), default=str)}"


def content_hash(v: Tree) -> str:
    return hashlib.sha256(value_key(v).encode()).hexdigest()


def normalise(v: Tree) -> Tree:
    """The tree with the keys of all dicts in order."""
    if isinstance(v, dict):
        return {k: normalise(v[k]) for k in sorted(v, key=str)}
    return [normalise(x) for x in v] if isinstance(v, list) else v


def empty(v: Tree) -> bool:
    return v is None or (isinstance(v, dict | list) and not v)


def scalar(v: Tree) -> bool:
    return isinstance(v, str | int | float | bool)


def text_of(v: Tree) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def kind_of(v: Tree) -> str:
    for kind, name in ((bool, "boolean"), (int, "number"), (float, "number"), (str, "string"), (dict, "map"), (list, "list")):
        if isinstance(v, kind):
            return name
    return "null"


def alike(v: Tree, least: float = 0.5) -> bool:
    """Whether all members are dicts whose key sets have a mean pairwise Jaccard similarity of ``least``; one alone needs two keys.

    Equal key sets are counted once with their number, so the pairs are those of distinct key sets.
    """
    if not isinstance(v, dict) or not v or not all(isinstance(x, dict) for x in v.values()):
        return False
    if len(v) == 1:
        return len(next(iter(v.values()))) >= 2
    sets: dict[frozenset, int] = {}
    for x in v.values():
        sets[frozenset(x)] = sets.get(frozenset(x), 0) + 1
    total, seen = 0.0, list(sets.items())
    for i, (a, n) in enumerate(seen):
        total += n * (n - 1) / 2
        total += sum(n * m * (len(a & b) / len(a | b) if a | b else 1.0) for b, m in seen[i + 1 :])
    return total / (len(v) * (len(v) - 1) / 2) >= least


def item_row(v: Tree, depth: int = 3) -> dict[str, str]:
    """A member of a composite as one flat dict of texts: dicts to three levels, lists of others by position."""
    out: dict[str, str] = {}

    def put(path: str, x: Tree, level: int) -> None:
        if empty(x):
            return
        if isinstance(x, dict) and level < depth:
            for k, y in x.items():
                put(f"{path}.{k}", y, level + 1)
        elif isinstance(x, list) and level == 1:
            if all(map(scalar, x)):
                out[path] = ",".join(map(text_of, x))
                return
            for i, y in enumerate(x):
                if isinstance(y, dict):
                    for k, z in y.items():
                        if not empty(z):
                            out[f"{path}.{i}.{k}"] = text_of(z)
                elif not empty(y):
                    out[f"{path}.{i}"] = text_of(y)
        else:
            out[path] = text_of(x)

    for k, x in v.items() if isinstance(v, dict) else ():
        put(str(k), x, 1)
    return out


def flatten(doc: Tree, overrides: dict[str, str] | None = None, joint: str = ",") -> tuple[dict[str, str], dict[str, tuple[str, Tree]]]:
    """(path: text, path: (kind, composite)) of a document.

    Dicts give dotted paths; nulls and empty members go; lists of scalars are joined, of dicts are composite lists; dicts
    of like dicts are composite maps, as are those whose path matches an override (a file glob); of mixed lists only
    scalars stay. A list of one dict at the root is that dict.
    """
    flat: dict[str, str] = {}
    composite: dict[str, tuple[str, Tree]] = {}

    def member(x: Tree) -> dict[str, str]:
        return item_row(x) if isinstance(x, dict) else {"_value": text_of(x)}

    def visit(v: Tree, path: str) -> None:
        if empty(v):
            return
        here = path or "_root"
        if isinstance(v, list):
            if not path and len(v) == 1 and isinstance(v[0], dict):
                visit(v[0], path)
            elif all(isinstance(x, dict) for x in v):
                composite[here] = ("list", [item_row(x) for x in v])
            elif path and (said := [text_of(x) for x in v if scalar(x)]) or (not path and all(map(scalar, v)) and (said := [text_of(x) for x in v])):
                flat[here] = joint.join(said)
        elif isinstance(v, dict):
            forced = next((k for g, k in (overrides or {}).items() if fnmatchcase(path, g)), None) if path else None
            if forced == "list":
                composite[here] = ("list", [member(x) for x in v.values()])
            elif forced == "map" or (path and alike(v)):
                composite[here] = ("map", {str(k): member(x) for k, x in v.items()})
            else:
                for k, x in v.items():
                    visit(x, f"{path}.{k}" if path else str(k))
        else:
            flat[here] = text_of(v)

    visit(doc, "")
    return flat, composite


def walk(doc: Tree, path: str = "") -> list[tuple[str, str]]:
    """All leaves (path, text), lists by position: a walk of its own, so that it can be held against ``flatten``."""
    if empty(doc):
        return []
    if isinstance(doc, dict):
        return [leaf for k, v in doc.items() for leaf in walk(v, f"{path}.{k}" if path else str(k))]
    if isinstance(doc, list):
        if all(map(scalar, doc)) or (path and not all(isinstance(x, dict) for x in doc)):
            said = [text_of(x) for x in doc if scalar(x)]
            return [(path or "_root", ",".join(said))] if said else []
        if not path and len(doc) == 1 and isinstance(doc[0], dict):
            return walk(doc[0])
        return [leaf for i, v in enumerate(doc) for leaf in walk(v, f"{path}[{i}]")]
    return [(path or "_root", text_of(doc))]


def composite_leaves(path: str, kind: str, data: Tree) -> list[tuple[str, str]]:
    """The leaves of a composite: map members by key, list members by position."""
    rows = data.items() if kind == "map" else ((f"[{i}]", x) for i, x in enumerate(data))
    return [(f"{path}{'.' if kind == 'map' else ''}{k}" + ("" if f == "_value" else f".{f}"), v) for k, x in rows for f, v in x.items()]


def escape(key: str) -> str:
    return key.replace("\\", "\\\\").replace(".", "\\.")


def split_path(path: str) -> list[str]:
    """The keys of an escaped dotted path."""
    out, now, at = [], [], 0
    while at < len(path):
        if path[at] == "\\" and at + 1 < len(path):
            at += 1
            now.append(path[at])
        elif path[at] == ".":
            out.append("".join(now))
            now = []
        else:
            now.append(path[at])
        at += 1
    return [*out, "".join(now)]


def section_leaves(v: Tree, path: str = "") -> list[tuple[str, Tree]]:
    """Leaves with their own types; lists and empty dicts are leaves, dots in keys are escaped. An empty root is one leaf of path ''."""
    if isinstance(v, dict) and v:
        return [leaf for k, x in v.items() for leaf in section_leaves(x, f"{path}.{escape(str(k))}" if path else escape(str(k)))]
    return [(path, v)]


def unflatten(leaves: list[tuple[str, Tree]]) -> Tree:
    """The tree of ``section_leaves``."""
    out: Tree = {}
    for path, v in sorted(leaves, key=lambda x: x[0]):
        if path == "":
            return v
        keys = split_path(path)
        at = out
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        at[keys[-1]] = v
    return out


def get(v: Tree, path: str, default: Tree = None) -> Tree:
    for k in split_path(path):
        if not isinstance(v, dict) or k not in v:
            return default
        v = v[k]
    return v


def put(v: dict, path: str, x: Tree) -> dict:
    """The tree with x at the path; dicts on the way are made."""
    *way, last = split_path(path)
    at = v
    for k in way:
        if not isinstance(at.get(k), dict):
            at[k] = {}
        at = at[k]
    at[last] = x
    return v


def remove(v: dict, path: str) -> dict:
    """The tree without what is at the path; nothing happens if that isn't there. Dicts left empty go too."""
    way, at = [], v
    *keys, last = split_path(path)
    for k in keys:
        if not isinstance(at, dict) or k not in at:
            return v
        way.append((at, k))
        at = at[k]
    if isinstance(at, dict):
        at.pop(last, None)
        for up, k in reversed(way):
            if up[k] == {}:
                del up[k]
    return v


def collapse(v: Tree) -> Tree:
    """Chains of dicts with one member become one dotted key, dots in keys escaped; keys that begin with _ are left alone."""
    if isinstance(v, list):
        return [collapse(x) for x in v]
    if not isinstance(v, dict):
        return v
    out = {}
    for k, x in v.items():
        x, own = collapse(x), str(k)
        if not own.startswith("_"):
            own = escape(own)
            if isinstance(x, dict) and len(x) == 1 and not next(iter(x)).startswith("_"):
                inner, x = next(iter(x.items()))
                own = f"{own}.{inner}"
        out[own] = x
    return out


def expand(v: Tree) -> Tree:
    """The inverse of ``collapse``."""
    if isinstance(v, list):
        return [expand(x) for x in v]
    if not isinstance(v, dict):
        return v
    out: dict = {}
    for k, x in v.items():
        keys = [k] if str(k).startswith("_") else split_path(str(k))
        at = out
        for j in keys[:-1]:
            at = at.setdefault(j, {})
        x = expand(x)
        if isinstance(x, dict) and isinstance(at.get(keys[-1]), dict):
            at[keys[-1]].update(x)
        else:
            at[keys[-1]] = x
    return out


def list_rows(items: list[dict]) -> list[tuple[str, Tree]]:
    """A list of dicts as rows ([position].field, value)."""
    return [(f"[{i}].{escape(str(k))}", v) for i, x in enumerate(items) for k, v in x.items()]


def list_of(rows: list[tuple[str, Tree]]) -> list[dict]:
    """The list of ``list_rows``."""
    out: dict[int, dict] = {}
    for path, v in rows:
        at, _, key = path[1:].partition("].")
        out.setdefault(int(at), {})[split_path(key)[0]] = v
    return [out[i] for i in sorted(out)]


#: what only the section level may hold
REFERENCES = ("_list_class", "_instances", "_also")


def check_classes(classes: dict) -> None:
    """Refuses class bodies with list references in them."""
    for name, body in classes.items():
        stack = [body]
        while stack:
            v = stack.pop()
            if isinstance(v, dict):
                bad = [k for k in REFERENCES if k in v]
                if bad:
                    raise ValueError(f"class {name} holds {', '.join(bad)}")
                stack.extend(v.values())
            elif isinstance(v, list):
                stack.extend(v)


def _plain(v: Tree) -> str:
    """A scalar in YAML: as it is where it can't be read as anything else, in JSON's quotes otherwise."""
    if not isinstance(v, str):
        return "null" if v is None else text_of(v)
    safe = v and v[0].isalpha() and all(c.isalnum() or c in "_-./ " for c in v) and v == v.strip() and v.lower() not in ("true", "false", "yes", "no", "on", "off", "null", "y", "n")
    return v if safe else json.dumps(v, ensure_ascii=False)


def render(v: Tree, indent: int = 0) -> str:
    """YAML text: chains collapsed, keys with _ first, dicts of up to six scalars in one line within lists, identity lists in one line."""
    return _render(collapse(v) if indent == 0 else v, indent)


def _render(v: Tree, indent: int) -> str:
    pad = "  " * indent
    if isinstance(v, dict) and v:
        out = []
        for k in sorted(v, key=lambda k: (not str(k).startswith("_"), str(k))):
            x, key = v[k], _plain(str(k))
            if str(k) == "_identity" and isinstance(x, list):
                out.append(f"{pad}{key}: [{', '.join(map(_plain, x))}]")
            elif isinstance(x, dict | list) and x:
                out.append(f"{pad}{key}:\n{_render(x, indent + 1)}")
            else:
                out.append(f"{pad}{key}: {_render(x, 0)}")
        return "\n".join(out)
    if isinstance(v, list) and v:
        out = []
        for x in v:
            if isinstance(x, dict) and 0 < len(x) <= 6 and not any(isinstance(y, dict | list) for y in x.values()):
                flow = ", ".join(f"{_plain(str(k))}: {_plain(y)}" for k, y in x.items())
                out.append(f"{pad}- {{{flow}}}")
            elif isinstance(x, dict | list) and x:
                out.append(f"{pad}-\n{_render(x, indent + 1)}")
            else:
                out.append(f"{pad}- {_render(x, 0)}")
        return "\n".join(out)
    return "{}" if v == {} else "[]" if v == [] else _plain(v)
