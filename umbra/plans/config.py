"""Layered configuration, validated as a whole, compiled into a Detection and a Policy.

Layers, later ones over earlier: defaults, the user's file, the project's file (or one that is named), UMBRA_* environment
variables, --set arguments. Tables merge key by key; any other value, lists too, is replaced whole.
"""

from __future__ import annotations

import difflib
import json
import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

from ..functions.model import Policy
from ..functions.regex import UnsafePattern, check_safe
from ..functions.rules import BUILT_IN, NAME, NER_LABELS, STRATEGIES, Detection, Rule

DEFAULTS: dict = {"umbra": {"packs": ["intl"], "default_strategy": "replace"}, "entities": {}, "custom": {}, "exclusions": {"values": [], "patterns": []}}
ENV, ENV_RESERVED = "UMBRA_", ("UMBRA_STORE_KEY", "UMBRA_HASH_KEY")
USER_FILES = tuple(f"config.{e}" for e in ("toml", "yaml", "yml", "json"))
PROJECT_FILES = (".umbrarc", ".umbrarc.toml", ".umbrarc.yaml", ".umbrarc.yml", ".umbrarc.json")
#: Keys of each table; "*" stands for a name of the user's choice.
SCHEMA = {"umbra": {"packs": "list", "default_strategy": "strategy"}, "entities": {"*": {"enabled": "bool", "threshold": "unit", "strategy": "strategy"}}, "custom": {"*": {"pattern": "pattern!", "score": "unit!", "context": "list"}}, "exclusions": {"values": "list", "patterns": "patterns"}}


@dataclass(frozen=True)
class Issue:
    path: tuple[str, ...]
    message: str
    suggestion: str | None = None

    def line(self, where: str = "") -> str:
        hint = f" (did you mean '{self.suggestion}'?)" if self.suggestion else ""
        return f"{where}: " * bool(where) + f"{'.'.join(self.path)} - {self.message}{hint}"


class ConfigError(ValueError):
    """All problems of a configuration; values of secrets are not in its text."""

    def __init__(self, lines: list[str]):
        super().__init__("\n".join(lines))
        self.lines = lines


@dataclass(frozen=True)
class Layer:
    source: str  # default, user, project, env, cli
    data: dict
    where: Mapping[tuple[str, ...], str] = field(default_factory=dict)


@dataclass(frozen=True)
class Resolved:
    data: dict
    provenance: dict[tuple[str, ...], tuple[str, str]]
    warnings: list[str] = field(default_factory=list)


# ---- files ---------------------------------------------------------------------------------------------------------------
def load_file(path: Path) -> tuple[dict, dict[tuple[str, ...], str]]:
    """The table of a TOML (by default), YAML or JSON file, and file:line of its keys."""
    text = path.read_text()
    try:
        if path.suffix in (".yaml", ".yml"):
            import yaml

            data, lines = yaml.safe_load(text) or {}, _yaml_lines(yaml.compose(text))
        elif path.suffix == ".json":
            data, lines = json.loads(text), _indent_free_lines(text, json.loads(text))
        else:
            data, lines = tomllib.loads(text), _toml_lines(text)
    except (ValueError, ImportError) as e:
        raise ConfigError([f"{path.name}: {type(e).__name__}: cannot be parsed"]) from e
    except Exception as e:  # PyYAML's own errors
        raise ConfigError([f"{path.name}: {type(e).__name__}: cannot be parsed"]) from e
    if not isinstance(data, dict):
        raise ConfigError([f"{path.name}: the top level must be a table"])
    return data, {k: f"{path.name}:{n}" for k, n in lines.items()}


def _toml_lines(text: str) -> dict[tuple[str, ...], int]:
    out, table = {}, ()
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*\[([^\[\]]+)\]", line):
            table = tuple(x.strip().strip("\"'") for x in m[1].split("."))
            out[table] = n
        elif m := re.match(r"\s*([\w.\"'-]+)\s*=", line):
            out[(*table, *(x.strip("\"'") for x in m[1].split(".")))] = n
    return out


def _yaml_lines(node, at: tuple[str, ...] = ()) -> dict[tuple[str, ...], int]:
    out = {}
    for k, v in getattr(node, "value", None) or () if type(node).__name__ == "MappingNode" else ():
        out[(*at, str(k.value))] = k.start_mark.line + 1
        out |= _yaml_lines(v, (*at, str(k.value)))
    return out


def _indent_free_lines(text: str, data: Any, at: tuple[str, ...] = ()) -> dict[tuple[str, ...], int]:
    """JSON keys in the order of the text: each is looked for after the one before."""
    out, pos = {}, 0

    def walk(value: Any, at: tuple[str, ...]) -> None:
        nonlocal pos
        for k, v in value.items() if isinstance(value, dict) else ():
            found = re.compile(re.escape(json.dumps(k)) + r"\s*:").search(text, pos)
            if found:
                pos = found.end()
                out[(*at, k)] = text.count("\n", 0, found.start()) + 1
            walk(v, (*at, k))

    walk(data, at)
    return out


def user_file(home: Path | None = None) -> Path | None:
    base = (home or Path.home()) / ".config" / "umbra"
    return next((p for n in USER_FILES if (p := base / n).is_file()), None)


def project_file(start: Path | None = None, home: Path | None = None) -> Path | None:
    """The nearest file upwards from start; never the home folder's; the search ends with a folder that has .git."""
    home = home or Path.home()
    here = (start or Path.cwd()).resolve()
    for d in (here, *here.parents):
        if d != home:
            for n in PROJECT_FILES:
                if (d / n).is_file():
                    return d / n
        if (d / ".git").exists():
            return None
    return None


# ---- layers ----------------------------------------------------------------------------------------------------------------
def scalar(text: str) -> Any:
    """A value from a variable or argument: JSON, else a comma list, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return [x.strip() for x in text.split(",")] if "," in text else text


def _put(data: dict, path: tuple[str, ...], value: Any) -> None:
    for p in path[:-1]:
        data = data.setdefault(p, {})
    data[path[-1]] = value


def _kind(path: tuple[str, ...]) -> Any:
    s: Any = SCHEMA
    for p in path:
        s = (s.get(p) or s.get("*")) if isinstance(s, dict) else None
    return s


def _listed(path: tuple[str, ...], value: Any) -> Any:
    """A list's only element may be given bare."""
    return [value] if _kind(path) in ("list", "patterns") and not isinstance(value, list) else value


def env_layer(environ: Mapping[str, str]) -> Layer:
    data, where, bad = {}, {}, []
    for name in sorted(n for n in environ if n.startswith(ENV) and n not in ENV_RESERVED):
        parts = name.removeprefix(ENV).split("__")
        top = parts[0].lower()
        path = ("umbra", top) if len(parts) == 1 else (top, *(p if top in ("entities", "custom") and i == 0 else p.lower() for i, p in enumerate(parts[1:])))
        if _kind(path) is None or isinstance(_kind(path), dict):
            bad.append(Issue(path, "unknown setting").line(name))
            continue
        _put(data, path, _listed(path, scalar(environ[name])))
        where[path] = name
    if bad:
        raise ConfigError(bad)
    return Layer("env", data, where)


def set_layer(items: list[str]) -> Layer:
    data, where, bad = {}, {}, []
    for item in items:
        key, eq, value = item.partition("=")
        path = tuple(key.strip().split("."))
        if not eq or not all(path) or _kind(path) is None or isinstance(_kind(path), dict):
            bad.append(Issue(path, "expected section.key=value of a known setting").line("--set"))
            continue
        _put(data, path, _listed(path, scalar(value)))
        where[path] = "--set"
    if bad:
        raise ConfigError(bad)
    return Layer("cli", data, where)


def merge(layers: list[Layer]) -> tuple[dict, dict[tuple[str, ...], tuple[str, str]]]:
    """One table, and for each leaf the last layer that gave it, with its place."""
    out: dict = {}
    prov: dict[tuple[str, ...], tuple[str, str]] = {}

    def lay(into: dict, new: dict, at: tuple[str, ...], layer: Layer) -> None:
        for k, v in new.items():
            path = (*at, k)
            if isinstance(v, dict) and isinstance(into.get(k, {}), dict):
                lay(into.setdefault(k, {}), v, path, layer)
                continue
            into[k] = json.loads(json.dumps(v, default=str)) if isinstance(v, dict) else v
            near = next((layer.where[path[:i]] for i in range(len(path), 0, -1) if path[:i] in layer.where), "")
            for old in [p for p in prov if p[: len(path)] == path]:
                del prov[old]
            prov[path] = (layer.source, near)

    for layer in layers:
        lay(out, layer.data, (), layer)
    return out, prov


# ---- validation --------------------------------------------------------------------------------------------------------------
def _named(value: Any) -> str:
    return "null" if value is None else {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "table"}.get(type(value), type(value).__name__)


def _leaf(kind: str, value: Any, path: tuple[str, ...]) -> list[Issue]:
    kind = kind.rstrip("!")
    if value is None and kind in ("unit", "strategy"):
        return []
    if kind == "bool":
        return [] if isinstance(value, bool) else [Issue(path, f"must be a boolean, got {_named(value)}")]
    if kind == "unit":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return [Issue(path, f"must be a number between 0.0 and 1.0, got {_named(value)}")]
        return [] if 0 <= value <= 1 else [Issue(path, f"must be between 0.0 and 1.0, got {value}")]
    if kind == "strategy":
        if not isinstance(value, str):
            return [Issue(path, f"must be a string, got {_named(value)}")]
        close = difflib.get_close_matches(value, STRATEGIES, 1)
        return [] if value in STRATEGIES else [Issue(path, f"is not a strategy (expected one of {', '.join(STRATEGIES)})", close[0] if close else None)]
    if kind == "pattern":
        if not isinstance(value, str):
            return [Issue(path, f"must be a string, got {_named(value)}")]
        try:
            check_safe(value)
        except UnsafePattern as e:
            return [Issue(path, str(e))]
        return []
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        return [Issue(path, "must be a list of strings")]
    return [i for n, x in enumerate(value) for i in _leaf("pattern", x, (*path, str(n)))] if kind == "patterns" else []


def validate(data: Any, schema: Any = None, path: tuple[str, ...] = ()) -> list[Issue]:
    """Every problem, not the first only."""
    schema = SCHEMA if schema is None else schema
    if isinstance(schema, str):
        return _leaf(schema, data, path)
    if not isinstance(data, dict):
        return [Issue(path, f"must be a table, got {_named(data)}")]
    out = []
    for k, v in data.items():
        sub = schema.get(k)
        if sub is None and "*" in schema:
            if not NAME.fullmatch(str(k)):
                out.append(Issue((*path, str(k)), "entity name must be UPPER_SNAKE, e.g. EMPLOYEE_ID"))
                continue
            sub = schema["*"]
        if sub is None:
            close = difflib.get_close_matches(str(k), list(schema), 1)
            out.append(Issue((*path, str(k)), "unknown key", close[0] if close else None))
        else:
            out += validate(v, sub, (*path, str(k)))
    return out + [Issue((*path, k), f"missing required field '{k}'") for k, s in schema.items() if isinstance(s, str) and s.endswith("!") and k not in data]


def resolve_config(*, config: Path | None = None, sets: list[str] = (), environ: Mapping[str, str] | None = None, start: Path | None = None, home: Path | None = None) -> Resolved:
    layers = [Layer("default", DEFAULTS)]
    for source, path in (("user", user_file(home)), ("project", config or project_file(start, home))):
        if path:
            layers.append(Layer(source, *load_file(Path(path))))
    layers += [env_layer(os.environ if environ is None else environ), set_layer(list(sets))]
    data, prov = merge(layers)
    issues = validate(data)
    if issues:
        def place(p: tuple[str, ...]) -> str:
            for layer in reversed(layers):
                for i in range(len(p), 0, -1):
                    if p[:i] in layer.where:
                        return layer.where[p[:i]]
            return ""

        raise ConfigError([i.line(place(i.path)) for i in issues])
    known = {r.entity for r in BUILT_IN} | {v[0] for v in NER_LABELS.values()} | set(data["custom"])
    warnings = []
    for e in data["entities"]:
        if e not in known:
            close = difflib.get_close_matches(e, sorted(known), 1)
            warnings.append(Issue(("entities", e), "no recognizer of this name", close[0] if close else None).line())
    return Resolved(data, prov, warnings)


def compile_config(r: Resolved, *, base: Detection = Detection(), secret: bytes = b"umbra", honour_custom_context: bool = False) -> tuple[Detection, Policy]:
    """What detect() and mask() take. custom.*.context is used only if asked for; hash keys come from UMBRA_HASH_KEY."""
    e, custom = r.data["entities"], r.data["custom"]
    words = dict(base.keywords)
    if honour_custom_context:
        words |= {k: tuple(x.lower() for x in v["context"]) for k, v in custom.items() if v.get("context")}
    d = Detection(
        rules=base.rules, keywords=words, threshold=base.threshold,
        thresholds={**base.thresholds, **{k: float(v["threshold"]) for k, v in e.items() if v.get("threshold") is not None}},
        disabled=base.disabled | {k for k, v in e.items() if not v.get("enabled", True)},
        custom=tuple(Rule(k, v["pattern"], float(v["score"])) for k, v in custom.items()),
        exclude_values=tuple(r.data["exclusions"]["values"]), exclude_patterns=tuple(r.data["exclusions"]["patterns"]),
        overlap=base.overlap, overlaps=base.overlaps, ner=base.ner, ner_labels=base.ner_labels,
    )
    key = os.environ.get("UMBRA_HASH_KEY")
    return d, Policy(r.data["umbra"]["default_strategy"], tuple((k, v["strategy"]) for k, v in e.items() if v.get("strategy")), hash_key=bytes.fromhex(key) if key else None, secret=secret)


def is_noop(r: Resolved) -> bool:
    return r.data == DEFAULTS


@lru_cache(1)
def ambient() -> Resolved:
    """The process's configuration, resolved once; reload() forgets it."""
    return resolve_config()


def reload() -> None:
    ambient.cache_clear()


def provenance_rows(r: Resolved) -> list[tuple[str, str, str, str]]:
    """(path, value, source, place); excluded values show their first and last character only."""
    def shown(path: tuple[str, ...], v: Any) -> str:
        if path == ("exclusions", "values"):
            v = [x[0] + "*" * (len(x) - 2) + x[-1] if len(x) > 2 else "*" * len(x) for x in v]
        return json.dumps(v, ensure_ascii=False)

    out = []
    for path, (source, place) in sorted(r.provenance.items()):
        v: Any = r.data
        for p in path:
            v = v[p]
        out.append((".".join(path), shown(path, v), source, place))
    return out


