"""Configuration: a YAML file, checked value by value, over built-in defaults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from tidemark.rules.catalogue import builtin_rules

#: File names that are looked for, and defaults.
CANDIDATES = (".tidemark.yml", ".tidemark.yaml")
FORMATS = ("pretty", "json", "sarif", "markdown")
FAIL_ON = ("note", "warning", "error", "none")
VALIDATIONS = ("static-sql", "constant-argument", "none")
IGNORED = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/out/**", "**/.git/**", "**/.next/**", "**/.nuxt/**", "**/vendor/**", "**/*.min.js", "**/*.bundle.js", "**/*.d.ts")


class ConfigError(ValueError):
    """A value that can't be used; the message begins with its path."""


@dataclass
class Config:
    rules: dict[str, list[dict]] = field(default_factory=builtin_rules)
    ignore_paths: list[str] = field(default_factory=lambda: list(IGNORED))
    max_call_depth: int = 3
    max_iterations: int = 200
    kinds: list[str] | None = None
    dedupe: bool = True
    format: str = "pretty"
    output: str | None = None
    fail_on: str = "error"
    origin: str = "built-in"
    warnings: list[str] = field(default_factory=list)


def load_yaml(text: str) -> object:
    """Plain YAML: duplicate keys and tabs are errors, and yes, no, on, off stay words."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

    def mapping(loader, node, deep=True):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        for k in keys:
            if keys.count(k) > 1:
                raise ConfigError(f"{k}: given twice")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    if re.search(r"^ *\t", text, re.M):
        raise ConfigError("tabs can't indent")
    try:
        return yaml.load(text, Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e


class _Reader:
    def __init__(self):
        self.warnings: list[str] = []

    def record(self, value, path: str, known: tuple[str, ...]) -> dict:
        if not isinstance(value, dict):
            raise ConfigError(f"{path}: must be a mapping")
        self.warnings += [f"{path + '.' if path else ''}{k}: unknown key" for k in value if k not in known]
        return value

    def string(self, value, path: str) -> str:
        if not isinstance(value, str) or not value:
            raise ConfigError(f"{path}: must be text")
        return value

    def strings(self, value, path: str) -> list[str]:
        if not isinstance(value, list):
            raise ConfigError(f"{path}: must be a list of texts")
        return [self.string(v, f"{path}[{i}]") for i, v in enumerate(value)]

    def boolean(self, value, path: str) -> bool:
        if not isinstance(value, bool):
            raise ConfigError(f"{path}: must be true or false")
        return value

    def integer(self, value, path: str, least: int = 1) -> int:
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise ConfigError(f"{path}: must be a whole number from {least} on")
        return value

    def choice(self, value, path: str, choices: tuple[str, ...]) -> str:
        if value not in choices:
            raise ConfigError(f"{path}: must be one of {', '.join(choices)}")
        return value

    def pattern(self, spec: dict, path: str) -> dict:
        out = {k: self.string(spec[k], f"{path}.{k}") if k in spec else None for k in ("member", "identifier", "call")}
        if not any(out.values()):
            raise ConfigError(f"{path}: needs member, identifier or call")
        if out["member"] and re.search(r"[\s()\[\]{}]", out["member"]):
            raise ConfigError(f"{path}.member: no white space or brackets")
        for k in ("identifier", "call"):
            if out[k] and not re.fullmatch(r"[A-Za-z_$][\w$]*", out[k]):
                raise ConfigError(f"{path}.{k}: must be a plain name")
        return out

    def rule(self, kind: str, spec, path: str) -> dict:
        known = {
            "sources": ("id", "kinds", "member", "identifier", "call", "withinFunctions", "description"),
            "sanitizers": ("id", "kinds", "member", "identifier", "call", "validation", "description"),
            "sinks": ("id", "kinds", "member", "identifier", "call", "severity", "taintedArgs", "cwe", "message", "advice"),
            "propagators": ("member", "identifier", "call", "allowDynamic"),
        }[kind]
        spec = self.record(spec, path, known)
        out = self.pattern(spec, path)
        get = lambda key, read, default=None: read(spec[key], f"{path}.{key}") if key in spec else default
        if kind == "propagators":
            return out | {"allow_dynamic": get("allowDynamic", self.boolean, False)}
        out |= {"id": self.string(spec.get("id"), f"{path}.id"), "kinds": sorted(set(self.strings(spec.get("kinds", []) if kind == "sanitizers" else spec.get("kinds"), f"{path}.kinds")))}
        if kind == "sources":
            return out | {"within_functions": get("withinFunctions", self.strings), "description": get("description", self.string)}
        if kind == "sanitizers":
            return out | {"validation": self.choice(spec.get("validation", "none"), f"{path}.validation", VALIDATIONS), "description": get("description", self.string)}
        positions = lambda v, p: [self.integer(x, f"{p}[{i}]", 0) for i, x in enumerate(v)] if isinstance(v, list) else self.strings(v, p)
        return out | {
            "severity": self.choice(spec.get("severity", "warning"), f"{path}.severity", FAIL_ON[:3]), "tainted_args": get("taintedArgs", positions), "cwe": get("cwe", self.strings),
            "message": self.string(spec.get("message"), f"{path}.message"), "advice": get("advice", self.string),
        }


def merge_rules(base: list[dict], own: list[dict]) -> tuple[list[dict], list[str]]:
    """Appended; a repeated id takes the first one's place and the last one's meaning."""
    out: dict[str, dict] = {}
    warnings = []
    for rule in [*base, *own]:
        if rule["id"] in out:
            warnings.append(f"rule {rule['id']} is defined more than once; the last definition counts")
        out[rule["id"]] = rule
    return list(out.values()), warnings


def merge_propagators(base: list[dict], own: list[dict]) -> list[dict]:
    return list({(p["member"], p["identifier"], p["call"], p["allow_dynamic"]): p for p in [*base, *own]}.values())


def parse_config(text: str, origin: str = "text") -> Config:
    reader, out = _Reader(), Config(origin=origin)
    document = load_yaml(text)
    document = reader.record({} if document is None else document, "", ("version", "rules", "analysis", "output", "ignorePaths"))
    if document.get("version", 1) != 1:
        raise ConfigError("version: must be 1")
    rules = reader.record({} if document.get("rules") is None else document["rules"], "rules", ("sources", "sanitizers", "sinks", "propagators"))
    for kind in rules:
        if kind not in out.rules:
            continue
        if not isinstance(rules[kind], list):
            raise ConfigError(f"rules.{kind}: must be a list")
        own = [reader.rule(kind, spec, f"rules.{kind}[{i}]") for i, spec in enumerate(rules[kind])]
        if kind == "propagators":
            out.rules[kind] = merge_propagators(out.rules[kind], own)
        else:
            out.rules[kind], said = merge_rules(out.rules[kind], own)
            reader.warnings += said
    analysis = reader.record({} if document.get("analysis") is None else document["analysis"], "analysis", ("maxCallDepth", "maxIterations", "kinds", "dedupe", "ignorePaths"))
    for key, name, read in (("maxCallDepth", "max_call_depth", reader.integer), ("maxIterations", "max_iterations", reader.integer), ("kinds", "kinds", reader.strings), ("dedupe", "dedupe", reader.boolean), ("ignorePaths", "ignore_paths", reader.strings)):
        if key in analysis:
            setattr(out, name, read(analysis[key], f"analysis.{key}"))
    if "ignorePaths" in document:
        out.ignore_paths = reader.strings(document["ignorePaths"], "ignorePaths")
    output = reader.record({} if document.get("output") is None else document["output"], "output", ("format", "output", "failOn"))
    if "format" in output:
        out.format = reader.choice(output["format"], "output.format", FORMATS)
    if "output" in output:
        out.output = reader.string(output["output"], "output.output")
    if "failOn" in output:
        out.fail_on = reader.choice(output["failOn"], "output.failOn", FAIL_ON)
    out.warnings = reader.warnings
    return out


def resolve_config(root: str, path: str | None = None, overrides: dict | None = None, builtin_only: bool = False) -> Config:
    """Overrides over the named file, or the first candidate in the root, over built-ins."""
    config = Config()
    base = root if os.path.isdir(root) else os.path.dirname(os.path.abspath(root))
    if not builtin_only:
        if path is not None and not os.path.isfile(path):
            raise ConfigError(f"{path}: no such configuration file")
        found = path or next((p for c in CANDIDATES if os.path.isfile(p := os.path.join(base, c))), None)
        if found:
            with open(found, encoding="utf-8") as f:
                config = parse_config(f.read(), found)
    for k, v in (overrides or {}).items():
        if v is not None:
            setattr(config, k, v)
    return config
