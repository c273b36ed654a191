"""Rules from YAML, validated before any job runs."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..functions.globs import covers, dotted_glob, roots

_KEYS = {
    "": ("layers", "forbid", "required", "sdp", "roots", "exclude", "max_modules", "min_layers_present", "exclude_type_checking_imports"),
    "layers": ("name", "modules"),
    "forbid": ("from", "to"),
    "required": ("source", "must_reach", "reason", "within"),
    "sdp": ("enabled", "mode", "tolerance"),
}


@dataclass(frozen=True)
class Config:
    layers: dict[str, list[str]] = field(default_factory=dict)
    forbid: list[tuple[str, str]] = field(default_factory=list)
    required: list[dict] = field(default_factory=list)
    sdp_mode: str = "off"
    sdp_tolerance: float = 0.0
    roots: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_modules: int = 10_000
    min_layers: int | None = None
    exclude_type_checking: bool = False

    def governed(self) -> set[str] | None:
        """First segments that the layers' patterns bound; None if one floats."""
        return roots([p for ps in self.layers.values() for p in ps])


def _known(given: dict, part: str) -> None:
    for k in given:
        if k not in _KEYS[part]:
            near = difflib.get_close_matches(str(k), _KEYS[part], 1)
            raise ValueError(f"unknown key {k!r}" + (f" in {part}" if part else "") + (f", did you mean {near[0]!r}?" if near else ""))


def parse(text: str) -> Config:
    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a mapping")
    _known(raw, "")
    layers = raw.get("layers") or {}
    if isinstance(layers, list):
        for x in layers:
            _known(x, "layers")
        layers = {x["name"]: x["modules"] for x in layers}
    layers = {k: [v] if isinstance(v, str) else list(v["modules"] if isinstance(v, dict) else v) for k, v in layers.items()}
    for ps in layers.values():
        for p in ps:
            dotted_glob(p)
    forbid = []
    for x in raw.get("forbid") or []:
        _known(x, "forbid")
        for end in (x["from"], x["to"]):
            if end not in layers:
                raise ValueError(f"forbid names {end!r}, which is no layer")
        forbid.append((x["from"], x["to"]))
    for x in raw.get("required") or []:
        _known(x, "required")
        for k in ("source", "must_reach"):
            dotted_glob(x[k])
    sdp = raw.get("sdp") or {}
    _known(sdp, "sdp")
    if sdp.get("mode", "error") not in ("error", "warn"):
        raise ValueError("sdp mode is error or warn")
    if not isinstance(sdp.get("enabled", False), bool):
        raise ValueError("sdp.enabled is true or false")
    mode = sdp.get("mode", "error") if sdp.get("enabled", False) else "off"
    for x in raw.get("exclude") or []:
        if any(c in x for c in "/\\*?["):
            raise ValueError(f"exclude names directories, so {x!r} matches none")
    if not 0 <= float(sdp.get("tolerance", 0.0)) <= 1:
        raise ValueError("tolerance is in [0, 1]")
    floor = raw.get("min_layers_present")
    if floor is not None and not 0 < floor <= len(layers):
        raise ValueError("min_layers_present is between 1 and the number of layers")
    return Config(layers, forbid, list(raw.get("required") or []), mode, float(sdp.get("tolerance", 0.0)), tuple(raw.get("roots") or ()), tuple(raw.get("exclude") or ()), int(raw.get("max_modules", 10_000)), floor, bool(raw.get("exclude_type_checking_imports", False)))


def discover(start: str, name: str = "layers.yaml") -> str | None:
    """The nearest file of that name in start or above."""
    at = Path(start).resolve()
    return next((str(d / name) for d in (at, *at.parents) if (d / name).is_file()), None)


def fingerprint(c: Config) -> list[tuple[str, str]]:
    """(kind, rule) of all rules, sorted and without repeats."""
    rows = {("layer", f"{k}: {p}") for k, ps in c.layers.items() for p in ps} | {("forbid", f"{a} -> {b}") for a, b in c.forbid}
    rows |= {("required", f"{r['source']} => {r['must_reach']} in {r.get('within', '')}") for r in c.required} | {("exclude", e) for e in c.exclude} | {("root", r) for r in c.roots}
    return sorted(rows)


def weakened(before: Config, after: Config) -> list[tuple[str, str]]:
    """(kind, rule) of rules that after no longer enforces as widely: forbids and requirements that are gone, layer patterns
    that nothing covers any more, exclusions and roots that are new."""
    out = [("forbid", f"{a} -> {b}") for a, b in before.forbid if (a, b) not in after.forbid]
    for k, ps in before.layers.items():
        out += [("layer", f"{k}: {p}") for p in ps if not any(covers(q, p) for q in after.layers.get(k, []))]
    same = lambda r: (r["source"], r["must_reach"], r.get("within"))
    kept = {same(r) for r in after.required}
    out += [("required", f"{r['source']} => {r['must_reach']}") for r in before.required if same(r) not in kept]
    out += [("exclude", e) for e in after.exclude if e not in before.exclude] + [("root", r) for r in after.roots if r not in before.roots]
    return sorted(out)


def weakened_since(before: list[tuple[str, str]], after: Config) -> list[tuple[str, str]]:
    """weakened() against the fingerprint of an earlier configuration."""
    now, out = set(fingerprint(after)), []
    for kind, rule in before:
        if kind == "layer":
            name, _, pattern = rule.partition(": ")
            if not any(covers(q, pattern) for q in after.layers.get(name, [])):
                out.append((kind, rule))
        elif kind in ("forbid", "required") and (kind, rule) not in now:
            out.append((kind, rule))
    return sorted(out + [r for r in now if r[0] in ("exclude", "root") and r not in set(before)])
