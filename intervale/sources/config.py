"""Layered configuration: defaults, then a file, then a profile, then the environment."""

from __future__ import annotations

from collections.abc import Mapping


def merged(base: Mapping, over: Mapping, log: list[tuple[str, object, object]] | None = None, path: str = "") -> dict:
    """base with over's values, nested; keys that begin with _comment are left out; changes are logged as (path, old, new)."""
    out = {k: v for k, v in base.items() if not str(k).startswith("_comment")}
    for k, v in over.items():
        if str(k).startswith("_comment"):
            continue
        here = f"{path}{k}"
        if isinstance(v, Mapping):
            out[k] = merged(out[k] if isinstance(out.get(k), Mapping) else {}, v, log, here + ".")
        else:
            if log is not None and k in out and out[k] != v:
                log.append((here, out[k], v))
            out[k] = v
    return out


def from_environment(base: Mapping, environment: Mapping[str, str], names: Mapping[str, str]) -> dict:
    """Values of environment variables (names: variable -> dotted path), read as the type of the value they replace."""
    out = merged(base, {})
    for variable, path in names.items():
        if variable not in environment:
            continue
        *parents, leaf = path.split(".")
        at = out
        for p in parents:
            at[p] = dict(at.get(p) or {})
            at = at[p]
        old, text = at.get(leaf), environment[variable]
        at[leaf] = text.strip().lower() in ("1", "true", "yes", "on") if isinstance(old, bool) else type(old)(text) if isinstance(old, (int, float)) else text
    return out


def layered(defaults: Mapping, file: Mapping | None = None, profile: Mapping | None = None, environment: Mapping[str, str] | None = None, names: Mapping[str, str] | None = None) -> dict:
    out = merged(defaults, {})
    for layer in (file, profile):
        out = merged(out, layer or {})
    return from_environment(out, environment or {}, names or {})
