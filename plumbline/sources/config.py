"""Settings and named datasources from YAML, with environment substitution."""

from __future__ import annotations

import os
import re
from typing import Any

from plumbline.model import ContractError

_current: dict[str, Any] | None = None
_path = ".plumbline/config.yml"


def substitute(value: Any) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` in all texts."""
    if isinstance(value, str):
        def one(m: re.Match) -> str:
            found = os.environ.get(m[1], m[3])
            if found is None:
                raise ContractError(f"the environment has no {m[1]}")
            return found

        return re.sub(r"\$\{(\w+)(:-([^}]*))?\}", one, value)
    if isinstance(value, dict):
        return {k: substitute(v) for k, v in value.items()}
    return [substitute(v) for v in value] if isinstance(value, list) else value


def set_config(path: str | None = None, settings: dict[str, Any] | None = None) -> None:
    """Use a file, or settings, from now on; neither: back to the default file."""
    global _current, _path
    _current, _path = settings, path or ".plumbline/config.yml"


def config(environment: str | None = None) -> dict[str, Any]:
    """The settings in force; an environment's own ones override the common ones."""
    raw = _current
    if raw is None:
        if not os.path.exists(_path):
            return {}
        import yaml

        with open(_path) as f:
            raw = yaml.safe_load(f) or {}
    extra = (raw.get("environments") or {}).get(environment, {}) if environment else {}
    if environment and environment not in (raw.get("environments") or {}):
        raise ContractError(f"no environment is named {environment!r}")
    return substitute(raw | extra)


def named_source(name: str, settings: dict[str, Any] | None = None) -> tuple[str, dict[str, Any]] | None:
    """(URI, options) of ``datasource.table``, or of a table name that one datasource alone has."""
    sources = (settings if settings is not None else config()).get("datasources") or {}
    source, _, table = name.partition(".")
    if source in sources and table:
        choices = [source]
    else:
        table = name
        choices = [s for s, d in sources.items() if table in (d.get("tables") or {})]
    if not choices:
        return None
    if len(choices) > 1:
        raise ContractError(f"{name!r} is in several datasources: {', '.join(sorted(choices))}")
    found = sources[choices[0]]
    tables = found.get("tables") or {}
    if table not in tables:
        raise ContractError(f"datasource {choices[0]} has no table {table!r}")
    said = tables[table]
    options = {k: v for k, v in found.items() if k not in ("tables", "base", "type")}
    base = found.get("base", "")
    return (said if "://" in str(said) or os.path.isabs(str(said)) or not base else f"{str(base).rstrip('/')}/{said}"), options


def resolve(name: str) -> str:
    """The URI of a named source, or the name itself."""
    found = named_source(name)
    return found[0] if found else name
