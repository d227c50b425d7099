"""Run configuration: a YAML (or JSON) file with sections, relative paths resolved against it, overrides on top."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str, overrides: dict | None = None) -> dict:
    text = Path(path).read_text()
    try:
        import yaml

        config = yaml.safe_load(text) or {}
    except ImportError:
        config = json.loads(text)
    for key, value in (overrides or {}).items():
        at = config
        *sections, last = key.split(".")
        for s in sections:
            at = at.setdefault(s, {})
        if value is not None:
            at[last] = value
    graph = config.get("graphapi", {})
    for k in ("db_path", "index_dir"):
        if graph.get(k) and not Path(graph[k]).is_absolute():
            graph[k] = str((Path(path).parent / graph[k]).resolve())
    return config
